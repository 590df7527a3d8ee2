"""One form for texts that look the same: full-width forms, accents, invisible characters, look-alike letters.

Strings and code points that look alike are joined into classes by union-find, so that likeness carries over
(a full-width letter, its ordinary form, the same-shaped Cyrillic letter). Accented letters are classes of
strings: the composed code point and every look-alike of the base followed by the mark. The member that the
corpus uses most stands for its class, the empty string for everything invisible. Texts are rewritten left
to right, longest match first, by an Aho-Corasick automaton over all members that are not representatives;
texts that hold none of them never leave the JVM.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.tables import pairs_within, spread

#: Letters of other alphabets beside the Latin letters of the same shape.
SAME_SHAPE = [
    ("АВЕЅІЈКМНОРСТУХԚԜҮѴ", "ABESIJKMHOPCTYXQWYV"),  # Cyrillic capitals
    ("асԁеһіјорԛѕԝхуүѵ", "acdehijopqswxyyv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),  # Greek capitals
    ("αγινορυϲϳ", "ayivopucj"),  # Greek small letters
    ("ՕՏօսհ", "OSouh"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬ", "ABEHIKMNOPCTX"),  # Coptic
]
#: Format characters that are visible or belong to emoji, and so are no invisible ones.
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0xE0000, 0xE0080)}
#: Copies of one identical text that ``same_looking_pairs`` pairs with all documents of the other texts; further ones with one.
COPIES = 64
#: Copies of one identical text that meet those of another together in ``all_same_looking_pairs``.
BLOCK_COPIES = 1024


class UnionFind:
    """Disjoint sets of hashable items, with path halving and union by size."""

    def __init__(self) -> None:
        self.parent: dict = {}
        self.size: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        self.size.setdefault(x, 1)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]

    def classes(self) -> list[list]:
        out = defaultdict(list)
        for x in list(self.parent):
            out[self.find(x)].append(x)
        return [sorted(c) for c in out.values()]


def look_alike_classes() -> list[list[str]]:
    """The classes of two members or more; a rule over the code points' own properties plus ``SAME_SHAPE``."""
    sets, composed = UnionFind(), []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind == "Cf" and point not in _VISIBLE_FORMAT or point == 0x34F:
            sets.union(c, "")
            continue
        parts = unicodedata.decomposition(c).split()
        if not parts:
            continue
        if parts[0] == "<wide>" or parts[0] == "<noBreak>" and kind == "Zs":
            sets.union(c, "".join(chr(int(p, 16)) for p in parts[1:]))
        elif parts[0][0] != "<" and len(parts) == 2:
            composed.append((chr(int(parts[0], 16)), chr(int(parts[1], 16)), c))
    for other, latin in SAME_SHAPE:
        for x, y in zip(other, latin, strict=True):
            sets.union(x, y)
    # An accented letter is any look-alike of its base with the mark; bases may be accented themselves.
    for _ in range(3):
        members = {x: c for c in sets.classes() for x in c}
        for base, mark, whole in composed:
            for x in members.get(base, [base] if whole in members else []):
                sets.union(x + mark, whole)
    # Other alphabets' composed letters whose bases look like Latin ones meet them through their parts.
    return sorted(c for c in sets.classes() if len(c) > 1)


_HAS_MARK = re.compile(r"[̀-ͯ]")
_MARKED = re.compile(r"[^\W\d_][̀-ͯ]+")


def unit_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``unit, n``: how often each code point, and each letter with its combining marks, occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, marked = np.zeros(sys.maxunicode + 1, dtype=np.int64), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                part = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                points[: int(part.max(initial=0)) + 1] += np.bincount(part)[: len(points)] if len(part) else 0
                if _HAS_MARK.search(text):
                    marked.update(_MARKED.findall(text))
        seen = np.flatnonzero(points)
        seen = seen[(seen < 0xD800) | (seen > 0xDFFF)]
        units = [*map(chr, seen.tolist()), *marked]
        if units:
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array([*points[seen].tolist(), *marked.values()], pa.int64())], ["unit", "n"])

    slim = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    return spread(slim).mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def representatives(classes: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Every member that is to be rewritten, with the member that stands for its class.

    The empty string stands for its class; else the most frequent member, the shorter and then the lower of
    equally frequent ones.
    """
    table = {}
    for members in classes:
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        table.update({m: best for m in members if m != best})
    return table


class Rewriter:
    """Rewrites texts by a table from strings to strings, leftmost and longest first."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.drop = {ord(k): None for k, v in table.items() if v == ""}
        self.automaton = ahocorasick.Automaton()
        for k, v in table.items():
            if v:
                self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.any = len(self.automaton) > 0

    def __call__(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text.translate(self.drop))
        if not self.any:
            return text
        out, at = [], 0
        for end, (size, new) in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - size])
            out.append(new)
            at = end + 1
        out.append(text[at:])
        return "".join(out)


def consistent_forms(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, form``: the one form of every text, case, accents and all else being kept.

    NULL texts and ids give no row; the empty text is its own form, and that of texts that are invisible
    altogether. Texts are taken whole, whatever their length. Other columns are not read.
    The counts that choose the representatives are taken over all texts; what comes to the driver is one
    row per code point or accented letter of the fixed classes.
    """
    spark = documents.sparkSession
    classes = look_alike_classes()
    units = spark.createDataFrame([(m,) for c in classes for m in c if m], "unit string")
    counts = {r.unit: r.n for r in unit_counts(documents, text_col).join(F.broadcast(units), "unit", "left_semi").collect()}
    table = representatives(classes, counts)
    known = spark.sparkContext.broadcast(table)
    slim = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    slim = spread(slim.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    # ASCII texts change only if an ASCII letter does not stand for its own class.
    ascii_members = "".join(f"\\x{ord(k):02x}" for k in sorted(table) if len(k) == 1 and k.isascii())
    changes = F.col("text").rlike(r"[^\x00-\x7f]" + (f"|[{ascii_members}]" if ascii_members else ""))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = Rewriter(known.value)
        for batch in batches:
            forms = pa.array([write(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), forms], ["doc_id", "text", "form"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    changed = slim.where(changes).mapInArrow(rewrite, f"doc_id {kind}, text string, form string")
    return changed.union(slim.where(~changes).withColumn("form", F.col("text")))


def _hashed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, f1, f2, text``: two hashes of the form and one of the text; the texts are rewritten once."""
    forms = consistent_forms(documents, id_col, text_col)
    return durable(forms.select(F.col("doc_id").alias("id"), F.xxhash64("form").alias("f1"), F.xxhash64("form", F.lit(1)).alias("f2"), F.sha2("text", 256).alias("text")))


def all_same_looking_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b``: all documents whose texts differ but have one form, smaller id first, however many copies there are.

    Only hashes are shuffled, and ids. The different texts of a form are paired; their copies meet in blocks of
    ``BLOCK_COPIES``, which are spread over the tasks, so that no task writes all pairs of two texts. An id with several
    texts of a form has a row for each.
    """
    keys = ["f1", "f2"]
    hashed = _hashed(documents, id_col, text_col)  # several joins read it
    texts = hashed.groupBy(*keys, "text").agg(F.count("*").alias("copies"))
    mixed = durable(texts.join(texts.groupBy(*keys).agg(F.count("*").alias("texts")).where("texts > 1"), keys))
    pairs = pairs_within(mixed, keys, "text", "texts").toDF("a", "b")
    blocks = mixed.select("text", F.ceil(F.col("copies") / BLOCK_COPIES).cast("int").alias("blocks"))
    members = hashed.join(blocks, "text").groupBy("text", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_set("id").alias("ids"))
    for side in ("a", "b"):
        pairs = pairs.join(members.select(F.col("text").alias(side), F.col("block").alias(f"block_{side}"), F.col("ids").alias(f"of_{side}")), side)
    tasks = 2 * documents.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.repartition(tasks, "a", "block_a", "b", "block_b").select(F.explode("of_a").alias("x"), "of_b").select("x", F.explode("of_b").alias("y"))
    return pairs.where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def same_looking_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b``: enough pairs to connect all documents whose texts differ but have one form, smaller id first.

    For callers who do not want every pair of many copies; no query uses it, ``all_same_looking_pairs`` leaves none out.
    Only hashes are shuffled. Every two different texts of a form are paired, however many there are, and so are
    all their copies, but that of one identical text only ``COPIES`` copies meet all documents of the other texts:
    the first of more does so for the others, each of which is paired with the first document of one other text.
    ``same_looking_groups`` has the whole classes.
    """
    keys = ["f1", "f2"]
    hashed = _hashed(documents, id_col, text_col)  # several joins read it
    texts = hashed.groupBy(*keys, "text").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("copies"))
    forms = texts.groupBy(*keys).agg(F.count("*").alias("texts"), F.min("class_id").alias("first")).where("texts > 1")
    mixed = texts.join(forms, keys)
    pairs = pairs_within(mixed, keys, "class_id", "texts").toDF("a", "b")
    several = mixed.where((F.col("copies") > 1) & (F.col("copies") <= COPIES)).select(*keys, "text", "class_id")
    members = hashed.join(several, [*keys, "text"]).select("class_id", "id").distinct()
    spelt = pairs.join(members.select(F.col("class_id").alias("a"), F.col("id").alias("of_a")), "a", "left")
    spelt = spelt.join(members.select(F.col("class_id").alias("b"), F.col("id").alias("of_b")), "b", "left")
    x, y = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    many = mixed.where(F.col("copies") > COPIES)
    other = many.where("class_id <> first").select(*keys, "text", "class_id", F.col("first").alias("partner"))
    leading = many.where("class_id = first").select(*keys, "text", "class_id")
    second = mixed.where("class_id <> first").groupBy(*keys).agg(F.min("class_id").alias("partner"))
    many = other.union(leading.join(second, keys))
    rest = hashed.join(many, [*keys, "text"]).where("id <> class_id").select(F.col("id").alias("x"), F.col("partner").alias("y"))
    every = spelt.select(x.alias("x"), y.alias("y")).union(rest)
    return every.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def same_looking_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, form_id, texts, links``: every document with an id and a text.

    ``text_id`` is the least id with the identical text, ``form_id`` the least id with the same form, ``texts`` the
    number of different texts of the form, ``links`` the number of documents with one of the other texts.
    """
    keys = ["f1", "f2"]
    hashed = durable(_hashed(documents, id_col, text_col).distinct())
    texts = hashed.groupBy(*keys, "text").agg(F.min("id").alias("text_id"), F.count_distinct("id").alias("copies"))
    forms = texts.groupBy(*keys).agg(F.min("text_id").alias("form_id"), F.count("*").alias("texts"), F.sum("copies").alias("documents"))
    classes = texts.join(forms, keys).select(*keys, "text", "text_id", "form_id", "texts", (F.col("documents") - F.col("copies")).alias("links"))
    return hashed.join(classes, [*keys, "text"]).select(F.col("id").alias("doc_id"), "text_id", "form_id", "texts", "links")
