"""Near-duplicate records with small edits: a byte-position inverted index with count filtering.

Each record becomes a signature of ``PLACES`` bytes, one per hash function: at any place two records share
the byte with a probability equal to their similarity. The inverted index is keyed by position and by
``RUN`` neighbouring bytes (one byte alone would put n / 256 records into every list). A join of the index
with itself gives the pairs that share a key; for each the shared positional bytes are counted, pairs that
fall short of the least count a pair at the threshold can be relied on to reach are dropped, and the others
are verified on their whole texts.

A pair at the threshold of 0.7 shares no key with a probability of 0.00015 and fewer than ``least_matches``
bytes with one of 0.00007; above the threshold both vanish quickly. Records with the same sequence of words
are one class and appear in the index once, so a group of copies of any size adds nothing to the join; a key
that many different records share is split by Spark's skew join, never gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.tables import pairs_within, roughly_in, spread
from . import shingles

PLACES = 128
RUN = 4
#: Up to so many copies of one identical text are written out in pairs; of more every copy is paired with the first.
SPELL_OUT = 32


def least_matches(threshold: float, places: int = PLACES, sure: float = 3.8) -> int:
    """The number of equal bytes that a pair at the threshold reaches, but for ``sure`` standard deviations."""
    equal = threshold + (1 - threshold) / 256
    return math.floor(places * equal - sure * math.sqrt(places * equal * (1 - equal)))


def signatures(records: DataFrame, width: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, c1, c2, t1, t2, sig``: records of at least ``min_words`` words.

    ``c1, c2`` are equal for equal word sequences, ``t1, t2`` for identical texts.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, run in shingles.spans(texts):
                count, c1, c2, keys = shingles.shingle_sets(run, width)
                sig = shingles.minhash_bytes(keys, len(run), PLACES)
                keep = np.flatnonzero(count >= max(min_words, width))
                ids = batch.column(0).take(pa.array(first + keep))
                packed = pa.array([sig[i].tobytes() for i in keep.tolist()], type=pa.binary())
                t1, t2 = (batch.column(c).take(pa.array(first + keep)) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([ids, pa.array(c1[keep].view(np.int64)), pa.array(c2[keep].view(np.int64)), t1, t2, packed], ["id", "c1", "c2", "t1", "t2", "sig"])

    slim = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    slim = slim.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = spread(slim).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})
    return slim.mapInArrow(sign, "id bigint, c1 bigint, c2 bigint, t1 bigint, t2 bigint, sig binary")


def index_entries(signed: DataFrame) -> DataFrame:
    """``key, id``: one row per record and position; ``key`` holds the position and the bytes found there."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = PLACES // RUN
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, runs, RUN)
            value = np.ascontiguousarray(sig).view(np.uint32)[:, :, 0].astype(np.int64)
            key = (np.arange(runs, dtype=np.int64) << 32)[None, :] | value
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), runs))], ["key", "id"])

    return signed.select("id", "sig").mapInArrow(entries, "key bigint, id bigint")


def _verified(pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shingles.jaccard(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), width)
            keep = pa.array(np.flatnonzero(score >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("id_a").take(keep), batch.column("id_b").take(keep), pa.array(score).take(keep)], ["id_a", "id_b", "similarity"])

    return pairs.select("id_a", "id_b", "text_a", "text_b").mapInArrow(verify, "id_a bigint, id_b bigint, similarity double")


def _classes(records: DataFrame, width: int, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures, the members of classes of equal words, and the signatures of the classes' first ones."""
    signed = durable(signatures(records, width, min_words, id_col, text_col))
    classes = signed.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.max("id").alias("last"))
    copied = classes.where("class_id < last").select("c1", "c2", "class_id")
    member = signed.select("id", "c1", "c2", F.struct("t1", "t2").alias("text")).join(copied, ["c1", "c2"], "left")
    members = member.groupBy("id", F.coalesce("class_id", "id").alias("class_id")).agg(F.min("text").alias("text"))
    spare = member.where("id <> class_id").select("id").distinct()
    return signed, members, signed.select("id", "sig").join(spare, "id", "left_anti")


def _links(pairs: DataFrame, records: DataFrame, signed: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id_a, id_b, similarity`` of the candidate pairs that pass the count filter and are similar."""
    sig = signed.select("id", "sig").dropDuplicates(["id"])
    same = _equal_bytes(
        pairs.join(sig.select(F.col("id").alias("id_a"), F.col("sig").alias("sig_a")), "id_a").join(sig.select(F.col("id").alias("id_b"), F.col("sig").alias("sig_b")), "id_b"),
        least_matches(threshold),
    )
    same = durable(same)
    needed = durable(same.select(F.col("id_a").alias("id")).union(same.select("id_b")).distinct())
    texts = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = roughly_in(texts, needed, ["id"]).join(needed, "id", "left_semi").dropDuplicates(["id"])
    full = same.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    full = full.join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    return _verified(full, threshold, width)


def linked_classes(records: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 0, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """The classes of equal word sequences, and the links between classes.

    * members: ``id, class_id, text``, one row per record that takes part; ``class_id`` is the least id of its
      class, ``text`` is equal for identical texts.
    * links: ``id_a, id_b, similarity`` between class ids, ``id_a < id_b``, similarity >= ``threshold``.

    Records with a NULL id or text, with fewer than ``min_words`` words, or with too few words for one
    shingle take no part. Repeated ids count once (their texts are taken to be equal). Texts of any length
    are processed whole. Columns other than the two named are not read. Empty tables give empty results.
    """
    signed, members, firsts = _classes(records, width, min_words, id_col, text_col)
    entries = index_entries(firsts)
    other = entries.select("key", F.col("id").alias("id_b"))
    pairs = entries.withColumnRenamed("id", "id_a").join(other, "key").where("id_a < id_b").select("id_a", "id_b").distinct()
    return members, _links(pairs, records, signed, threshold, width, id_col, text_col)


def _equal_bytes(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs that share at least ``least`` positional bytes."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sig_a", "sig_b"))
            keep = pa.array(np.flatnonzero((a == b).sum(axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("id_a").take(keep), batch.column("id_b").take(keep)], ["id_a", "id_b"])

    return pairs.select("id_a", "id_b", "sig_a", "sig_b").mapInArrow(tally, "id_a bigint, id_b bigint")


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 0, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``id_a, id_b``: pairs of different ids whose similarity is at least ``threshold``.

    Classes are written out: all pairs within, and every member with every member of a linked class. Only of
    more than ``SPELL_OUT`` copies of one identical text every copy is paired with the first one, which alone
    carries the links to other texts; no link between different texts is lost.
    """
    members, links = linked_classes(records, threshold, width, min_words, id_col, text_col)
    members = durable(members)
    size = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    copied = members.join(size, "class_id")
    # a class of few members has no text of many copies
    large = copied.where(F.col("n") > SPELL_OUT)
    texts = large.groupBy("class_id", "text").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    told = large.join(texts, ["class_id", "text"]).select("class_id", "id", "n", "copies", "first")
    star = (F.col("copies") > SPELL_OUT) & (F.col("id") > F.col("first"))
    spoken = durable(copied.where(F.col("n") <= SPELL_OUT).select("class_id", "id", "n").union(told.where(~star).select("class_id", "id", "n")))
    a = spoken.select(F.col("class_id").alias("id_a"), F.col("id").alias("of_a"))
    b = spoken.select(F.col("class_id").alias("id_b"), F.col("id").alias("of_b"))
    across = links.join(a, "id_a", "left").join(b, "id_b", "left").select(F.coalesce("of_a", "id_a").alias("x"), F.coalesce("of_b", "id_b").alias("y"))
    within = pairs_within(spoken, ["class_id"], "id", "n")
    every = across.union(within).union(told.where(star).select(F.col("first").alias("x"), F.col("id").alias("y")))
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_counts(records: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 0, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``id, class_id, links``: one row per record that takes part, with the number of other classes its class is linked with."""
    members, links = linked_classes(records, threshold, width, min_words, id_col, text_col)
    ends = F.explode(F.array("id_a", "id_b")).alias("class_id")
    degree = links.select(ends).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.select("id", "class_id").join(degree, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, group_id``: the least id that each node is connected with, by alternating star contraction.

    Each round hangs the larger neighbours of a node under its least one, then the smaller ones; rounds are
    kept in the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = durable(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(root.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(edges)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")), "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))


def near_duplicate_groups(records: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 0, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``id, class_id, group_id``: one row per record that takes part.

    ``class_id`` is the least id with the same words, ``group_id`` the least id connected by links of the similarity.
    Of the pairs that share a key only those are made and verified that may connect what is not yet connected: first
    each record with the first one under its key, then those of different groups. So a template of many variants costs
    as much as it has records, not pairs.
    """
    signed, members, firsts = _classes(records, width, min_words, id_col, text_col)
    members = durable(members)
    entries = durable(index_entries(firsts))
    nodes = members.select(F.col("class_id").alias("id")).distinct()
    first = entries.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", F.col("lead").alias("id_a"))
    star = entries.withColumnRenamed("id", "id_b").join(first, "key").where("id_a < id_b").select("id_a", "id_b").distinct()
    found = durable(_links(star, records, signed, threshold, width, id_col, text_col).select("id_a", "id_b"))
    grouped = durable(components(nodes, found))
    known = entries.join(grouped, "id")
    other = known.select("key", F.col("id").alias("id_b"), F.col("group_id").alias("group_b"))
    mixed = known.groupBy("key").agg(F.min("group_id").alias("low"), F.max("group_id").alias("high")).where("low < high").select("key")
    apart = known.join(mixed, "key", "left_semi").withColumnRenamed("id", "id_a").join(other, "key").where("id_a < id_b AND group_id <> group_b")
    last = _links(apart.select("id_a", "id_b").distinct(), records, signed, threshold, width, id_col, text_col).select("id_a", "id_b")
    grouped = components(nodes, durable(found.union(last)))
    return members.join(grouped.withColumnRenamed("id", "class_id"), "class_id").select("id", "class_id", "group_id")
