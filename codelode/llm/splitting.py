"""Splitting oversized items at natural boundaries, with overlap.

Every place where a text may be cut has a strength: how naturally the text pauses there (a top-level
declaration after a blank line, a blank line, the end of a block, a line, a sentence, a space, any code
point). A sparse table over the strengths answers in constant time which cut within the permissible window
is the strongest, ties going to the right. Each next piece starts the stated number of lines before the cut.

Texts within their limit never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece is filled to at least this share of its limit where a boundary allows it.
LEAST_FILL = 0.5
#: What a declaration at the start of a line looks like, by language.
_DECLARATION = {
    "go": r"(?:func|type|var|const|import|package)\b",
    "python": r"(?:def|class|async\s+def|@\w|if\s+__name__)",
    "javascript": r"(?:export|function|async\s+function|class|const|let|var|import|module\.)\b",
    "typescript": r"(?:export|function|async\s+function|class|const|let|var|import|interface|type|enum|namespace|declare)\b",
    "java": r"(?:public|protected|private|static|final|abstract|class|interface|enum|record|@\w|package|import)",
    "shell": r"(?:function\s|\w+\s*\(\)\s*\{)",
    "sql": r"(?:create|alter|insert|select|update|delete|drop|with|grant)\b",
    "markdown": r"#{1,6}\s",
    "toml": r"\[",
    "ini": r"\[",
    "yaml": r"[\w\"'-]",
    "dockerfile": r"(?:from|run|copy|env|cmd|entrypoint|workdir|arg)\b",
    "css": r"[.#@\w]",
}
_COMMENT = re.compile(r"\s*(?://|#(?!#)|/\*|\*|--|<!--|\"\"\"|''')")


class SparseTable:
    """Range maxima in constant time, the rightmost of equal values.

    Only windows of at most ``widest`` values are asked for, from left to right: the table covers a stretch of
    ``STRETCH`` windows at a time, so that its size does not depend on the number of values.
    """

    STRETCH = 64

    def __init__(self, values: np.ndarray, widest: int | None = None):
        self.values, self.widest = values, min(widest or len(values), len(values))
        self._cover(0)

    def _cover(self, begin: int) -> None:
        self.begin = begin
        part = self.values[begin : begin + (self.STRETCH + 1) * self.widest]
        # the place is part of the value, so that the greatest value is the rightmost of the strongest
        level = part.astype(np.int64) << 40 | np.arange(len(part), dtype=np.int64)
        self.levels, width = [level], 1
        while 2 * width <= min(self.widest, len(part)):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """The place of the greatest value in ``lo .. hi - 1``."""
        if not self.begin <= lo or hi > self.begin + len(self.levels[0]):
            self._cover(lo)
        k = (hi - lo).bit_length() - 1
        level, lo, hi = self.levels[k], lo - self.begin, hi - self.begin
        return self.begin + int(max(level[lo], level[hi - (1 << k)]) & ((1 << 40) - 1))


def boundary_strengths(text: str, language: str | None) -> np.ndarray:
    """For each place 0 .. len(text): the strength of a cut before the code point there.

    | strength | place |
    |---|---|
    | 0 | inside a pair of code points that belong together (carriage return and line feed, base and mark) |
    | 1, 2, 3, 4 | any other; after a space or separator; after a clause; after a sentence |
    | 6, less by depth of indentation | line start |
    | 12 to 16 | line start after a closing bracket; after or before a blank line; both |
    | 20 to 24 | declaration, or the comment before it, at the outer level; after a blank line |
    """
    n = len(text)
    strength = np.ones(n + 1, dtype=np.int16)
    for m in re.finditer(r"(?<=[\s,;|&+/\-_.)}\]>])(?=\S)", text):
        strength[m.start()] = 2
    for m in re.finditer(r"(?<=[;:,]\s)(?=\S)|(?<=[)}\]]\s)(?=\S)", text):
        strength[m.start()] = 3
    for m in re.finditer(r"(?<=[.!?…;{}]\s)(?=\S)|(?<=[.!?][\"')]\s)(?=\S)|(?<=;)(?=\S)|(?<=\})(?=\S)", text):
        strength[m.start()] = 4
    declaration = re.compile(_DECLARATION.get(language or "", r"\S"), re.I if language in ("sql", "dockerfile") else 0)
    lines = text.split("\n")
    indents = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    at = 0
    for i, line in enumerate(lines):
        if i:
            s, depth = 6, indents[i]
            before = lines[i - 1].strip()
            if depth < 0:
                s = 5
            else:
                unit = 4 if not line.startswith("\t") else 1
                s += max(0, 5 - depth // unit)
                if before in ("", "}", "},", "};", ")", "];", "end", "done", "fi", "});") or before.endswith(("}", "};")) and depth <= indents[i - 1]:
                    s = 12 + max(0, 2 - depth // unit)
                if not before:
                    s = 14 + max(0, 2 - depth // unit)
                if depth == 0 and (declaration.match(line) or _COMMENT.match(line) and not (before and _COMMENT.match(lines[i - 1]))):
                    s = 22 if not before else 20
                    if before and _COMMENT.match(lines[i - 1]):
                        s = 8  # the comment belongs to the declaration
                elif before and _COMMENT.match(lines[i - 1]) and not _COMMENT.match(line):
                    s = min(s, 7)
            strength[at] = s
        at += len(line) + 1
    for m in re.finditer(r"(?<=\r)(?=\n)|(?=[̀-ͯ​-‏︀-️⁠])", text):
        strength[m.start()] = 0
    return strength


def split_text(text: str, limit: int, overlap_lines: int, language: str | None = None) -> list[tuple[int, int]]:
    """``start, end`` of the pieces: none longer than ``limit`` code points, each starting after the last one's start.

    The cut is the strongest place in the window from half the limit (and from beyond the last cut) to the
    limit. The next piece starts ``overlap_lines`` lines before the cut, unless that many lines would fill
    half a piece or more; then as many whole lines as fit in half of it, or none.
    """
    n, limit = len(text), max(1, limit)
    if n <= limit:
        return [(0, n)]
    table = SparseTable(boundary_strengths(text, language), limit + 1)
    newlines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10)
    pieces, start, last = [], 0, 0
    while n - start > limit:
        lo = max(start + max(1, int(limit * LEAST_FILL)), last + 1)
        cut = table.strongest(min(lo, start + limit), start + limit + 1)
        pieces.append((start, cut))
        last = cut
        # line starts at or before the cut: the piece's own line start counts as the first
        k = int(np.searchsorted(newlines, cut - 1, side="left"))
        begin = cut
        for back in range(1, max(0, overlap_lines) + 1):
            if k - back < 0:
                break
            place = int(newlines[k - back]) + 1
            if place <= start or cut - place > limit // 2:
                break
            begin = place
        start = begin
    pieces.append((start, n))
    return pieces


def split_chunks(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``id, piece_no, pieces, content, start_line, end_line, start_char, end_char, language``: the pieces of oversized chunks.

    A chunk is oversized when its content has more code points than ``max_chars`` of its language in
    ``limits`` (``language, max_chars, overlap_lines``, one row per language; the table is joined, not
    collected). Pieces are numbered from 1; lines are those of the file that the piece touches, a NULL
    ``start_line`` counting as 1. Chunks with a NULL id, content or language, or of a language without a
    limit, are none. Ids delivered twice are split once.
    """
    limits = limits.where("language IS NOT NULL AND max_chars IS NOT NULL").groupBy("language").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_lines").alias("overlap_lines"))
    wide = chunks.select("id", "content", "start_line", "language").where("id IS NOT NULL AND content IS NOT NULL")
    oversized = wide.join(limits, "language").where(F.length("content") > F.col("max_chars")).dropDuplicates(["id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "pieces", "content", "start_line", "end_line", "start_char", "end_char", "language"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for key, text, first, language, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_text(text, limit, overlap or 0, language)
                line_of = np.concatenate(([0], np.cumsum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10)))
                for i, (a, b) in enumerate(pieces):
                    top = (first or 1) + int(line_of[a])
                    # an empty last line belongs to the last piece
                    end = (first or 1) + int(line_of[b if b == len(text) else max(a, b - 1)])
                    rows.append((key, i + 1, len(pieces), text[a:b], top, end, a, b, language))
                    size += b - a
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "id bigint, piece_no int, pieces int, content string, start_line int, end_line int, start_char int, end_char int, language string"
    return oversized.select("id", "content", "start_line", "language", "max_chars", "overlap_lines").mapInArrow(cut, schema)


def oversized_ids(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``id`` of every chunk that was split."""
    return split_chunks(chunks, limits).where("piece_no = 1").select("id")


def replace_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """All rows of ``chunks``, oversized ones replaced by their pieces, with ``piece_no`` (0 for whole chunks).

    Pieces keep the other columns of their chunk; content and lines are their own. A column ``piece_no`` of
    the input is replaced. Rows that ``split_chunks`` does not split stay as they are.
    """
    names = [c for c in chunks.columns if c != "piece_no"]
    pieces = split_chunks(chunks, limits).select("id", "piece_no", "content", "start_line", "end_line")
    most = limits.where("language IS NOT NULL AND max_chars IS NOT NULL").groupBy(F.col("language").alias("_language")).agg(F.min("max_chars").alias("_most"))
    joined = chunks.join(most, F.col("language") == F.col("_language"), "left")
    big = F.coalesce(F.col("id").isNotNull() & (F.length("content") > F.col("_most")), F.lit(False))
    whole = joined.where(~big).select(*names, F.lit(0).alias("piece_no"))
    own = ("content", "start_line", "end_line")
    rest = joined.where(big).select(*(c for c in names if c not in own)).dropDuplicates(["id"])
    return whole.unionByName(rest.join(pieces, "id").select(*names, "piece_no"))
