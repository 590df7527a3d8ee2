"""Files cut into line-ranged chunks: ``file_path, language, chunk_no, start_line, end_line, content``.

Tumbling lines and boundary-to-boundary chunks are array expressions without a shuffle. Blocks between braces
are read off running sums over a file's lines, on Arrow batches and also without a shuffle. A ``project`` of the
files is kept, before ``file_path``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.enrich import is_boundary
from ..functions.text import lines_of, trim_space

_CHUNK = "array<struct<start_line: int, end_line: int, content: string>>"
BOUNDARY_LANGUAGES = ["python", "java", "shell", "markdown"]


def _piece(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start .. end``, 1-based and inclusive, as a chunk."""
    text = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), text.alias("content"))


def tumbling(lines: Column, size: int = schema.MAX_LINES) -> Column:
    """Chunks of ``size`` lines, the last one shorter; none for no lines."""
    n = F.size(lines)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size)))
    pieces = F.transform(starts, lambda s: _piece(lines, s, F.least(s + size - 1, n)))
    return F.coalesce(pieces, F.array().cast(_CHUNK))


def boundary_starts(lines: Column, language: Column) -> Column:
    """The numbers of the lines that begin a block, in order; the lines are trimmed and judged once each."""
    flags = F.transform(lines, lambda x, i: F.when(is_boundary(trim_space(x), language), i + 1))
    return F.array_compact(flags)


def boundary_to_boundary(lines: Column, starts: Column, size: int = schema.MAX_LINES) -> Column:
    """A chunk from each start to before the next one, after one with all lines before the first.

    Without any start the lines are tumbled. ``lines`` and ``starts`` are to be columns, not expressions, as
    both are read once for every chunk.
    """
    n, count, first = F.size(lines), F.size(starts), F.get(starts, 0)
    blocks = F.transform(starts, lambda s, k: _piece(lines, s, F.when(k + 1 < count, F.get(starts, k + 1) - 1).otherwise(n)))
    prelude = F.when(first > 1, F.array(_piece(lines, F.lit(1), first - 1))).otherwise(F.array().cast(_CHUNK))
    return F.when(count > 0, F.concat(prelude, blocks)).otherwise(tumbling(lines, size))


# ---- blocks between braces -------------------------------------------------------------------------------
def _python_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


_GO = _python_pattern(schema.GO_FUNCTION.replace(r"\s", r"[\t\n\f\r ]"))
_JS = _python_pattern(schema.boundary_pattern("javascript"))
#: What shows that an expression has begun on a line, and what the last line of one ends with.
EXPRESSION_WORDS = ["=", "function", "class "]
EXPRESSION_ENDS = [";", ")", ">"]


def _lines_where(flags: Iterable[bool]) -> np.ndarray:
    return np.flatnonzero(np.fromiter(flags, dtype=bool))


def _next(places: np.ndarray, line: int, none: int) -> int:
    """The first of the sorted places at or after a line."""
    k = int(np.searchsorted(places, line))
    return int(places[k]) if k < len(places) else none


def _running(lines: list[str], bracket: str) -> np.ndarray:
    """How many more brackets of a kind have been opened than closed before each line, and after the last."""
    return np.cumsum([0, *(x.count(bracket[0]) - x.count(bracket[1]) for x in lines)])


def _first_level(depth: np.ndarray, level: int, places: np.ndarray, none: int) -> int:
    """The first of the places behind whose line ``depth`` is at most ``level``; looked for in ever wider windows."""
    at, width = 0, 16
    while at < len(places):
        here = places[at : at + width]
        low = depth[here + 1] <= level
        if low.any():
            return int(here[low.argmax()])
        at, width = at + width, 2 * width
    return none


class Outline:
    """A file's lines as sums and sorted places, of which the last line of the block that begins on a line is read off."""

    def __init__(self, lines: list[str], language: str):
        bare = [x.strip() for x in lines]
        self.n, self.lines = len(lines), np.arange(len(lines))
        self.starts = _lines_where(bool((_GO if language == "go" else _JS).search(x)) for x in bare)
        self.braces, self.open_lines = _running(lines, "{}"), _lines_where("{" in x for x in lines)
        self.expressions = language != "go"
        if self.expressions and len(self.starts):
            self.parens = _running(lines, "()")
            self.words = _lines_where(any(w in x for w in EXPRESSION_WORDS) for x in lines)
            self.ends = _lines_where(not x or x.endswith(tuple(EXPRESSION_ENDS)) for x in bare)

    def last_line(self, start: int) -> int:
        """Where the braces opened from ``start`` on are closed again, or the last line.

        Expressions may end before any brace: on their last line, at balanced parentheses, or before the line
        on which another block starts.
        """
        brace = _next(self.open_lines, start, self.n)
        if self.expressions:
            other = _next(self.starts, start + 1, self.n)
            begin = max(start, _next(self.words, start, self.n))
            within = self.ends[np.searchsorted(self.ends, begin) : np.searchsorted(self.ends, min(brace, other + 1))]
            end = _first_level(self.parens, self.parens[start], within, self.n)
            if min(end, other) < brace:
                return end if end <= other else other - 1
        return min(_first_level(self.braces, self.braces[start], self.lines[brace:], self.n), self.n - 1)

    def blocks(self) -> list[tuple[int, int]]:
        """First and last line, from 0, of each block; a start within a block begins none."""
        out, at = [], _next(self.starts, 0, self.n)
        while at < self.n:
            out.append((at, self.last_line(at)))
            at = _next(self.starts, out[-1][1] + 1, self.n)
        return out


def brace_blocks(lines: list[str], language: str, size: int = schema.MAX_LINES) -> list[tuple[int, int, str]]:
    """Blocks of a file as ``start_line, end_line, content``, after one chunk with every line outside of them.

    That chunk is said to reach from line 1 to the last of its lines, so it may span blocks. Without any
    block the lines are tumbled.
    """
    spans = Outline(lines, language).blocks()
    if not spans:
        return [(s + 1, min(s + size, len(lines)), "\n".join(lines[s : s + size])) for s in range(0, len(lines), size)]
    outside = np.ones(len(lines), dtype=bool)
    for a, b in spans:
        outside[a : b + 1] = False
    rest = np.flatnonzero(outside).tolist()
    head = [(1, rest[-1] + 1, "\n".join(lines[i] for i in rest))] if rest else []
    return head + [(a + 1, b + 1, "\n".join(lines[a : b + 1])) for a, b in spans]


def split_lines(text: str) -> list[str]:
    """The lines of a text: any line end, and no empty line after the last one."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _keys(files: DataFrame) -> list[str]:
    return [c for c in ("project", "file_path", "language") if c in files.columns]


def _with_lines(files: DataFrame) -> DataFrame:
    return files.where("content IS NOT NULL").select(*_keys(files), lines_of(F.col("content")).alias("lines"))


def _with_pieces(files: DataFrame, pieces: Column) -> DataFrame:
    exploded = files.select(*_keys(files), F.posexplode(pieces).alias("chunk_no", "piece"))
    return exploded.select(*_keys(files), "chunk_no", "piece.start_line", "piece.end_line", "piece.content")


def brace_chunks(files: DataFrame, size: int = schema.MAX_LINES) -> DataFrame:
    """Chunks of Go and JavaScript-family files, by braces."""
    keys = _keys(files)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_no", "start_line", "end_line", "content"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            source, rows = [], []
            for row, (language, content) in enumerate(zip(batch.column("language").to_pylist(), batch.column("content").to_pylist())):
                for k, piece in enumerate(brace_blocks(split_lines(content), language, size)):
                    source.append(row)
                    rows.append((k, *piece))
            cols = list(zip(*rows)) or [[]] * 4
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(pa.array(c, t) for c, t in zip(cols, kinds))], [*keys, *names])

    schema_ = ", ".join(f"{c} string" for c in keys) + ", chunk_no int, start_line int, end_line int, content string"
    return files.select(*keys, "content").where("content IS NOT NULL").mapInArrow(cut, schema_)


def line_chunks(files: DataFrame, size: int = schema.MAX_LINES) -> DataFrame:
    """Tumbling chunks of all files, whatever their language."""
    return _with_pieces(_with_lines(files), tumbling(F.col("lines"), size))


def boundary_chunks(files: DataFrame, size: int = schema.MAX_LINES) -> DataFrame:
    """Boundary-to-boundary chunks of all files."""
    staged = _with_lines(files).withColumn("starts", boundary_starts(F.col("lines"), F.col("language")))
    return _with_pieces(staged, boundary_to_boundary(F.col("lines"), F.col("starts"), size))


def chunk_files(files: DataFrame, size: int = schema.MAX_LINES) -> DataFrame:
    """Chunks of files ``file_path, language, content``, each language by its way. Empty files have none.

    Rows without content or language give nothing. The input is read once per way.
    """
    known = files.where("content IS NOT NULL AND language IS NOT NULL")
    braces, bounds = F.col("language").isin("go", *schema.JS_FAMILY), F.col("language").isin(BOUNDARY_LANGUAGES)
    return brace_chunks(known.where(braces), size).union(boundary_chunks(known.where(bounds), size)).union(line_chunks(known.where(~braces & ~bounds), size))
