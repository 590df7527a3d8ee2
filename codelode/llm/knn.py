"""The most similar vectors for every vector: a block matrix join with int8 product tiles.

Vectors are routed to cells around centroids fitted on a bounded sample: one level of centroids, and beyond
``MAX_CENTRES`` cells a second level, fitted on what the first leaves over, within each. Every vector is indexed
in its best cell and asks in all whose score comes within ``MARGIN`` of the best, up to ``PROBES``. In a cell the
product of a query block and an index block is taken over int8 codes; each code carries its quantisation error,
so that the tile gives bounds of every cosine. Pairs whose upper bound stays below what a query already holds are
dropped, the others are recomputed in float64 and go through a bounded heap per query. The heaps of the probed
cells are merged by a top-k that Spark trims before its shuffle.

Identical vectors are one class with one representative in the tiles, so a group of copies that holds a
third of all rows costs as much as one row; cells that turn out large are cut into blocks on either side, each
pair of blocks being its own group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from ..sources.tables import spread

#: Rows that the centroids are fitted on, at most, and centroids of a level, at most: 2 MB of float32 at 64 elements.
FIT_ROWS = 65_536
MAX_CENTRES = 8_192
#: Vectors a cell should hold, and the most rows of either side that meet in one group.
CELL_ROWS = 512
BLOCK_ROWS = 8_192
#: Cells that a vector asks at most, and at least; how far behind the best one's the others' scores may be; cells of
#: the first level in which those of the second are looked for.
PROBES, LEAST_PROBES, MARGIN, BEAM = 16, 2, 0.045, 8
#: Bytes of a routed row, about, and those that one shuffle partition should hold.
ROW_BYTES, PART_BYTES = 300, 32 << 20
TILE = 1_024


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The rows of a binary column of float32 vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if len(column) else 0
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[start : start + len(column) * dim * 4]
    return data.view(np.float32).reshape(-1, dim) if data.ctypes.data % 4 == 0 else np.frombuffer(data.tobytes(), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in [-127, 127] (kept as float32, in which their products are exact), scales, error norms."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    code = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - code * scale[:, None], axis=1)
    return code.astype(np.float32), scale.astype(np.float32), error.astype(np.float32)


def nearest_in_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: float) -> tuple[list, list, list]:
    """For each query its ``k`` nearest of ``x`` with cosine >= ``floor``, itself left out; ties go to the smaller id.

    ``x`` and ``q`` are unit vectors. The result is exact: a pair is dropped only when the upper bound of
    its cosine is below the floor or below the lower bounds of ``k`` others of the tile.
    """
    xc, xs, xe = quantise(x)
    qc, qs, qe = quantise(q)
    out_q, out_n, out_s = [], [], []
    for a in range(0, len(q), TILE):
        rows = slice(a, min(a + TILE, len(q)))
        heaps: list[list] = [[] for _ in range(rows.stop - a)]
        held = np.full(rows.stop - a, floor, dtype=np.float32)
        for b in range(0, len(x), TILE):
            cols = slice(b, min(b + TILE, len(x)))
            about = (qc[rows] @ xc[cols].T) * xs[cols] * qs[rows, None]
            # |a.b - a'.b'| <= |a - a'| |b| + |a'| |b - b'|, and |a'| <= 1 + |a - a'|; the rest is rounding
            slack = qe[rows, None] + (1 + qe[rows, None]) * xe[cols] + 1e-5
            if floor <= -1 and about.shape[1] > k + 1:
                low = about - slack
                held = np.maximum(held, np.partition(low, -(k + 1), axis=1)[:, -(k + 1)])
            i, j = np.nonzero(about + slack >= held[:, None])
            keep = query_ids[a + i] != ids[b + j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", q[a + i], x[b + j])
            for r, s, n in zip(i.tolist(), exact.tolist(), ids[b + j].tolist()):
                if s >= floor:
                    entry, heap = (s, -n), heaps[r]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            for r in np.unique(i).tolist():
                if len(heaps[r]) == k:
                    held[r] = max(held[r], heaps[r][0][0])
        for r, heap in enumerate(heaps):
            for s, n in heap:
                out_q.append(int(query_ids[a + r]))
                out_n.append(-n)
                out_s.append(s)
    return out_q, out_n, out_s


def usable_vectors(df: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id, vec, h``: rows with an id and a vector of ``dim`` finite elements that are not all zero.

    ``vec`` holds the float32 elements as bytes, ``h`` a hash that is equal for equal vectors. Rows
    delivered twice stay twice; later steps count an id once.
    """
    good = (F.size(vector_col) == dim) & ~F.exists(vector_col, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(good)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float32).reshape(-1, dim)
            keep = np.flatnonzero((x != 0).any(axis=1))
            x = np.ascontiguousarray(x[keep])
            flat = pa.array(x.view(f"V{dim * 4}").ravel().tolist(), type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), flat], ["id", "vec"])

    return spread(rows).mapInArrow(pack, "id bigint, vec binary").withColumn("h", F.xxhash64("vec"))


def _means(x: np.ndarray, centres: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros_like(centres)
    np.add.at(sums, near, x)
    return sums, np.bincount(near, minlength=len(centres))[:, None]


def fit_cells(vectors: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and, for each part of their cells, what is added to them (one row of zeros for no parts).

    Fitted on a sample of at most ``FIT_ROWS`` rows; ``n`` rows give about ``n / CELL_ROWS`` cells and parts.
    """
    cells = max(1, n // CELL_ROWS)
    keep = max(1, round(n / FIT_ROWS * 0.97)) if n > FIT_ROWS else 1
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(keep)) == 0).select("id", "vec").limit(FIT_ROWS)
    got = sample.toArrow()
    order = np.argsort(np.asarray(got.column(0)), kind="stable")
    x = _unit(_matrix(got.column(1), dim)[order]).astype(np.float32)
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(cells, MAX_CENTRES, len(x)), replace=False)]
    for _ in range(3):
        sums, _n = _means(x, centres, _nearest(x, centres))
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
    parts = min(-(-cells // len(centres)), MAX_CENTRES, len(x)) if cells > len(centres) else 1
    if parts == 1:
        return centres, np.zeros((1, dim), np.float32)
    left = x - centres[_nearest(x, centres)]
    shifts = left[rng.choice(len(left), parts, replace=False)]
    for _ in range(5):
        sums, count = _means(left, shifts, _nearest(left, shifts, (shifts * shifts).sum(axis=1) / 2))
        shifts = np.where(count > 0, sums / np.maximum(count, 1), shifts).astype(np.float32)
    return centres, shifts


def _nearest(x: np.ndarray, centres: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    return np.concatenate([(x[i : i + TILE] @ centres.T - less).argmax(axis=1) for i in range(0, len(x), TILE)])


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest scores of each row, greatest first."""
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable"), axis=1)


def routes(unit: np.ndarray, centres: np.ndarray, shifts: np.ndarray, probes: int = PROBES, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, home``: the cells that each row asks, the best of which is its home."""
    rows, cells, homes = [], [], []
    beam = min(BEAM, len(centres)) if len(shifts) > 1 else len(centres)
    base = (centres * centres).sum(axis=1) / 2
    if len(shifts) > 1:
        mixed = centres @ shifts.T + (shifts * shifts).sum(axis=1) / 2
    step = max(16, min(TILE, (4 << 20) // (beam * len(shifts))))
    for at in range(0, len(unit), step):
        x = unit[at : at + step]
        score, cell = x @ centres.T - base, None
        if len(shifts) > 1:
            cell = _top(score, beam)
            two = np.take_along_axis(score, cell, axis=1)[:, :, None] + (x @ shifts.T)[:, None, :] - mixed[cell]
            cell = (cell[:, :, None] * len(shifts) + np.arange(len(shifts))).reshape(len(x), -1)
            score = two.reshape(len(x), -1)
        best = _top(score, min(probes, score.shape[1]))
        value = np.take_along_axis(score, best, axis=1)
        value[:, :LEAST_PROBES] = value[:, :1]
        r, j = np.nonzero(value >= value[:, :1] - margin)
        rows.append(at + r), homes.append(j == 0)
        cells.append(best[r, j] if cell is None else np.take_along_axis(cell, best, axis=1)[r, j])
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64), np.concatenate(homes)


def _route(vectors: DataFrame, dim: int, n: int, probes: int, margin: float) -> DataFrame:
    """``cell, ib, qb, asks, indexed, id, vec``: each row where it is indexed and where it asks.

    The sizes of cells are counted; those of more than ``BLOCK_ROWS`` rows become a grid of blocks, joined by
    cell: of such cells there is less than one in ``BLOCK_ROWS / PROBES`` vectors, and Spark chooses how to join.
    """
    known = vectors.sparkSession.sparkContext.broadcast(fit_cells(vectors, dim, n))  # at most 2 x MAX_CENTRES vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cell, home = routes(_unit(_matrix(batch.column(0), dim)).astype(np.float32), *known.value, probes, margin)
                cells, where = np.unique(cell, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(where[home], minlength=len(cells))), pa.array(np.bincount(where, minlength=len(cells)))], ["cell", "indexed", "asks"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell, home = routes(_unit(_matrix(batch.column(1), dim)).astype(np.float32), *known.value, probes, margin)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "indexed", "id", "vec"])

    sizes = vectors.select("vec").mapInArrow(count, "cell bigint, indexed bigint, asks bigint").groupBy("cell").agg(F.sum("indexed").alias("x"), F.sum("asks").alias("q"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK_ROWS), F.lit(1)).cast("int")
    large = durable(sizes.where(f"x > {BLOCK_ROWS} OR q > {BLOCK_ROWS}").select("cell", blocks("x").alias("nx"), blocks("q").alias("nq")))
    routed = vectors.select("id", "vec").mapInArrow(route, "cell bigint, indexed boolean, id bigint, vec binary").join(large, "cell", "left")
    own = lambda salt, number: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(number)).cast("int")
    spot = lambda ib, qb, asks, indexed: F.struct(ib.alias("ib"), qb.alias("qb"), asks.alias("asks"), indexed.alias("indexed"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    asking = F.transform(F.sequence(zero, F.col("nx") - 1), lambda i: spot(i, own(1, "nq"), yes, no))
    held = F.when(F.col("indexed"), F.transform(F.sequence(zero, F.col("nq") - 1), lambda i: spot(own(2, "nx"), i, no, yes))).otherwise(F.filter(asking, lambda _: no))
    spots = F.when(F.col("nx").isNull(), F.array(spot(zero, zero, yes, F.col("indexed")))).otherwise(F.concat(asking, held))
    return routed.select("cell", F.explode(spots).alias("s"), "id", "vec").select("cell", "s.*", "id", "vec")


def _tiles(routed: DataFrame, dim: int, k: int, floor: float, rows: int) -> DataFrame:
    """``query, id, cosine`` of the best ``k`` of every query in every block it asks; ``rows`` is about their number."""

    def tile(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"))
        asks, indexed = np.asarray(table.column("asks")), np.asarray(table.column("indexed"))
        unit = _unit(_matrix(table.column("vec"), dim))
        at_x, at_q = np.flatnonzero(indexed), np.flatnonzero(asks)
        at_x = at_x[np.unique(ids[at_x], return_index=True)[1]]
        at_q = at_q[np.unique(ids[at_q], return_index=True)[1]]
        got = nearest_in_block(ids[at_x], unit[at_x], ids[at_q], unit[at_q], k, floor)
        return pa.table({"query": pa.array(got[0], pa.int64()), "id": pa.array(got[1], pa.int64()), "cosine": pa.array(got[2], pa.float64())})

    parts = max(int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * ROW_BYTES // PART_BYTES))
    placed = routed.repartition(parts, "cell", "ib", "qb")
    return placed.groupBy("cell", "ib", "qb").applyInArrow(tile, "query bigint, id bigint, cosine double")


def _best(neighbours: DataFrame, k: int) -> DataFrame:
    """The heaps of several blocks merged: the best ``k`` of each query, ties to the smaller id."""
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return neighbours.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(df: DataFrame, k: int = 10, floor: float = -1.0, dim: int = 64, probes: int = PROBES, margin: float = MARGIN, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``query, id, cosine, rank``: up to ``k`` most similar vectors of every vector, of cosine >= ``floor``.

    Rows whose vector is NULL, empty, of another length, all zero or not finite, and rows without id, take
    no part. Repeated ids count once; equal vectors are neighbours with cosine 1. Ties go to the smaller
    id. An empty table gives an empty result. Approximate only in the routing: a neighbour is missed if it
    lies in none of the cells that the query asks.
    """
    vectors = durable(usable_vectors(df, dim, id_col, vector_col))
    n = vectors.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "query bigint, id bigint, cosine double, rank int")
    classes = vectors.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    several = classes.where("rep < last")
    member = vectors.select("id", "h").distinct().join(several, "h").select("id", "rep")
    copies = member.where("id <> rep").select("id")
    routed = _route(vectors.join(copies, "id", "left_anti"), dim, n, probes, margin)
    found = _tiles(routed, dim, k, floor, 5 * n)
    # what one of two vectors finds counts for the other, too
    both = F.array(F.struct("query", "id"), F.struct(F.col("id").alias("query"), F.col("query").alias("id")))
    found = found.select(F.explode(both).alias("p"), "cosine").select("p.*", "cosine")
    first = _best(found.distinct(), k).drop("rank")
    first = durable(first)
    # classes of copies: a class stands for its k + 1 smallest members, in every list that names it and its own
    some = member.withColumn("m", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("m") <= k + 1)
    some = some.select(F.col("rep").alias("id"), F.col("id").alias("of"))
    own = several.where(F.lit(1.0 >= floor)).select(F.col("rep").alias("query"), F.col("rep").alias("id"), F.lit(1.0).alias("cosine"))
    lists = first.union(own).join(some, "id", "left").select("query", F.coalesce("of", "id").alias("id"), "cosine")
    lists = _best(lists, k + 1).drop("rank")
    askers = member.select(F.col("rep").alias("query"), F.col("id").alias("asker"))
    every = lists.join(askers, "query", "left").select(F.coalesce("asker", "query").alias("query"), "id", "cosine")
    return _best(every.where("query <> id"), k)


def neighbours_of_all(df: DataFrame, k: int = 10, floor: float = 0.92, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``size, query, id, cosine, rank``: as ``nearest_neighbours``, vectors of every length among those of their length.

    The lengths that occur come to the driver; there are as many as embedding models.
    """
    sizes = [r[0] for r in df.where(F.size(vector_col) > 0).select(F.size(vector_col)).distinct().collect()]
    found = [nearest_neighbours(df, k, floor, size, id_col=id_col, vector_col=vector_col).select(F.lit(size).alias("size"), "query", "id", "cosine", "rank") for size in sorted(sizes)]
    out = found[0] if found else df.sparkSession.createDataFrame([], "size int, query bigint, id bigint, cosine double, rank int")
    for more in found[1:]:
        out = out.union(more)
    return out


def similar_pairs(df: DataFrame, k: int = 10, floor: float = 0.92, dim: int = 64, probes: int = PROBES) -> DataFrame:
    """``id_a, id_b``: pairs of cosine >= ``floor``, one of which is among the ``k`` most similar of the other."""
    near = nearest_neighbours(df, k, floor, dim, probes)
    return near.select(F.least("query", "id").alias("id_a"), F.greatest("query", "id").alias("id_b")).distinct()


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """``query, id, cosine, rank`` of a stated query set against all rows, without routing; NULLs and ties as above.

    The rows are cut into blocks of ``BLOCK_ROWS``, which every block of queries visits.
    """
    vectors, asked = usable_vectors(df, dim).select("id", "vec"), usable_vectors(queries, dim).select("id", "vec")
    vectors = durable(vectors)
    n = vectors.count()
    blocks = max(1, -(-n // (4 * BLOCK_ROWS)))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, blocks // 50))).cast("int")
    parts = max(1, blocks // 50)
    index = vectors.select(part.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("ib"), F.lit(0).alias("qb"), F.lit(False).alias("asks"), F.lit(True).alias("indexed"), "id", "vec")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cell"), query_part.alias("ib"), F.lit(0).alias("qb"), F.lit(True).alias("asks"), F.lit(False).alias("indexed"), "id", "vec")
    return _best(_tiles(index.union(ask), dim, k, -1.0, n * (parts + 1)), k)
