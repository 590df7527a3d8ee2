"""Vector and substring search over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.classify import category_or_default, is_semantic
from ..functions.text import like_ascii
from ..functions.vectors import cosine
from ..session import durable

#: Rows of a block of vectors, and queries that meet it at once.
BLOCK_ROWS, QUERY_ROWS = 32_768, 256
#: Bytes of query vectors that are sent to every task at most, and values of the key that are named in a filter at most.
BROADCAST_BYTES, MOST_VALUES = 16 << 20, 1_000


def semantic_rows(chunks: DataFrame, dimensions: int | None = None) -> DataFrame:
    """The chunks that semantic search looks at, with their read-time category.

    They have a vector (of ``dimensions`` elements, if given) and are neither documentation nor metadata.
    """
    rows = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(is_semantic(F.col("category")))
    if dimensions is not None:
        rows = rows.where(F.size("embedding") == dimensions)
    return rows.withColumn("category", category_or_default(F.col("category"), F.col("language")))


def semantic_topk(chunks: DataFrame, vector: list[float], k: int = schema.CANDIDATES) -> DataFrame:
    """The ``k`` rows most similar to a vector, with ``score``; ties go to the smaller id; all rows if ``k`` <= 0."""
    asked = F.array(*(F.lit(float(x)) for x in vector))
    scored = semantic_rows(chunks, len(vector)).withColumn("score", cosine(F.col("embedding"), asked)).drop("embedding")
    ordered = scored.orderBy(F.desc("score"), "id")
    return ordered.limit(k) if k > 0 else ordered


def unique_topk(chunks: DataFrame, vector: list[float], k: int = schema.CANDIDATES) -> DataFrame:
    """As ``semantic_topk``, but ``k`` different ids, whatever is delivered several times.

    Ids and vectors alone are scanned first, each task keeping its best ``k``; the other columns are read for the ids found.
    """
    rows = semantic_rows(chunks, len(vector)).select(F.lit(0).alias("by"), "id", F.col("embedding").cast("array<float>").alias("v"))
    asked = chunks.sparkSession.createDataFrame([(0, 0, [float(x) for x in vector])], "by int, id bigint, v array<float>")
    found = _meet_scan(rows, asked, k, "by").groupBy("id").agg(F.max("score").alias("score"))
    top = durable(found.orderBy(F.desc(F.round("score", 9)), "id").limit(k))
    ids = [r["id"] for r in top.select("id").collect()]  # at most ``k``
    texts = semantic_rows(chunks, len(vector)).drop("embedding").where(F.col("id").isin(ids)).dropDuplicates(["id"])
    return texts.join(F.broadcast(top), "id").orderBy(F.desc("score"), "id")


class _Best:
    """The best ``k`` ids of each query so far, ties to the smaller id; scores equal to nine places count as ties."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > self.k:
            worst = np.partition(scores, -self.k)[-self.k]
            near = scores >= worst - 1e-8
            ids, scores = ids[near], scores[near]
        old = self.kept.get(query)
        if old is not None:
            ids, scores = np.concatenate((old[0], ids)), np.concatenate((old[1], scores))
        ids, at = np.unique(ids, return_index=True)
        order = np.lexsort((ids, -np.round(scores[at], 9)))[: self.k]
        self.kept[query] = ids[order], scores[at][order]

    def table(self) -> pa.Table:
        sizes = [len(ids) for ids, _ in self.kept.values()]
        flat = [np.concatenate(a) if a else np.empty(0, t) for a, t in (([i for i, _ in self.kept.values()], np.int64), ([s for _, s in self.kept.values()], np.float64))]
        query = np.repeat(np.fromiter(self.kept, np.int64, len(self.kept)), sizes)
        return pa.table({"query_id": pa.array(query, pa.int64()), "id": pa.array(flat[0], pa.int64()), "score": pa.array(flat[1], pa.float64())})


def _score_into(best: _Best, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Cosines of the queries ``q`` and the vectors ``x`` in double precision, 0 where a length is 0."""
    ids, at = np.unique(ids, return_index=True)  # rows delivered twice count once
    x = x[at]
    q, x = q.astype(np.float64), x.astype(np.float64)
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    for i in range(0, len(q), QUERY_ROWS):
        lengths = q_norm[i : i + QUERY_ROWS, None] * x_norm
        s = np.divide(q[i : i + QUERY_ROWS] @ x.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
        for r in range(len(s)):
            best.add(int(query_ids[i + r]), ids, s[r])


def _sized(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the vectors of a list column, and its flat values from the first one's on."""
    offsets = np.asarray(vectors.offsets)
    return np.diff(offsets), np.asarray(vectors.values)[offsets[0] : offsets[-1]]


def batch_topk(chunks: DataFrame, queries: DataFrame, k: int = schema.CANDIDATES, by: str = "project") -> DataFrame:
    """``query_id, id, score, rank``: for each query the ``k`` most similar chunks with the same ``by`` value.

    ``queries`` has ``query_id``, ``by`` and ``vector``. Queries of at most ``BROADCAST_BYTES`` of vectors are sent to
    all tasks of the scan, which keep the best of each query and shuffle no vector. More of them meet the chunks of
    their ``by`` value in blocks of about ``BLOCK_ROWS``, so a value that holds much of the table is many tasks. Scores
    are in double precision.
    """
    rows = semantic_rows(chunks).select(by, "id", F.col("embedding").cast("array<float>").alias("v"))
    wanted = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select(by, F.col("query_id").alias("id"), F.col("vector").cast("array<float>").alias("v"))
    wanted = durable(wanted)
    size = wanted.agg(F.sum(F.size("v") * 4 + 64)).first()[0] or 0
    found = _meet_scan(rows, wanted, k, by) if size <= BROADCAST_BYTES else _meet_blocks(rows, wanted, k, by)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # of rows delivered twice, to two tasks
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "query_id bigint, id bigint, score double"


def _meet_scan(rows: DataFrame, wanted: DataFrame, k: int, by: str) -> DataFrame:
    asked: dict = {}
    for r in wanted.collect():  # at most BROADCAST_BYTES
        asked.setdefault(r[by], {}).setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    asked = {key: {n: (np.array([i for i, _ in found], np.int64), np.array([v for _, v in found], np.float32)) for n, found in sizes.items()} for key, sizes in asked.items()}
    known = rows.sparkSession.sparkContext.broadcast(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code, (sizes, flat) = np.asarray(keys.indices.fill_null(-1)), _sized(batch.column(2))
            ids, start = np.asarray(batch.column(1)), np.cumsum(sizes) - sizes
            for i, key in enumerate(keys.dictionary.to_pylist()):
                for n, (query_ids, q) in known.value.get(key, {}).items():
                    at = np.flatnonzero((code == i) & (sizes == n))
                    if len(at):
                        _score_into(best, query_ids, q, ids[at], flat[start[at, None] + np.arange(n)])
        yield from best.table().to_batches()

    mine = rows.where(F.col(by).isin([x for x in asked if x is not None])) if len(asked) <= MOST_VALUES else rows
    return mine.mapInArrow(score, _FOUND)


def _meet_blocks(rows: DataFrame, wanted: DataFrame, k: int, by: str) -> DataFrame:
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    index = rows.join(wanted.select(by).distinct(), by, "left_semi").join(blocks, by)
    index = index.select(by, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    ask = wanted.join(blocks, by).select(by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def score(table: pa.Table) -> pa.Table:
        table, best = table.combine_chunks(), _Best(k)
        asks, ids, v = np.asarray(table.column("asks")), np.asarray(table.column("id")), table.column("v").combine_chunks()
        sizes, flat = _sized(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
        start = np.cumsum(sizes) - sizes
        for n in np.unique(sizes[asks]).tolist():
            at_q, at_x = np.flatnonzero(asks & (sizes == n)), np.flatnonzero(~asks & (sizes == n))
            if len(at_x):
                q, x = (flat[start[at, None] + np.arange(n)] for at in (at_q, at_x))
                _score_into(best, ids[at_q], q, ids[at_x], x)
        return best.table()

    return index.union(ask).groupBy(by, "block").applyInArrow(score, _FOUND)


def text_search(chunks: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Chunks of any category whose content holds the query, ASCII letters alike; by id; all if ``limit`` <= 0."""
    rows = chunks.where(like_ascii(F.col("content"), query)).drop("embedding")
    rows = rows.withColumn("category", category_or_default(F.col("category"), F.col("language"))).withColumn("score", F.lit(0.0))
    ordered = rows.orderBy("id")
    return ordered.limit(limit) if limit > 0 else ordered
