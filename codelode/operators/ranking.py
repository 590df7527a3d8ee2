"""Hybrid ranking of candidates and thinning of the ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.classify import is_actionable, is_build_artifact
from ..functions.text import base_name, overlap_ratio, rank_tokens, trim_space
from ..session import durable
from ..sources.tables import roughly_in


def hybrid_score(query: Column, base: Column, path: Column, category: Column, content: Column) -> Column:
    """The base score with what the words, the path and the kind of chunk add or take."""
    phrase, low_path, low_text = F.lower(trim_space(query)), F.lower(path), F.lower(content)
    name = F.lower(base_name(path))
    asked = rank_tokens(query)
    exact = (phrase != "") & (F.contains(low_text, phrase) | F.contains(low_path, phrase))
    return (
        base
        + F.when(exact, schema.EXACT_PHRASE).otherwise(0.0)
        + overlap_ratio(asked, rank_tokens(F.concat_ws(" ", low_path, name, low_text))) * schema.TOKEN_OVERLAP
        + overlap_ratio(asked, rank_tokens(name)) * schema.FILE_NAME
        + F.when(is_actionable(category, content), schema.ACTIONABLE).otherwise(0.0)
        - F.when(is_build_artifact(path), schema.BUILD_ARTIFACT).otherwise(0.0)
    )


def rerank(candidates: DataFrame, query: Column, by: list[str]) -> DataFrame:
    """The candidates with ``base_score`` (their ``score`` so far), ``score`` and ``position`` within ``by``."""
    scored = candidates.withColumnRenamed("score", "base_score")
    scored = scored.withColumn("score", hybrid_score(query, F.col("base_score"), F.col("file_path"), F.col("category"), F.col("content")))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), F.desc(F.round("base_score", 9)), "id")
    return scored.withColumn("position", F.row_number().over(order))


def thin_out(ranked: DataFrame, by: list[str], limit: int = schema.RESULTS) -> DataFrame:
    """At most two chunks of a file, not within 12 lines of each other; ``rank`` numbers what is kept up to ``limit``.

    The best chunk of a file stays; of the others of that file the best that does not touch it. Going
    through the list from the top and dropping what touches a kept chunk gives the same.
    """
    file = [*by, "file_path"]
    first = Window.partitionBy(*file).orderBy("position")
    lead = ranked.withColumn("lead", F.first(F.struct("start_line", "end_line", "position")).over(first))
    apart = (F.col("start_line") > F.col("lead.end_line") + schema.SLACK_LINES) | (F.col("lead.start_line") > F.col("end_line") + schema.SLACK_LINES)
    eligible = lead.where((F.col("position") == F.col("lead.position")) | apart)
    kept = eligible.withColumn("in_file", F.row_number().over(first)).where(F.col("in_file") <= schema.PER_FILE)
    numbered = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("position"))).drop("lead", "in_file", "position")
    return numbered.where(F.col("rank") <= limit) if limit > 0 else numbered


def ranked_candidates(chunks: DataFrame, queries: DataFrame, candidates: int = schema.CANDIDATES) -> DataFrame:
    """The most similar chunks of each query, reranked: ``query_id, id, ..., base_score, score, position``.

    ``queries`` has ``query_id, project, query, vector``. The chunks' own columns are joined back only for
    the candidates.
    """
    from .search import batch_topk, semantic_rows

    top = durable(batch_topk(chunks, queries, candidates).drop("rank"))  # a few rows per query
    text = semantic_rows(chunks).select("id", "file_path", "start_line", "end_line", "language", "category", "content")
    wanted = top.select("id").distinct()
    text = roughly_in(text, wanted, ["id"]).join(wanted, "id", "left_semi").dropDuplicates(["id"])
    asked = queries.select("query_id", "query")
    # the scores are dear for their bytes: as many tasks as for large data, and the window goes by the same key
    spark = chunks.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = top.join(text, "id").join(asked, "query_id").repartition(parts, "query_id")
    return rerank(placed, F.col("query"), ["query_id"]).drop("query")


def hybrid_search(chunks: DataFrame, queries: DataFrame, limit: int = schema.RESULTS, candidates: int = schema.CANDIDATES) -> DataFrame:
    """``query_id, rank, id, file_path, start_line, end_line, language, category, content, base_score, score`` per query."""
    return thin_out(ranked_candidates(chunks, queries, candidates), ["query_id"], limit)
