"""Retrieval evaluation: fixtures, hits within windows, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


def clean_path(c: Column) -> Column:
    """A path with doubled slashes and single dots taken out and no leading ``./``."""
    once = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(once, r"(^|/)(\./)+", "$1"), r"(?<=.)/\.?$", "")


def path_matches(actual: Column, expected: Column) -> Column:
    """Equal, or ending in a slash and the expected path."""
    a, e = clean_path(actual), clean_path(expected)
    return (a == e) | a.endswith(F.concat(F.lit("/"), e))


def expected_targets(queries: DataFrame) -> DataFrame:
    """``query_id, file, start_line, end_line``: one row per target; whole files have no lines."""
    files = queries.select("query_id", F.explode("expected_files").alias("file"))
    files = files.select("query_id", "file", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    chunks = queries.select("query_id", F.explode("expected_chunks").alias("c"))
    return files.union(chunks.select("query_id", "c.file", "c.start_line", "c.end_line"))


def matching_results(results: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of ``results`` (``query_id, rank, file_path, start_line, end_line``) that meet a target of their query.

    Joined on the query; path and line range are checked on the few pairs of a query's results and targets.
    """
    hit = path_matches(F.col("r.file_path"), F.col("t.file"))
    lines = F.col("t.start_line").isNull() | ((F.col("r.start_line") <= F.col("t.end_line")) & (F.col("r.end_line") >= F.col("t.start_line")))
    return results.alias("r").join(targets.alias("t"), (F.col("r.query_id") == F.col("t.query_id")) & hit & lines, "left_semi")


def query_hits(queries: DataFrame, results: DataFrame, windows: tuple[int, ...] = schema.WINDOWS) -> DataFrame:
    """``query_id, hit_<w>...``: whether one of the first ``w`` results meets a target; false without results."""
    best = matching_results(results, expected_targets(queries)).groupBy("query_id").agg(F.min("rank").alias("best"))
    marks = [F.coalesce(F.col("best") <= w, F.lit(False)).alias(f"hit_{w}") for w in windows]
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", *marks)


def hit_rates(hits: DataFrame, windows: tuple[int, ...] = schema.WINDOWS) -> DataFrame:
    """One row: ``queries``, and per window the hits and their percentage (0 without queries)."""
    counts = [F.coalesce(F.sum(F.col(f"hit_{w}").cast("int")), F.lit(0)).cast("bigint").alias(f"hits_{w}") for w in windows]
    total = hits.agg(F.count("*").alias("queries"), *counts)
    rates = [F.when(F.col("queries") > 0, F.round(100.0 * F.col(f"hits_{w}") / F.col("queries"), 1)).otherwise(F.lit(0.0)).alias(f"rate_{w}") for w in windows]
    return total.select("queries", *(f"hits_{w}" for w in windows), *rates)


def describe_targets(files: Column, chunks: Column) -> Column:
    """Expected files, then ``file:start-end`` of expected chunks, in one line."""
    ranges = F.transform(chunks, lambda c: F.format_string("%s:%d-%d", c["file"], c["start_line"], c["end_line"]))
    return F.concat_ws(", ", F.coalesce(files, F.array().cast("array<string>")), F.coalesce(ranges, F.array().cast("array<string>")))


def fixture_violations(queries: DataFrame) -> DataFrame:
    """``position, problem``: the first thing wrong with each query of a fixture (``position`` from 1).

    ``queries`` has ``position, name, query, expected_files, expected_chunks``.
    """
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    files, chunks = F.coalesce("expected_files", F.array().cast("array<string>")), F.col("expected_chunks")
    bad_range = F.exists(chunks, lambda c: (c["start_line"] <= 0) | (c["end_line"] <= 0) | (c["end_line"] < c["start_line"]))
    problem = (
        F.when(blank(F.col("name")), "name is blank")
        .when(blank(F.col("query")), "query is blank")
        .when((F.size(files) == 0) & (F.coalesce(F.size(chunks), F.lit(0)) <= 0), "no expected file or chunk")
        .when(F.exists(files, blank), "an expected file is blank")
        .when(F.exists(chunks, lambda c: blank(c["file"])), "an expected chunk has no file")
        .when(bad_range, "an expected chunk has no valid line range")
    )
    return queries.select("position", problem.alias("problem")).where("problem IS NOT NULL")
