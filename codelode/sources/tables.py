"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of part files."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` on as many tasks as there are cores, if the scan gives fewer; else as they are.

    For costly work per row over a table of few, unsplittable files. A table of many files is never moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Cells of ``roughly_in``, and so the rows that it broadcasts at most.
FILTER_CELLS = 1 << 18


def roughly_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key's hash cell is among those of ``wanted``: all that are in it, and by chance some more.

    Goes before an exact join to keep the other rows' wide columns out of its shuffle. The broadcast side
    has at most ``FILTER_CELLS`` numbers, however large ``wanted`` is; of so many keys that nearly every cell is taken
    none is sent, as the filter would keep all rows. ``wanted`` is counted, so it should be kept.
    """
    if wanted.count() > 4 * FILTER_CELLS:
        return rows
    cell = F.pmod(F.xxhash64(*keys), F.lit(FILTER_CELLS))
    cells = wanted.select(cell.alias("_cell")).distinct()
    return rows.withColumn("_cell", cell).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


#: Rows of one key that meet the others of that key in one block of ``pairs_within``.
BLOCK_ROWS = 1024


def pairs_within(rows: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """``x, y``: all pairs ``x < y`` of the values found under one key; ``count`` bounds a key's number of rows.

    A key of many rows is cut into blocks, each of which meets all rows of the key, so that no task has
    to write all of a key's pairs.
    """
    blocks = F.greatest(F.ceil(F.col(count) / BLOCK_ROWS), F.lit(1)).cast("int")
    left = rows.select(*keys, F.col(value).alias("x"), F.pmod(F.xxhash64(value), blocks).cast("int").alias("_block"))
    right = rows.select(*keys, F.col(value).alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    return left.join(right, [*keys, "_block"]).where("x < y").select("x", "y")


def take_once(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with a key that occurs several times taken once; rows with a NULL key stay as they are.

    Only keys are shuffled to find the few that repeat; of the rows no more than theirs. Which of several
    rows stays is open, so they should be equal.
    """
    again = durable(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    return rows.join(again, key, "left_anti").union(rows.join(again, key, "left_semi").dropDuplicates([key]))
