"""Keeping an index fresh from a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schema import FILE_SCHEMA
from ..functions.classify import category_of, is_indexable, language_of


def refresh_batch(engine: Engine, batch: DataFrame) -> None:
    """Replaces the chunks of the batch's files (``file_path, content, sequence``); a NULL content removes a file.

    Of several changes of a file in a batch the one with the greatest ``sequence`` counts, NULL being the least; of
    equal ones a removal, else the greatest content. Running a batch again changes nothing, so a restart after a
    failure is harmless.
    """
    order = F.struct("sequence", F.col("content").isNull().alias("gone"), "content")
    last = batch.groupBy("file_path").agg(F.max(order).alias("v")).select("file_path", "v.content")
    known = last.withColumn("language", language_of(F.col("file_path")))
    good = F.col("language").isNotNull() & is_indexable(category_of(F.col("language")))
    engine.store.replace_files(engine.chunks_of(known.where(good & F.col("content").isNotNull())), known.select("file_path"))


def refresh_stream(engine: Engine, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts refreshing the index from a streaming ``file_path, content, sequence``."""
    return changes.writeStream.foreachBatch(lambda batch, _: refresh_batch(engine, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change files: JSON lines ``file_path, content, sequence`` dropped into a folder."""
    return spark.readStream.schema(FILE_SCHEMA).json(folder)
