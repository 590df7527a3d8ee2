"""File trees and the files that a chunk table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import category_of, in_excluded_dir, is_indexable, language_of


def scan_verdicts(paths: DataFrame) -> DataFrame:
    """``file_path, language, category, indexed`` of supported files outside of excluded folders.

    Files that are supported but not indexed (documentation, metadata) are the ones a refresh purges.
    """
    known = paths.withColumn("language", language_of(F.col("file_path")))
    known = known.where(F.col("language").isNotNull() & ~in_excluded_dir(F.col("file_path")))
    known = known.withColumn("category", category_of(F.col("language")))
    return known.withColumn("indexed", is_indexable(F.col("category"))).dropDuplicates(["file_path"])


def excluded_prefixes(paths: DataFrame) -> DataFrame:
    """``prefix``: the excluded folders that lie on the paths, each up to its first excluded part."""
    from .. import schema

    names = "|".join(d.replace(".", r"\.") for d in schema.EXCLUDED_DIRS)
    prefix = F.regexp_extract("file_path", rf"^(.*?/(?:{names}))/", 1)
    return paths.select(prefix.alias("prefix")).where("prefix <> ''").distinct()


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``file_path, content, language, category, indexed`` of the supported files below the roots.

    Names are judged before contents are read: the filter on the path reaches the file listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    named = files.select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("file_path"), "content")
    judged = named.withColumn("language", language_of(F.col("file_path"))).where("language IS NOT NULL")
    judged = judged.where(~in_excluded_dir(F.col("file_path"))).withColumn("category", category_of(F.col("language")))
    return judged.withColumn("indexed", is_indexable(F.col("category"))).withColumn("content", F.col("content").cast("string"))


def current_files(chunks: DataFrame) -> DataFrame:
    """``project, file_path, language, content``: the current revision of each file, put together from its chunks.

    One row per file, and so as large as the file: what a parser or chunker of whole files needs anyway.
    """
    keys = ["project", "file_path"]
    slim = chunks.select("id", *keys, "revision", "language", "start_line", "content").where("file_path IS NOT NULL")
    top = slim.groupBy(*keys).agg(F.max("revision").alias("revision"))
    current = slim.join(top, [*keys, "revision"]).dropDuplicates(["id"])
    pieces = F.array_sort(F.collect_list(F.struct("start_line", F.coalesce("content", F.lit("")).alias("content"))))
    files = current.groupBy(*keys).agg(F.max("language").alias("language"), pieces.alias("pieces"))
    return files.select(*keys, "language", F.array_join(F.col("pieces.content"), "\n").alias("content"))
