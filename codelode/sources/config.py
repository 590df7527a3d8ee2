"""The embedding configuration and benchmark fixtures."""

from __future__ import annotations

import copy
import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

DEFAULT_CONFIG = {
    "default_provider": "embedded",
    "fallback_providers": [],
    "embedded": {"enabled": True, "model": "bge-small-en-v1.5", "dimensions": 384, "sequence_length": 512},
    "remote": {"enabled": False, "base_url": "http://localhost:1234/v1", "model": "", "dimensions": 0, "timeout_seconds": 30},
}


def merge_config(base: dict, given: dict) -> dict:
    """``base`` with what is given: strings that are not blank, numbers above 0, lists that are not empty, all booleans."""
    out = copy.deepcopy(base)
    for key, value in (given or {}).items():
        if isinstance(value, dict):
            out[key] = merge_config(out.get(key) or {}, value)
        elif isinstance(value, bool) or isinstance(value, str) and value.strip() or isinstance(value, (int, float)) and value > 0 or isinstance(value, list) and value:
            out[key] = value
    return out


def load_config(path: str | None = None) -> dict:
    """The defaults, merged with the ``embeddings`` section of a JSON file if there is one."""
    if not path or not os.path.exists(path):
        return copy.deepcopy(DEFAULT_CONFIG)
    with open(path) as f:
        return merge_config(DEFAULT_CONFIG, json.load(f).get("embeddings", {}))


def provider_order(config: dict) -> list[str]:
    """The providers to try: default, fallbacks, then the two built-in ones; blanks and repeats left out."""
    names = [config.get("default_provider", ""), *config.get("fallback_providers", []), "embedded", "remote"]
    return list(dict.fromkeys(n.strip() for n in names if n and n.strip()))


def read_fixture(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """A benchmark's name, and its queries ``query_id, position, name, query, expected_files, expected_chunks``.

    Raises ``ValueError`` if there are no queries or one is not valid.
    """
    from ..operators.evaluate import fixture_violations

    document = spark.read.schema(schema.FIXTURE_SCHEMA).json(path, multiLine=True)
    name = document.select("name").first()
    queries = document.select(F.posexplode("queries").alias("position", "q")).select((F.col("position") + 1).alias("position"), "q.*")
    queries = queries.withColumn("query_id", F.col("position").cast("bigint"))
    bad = fixture_violations(queries).orderBy("position").first()
    if bad or not queries.take(1):
        raise ValueError(f"benchmark query {bad['position']}: {bad['problem']}" if bad else "the benchmark has no queries")
    label = (name["name"] or "").strip() if name else ""
    return label or posixpath.basename(path), queries
