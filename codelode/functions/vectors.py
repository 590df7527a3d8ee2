"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is NULL, empty or of length 0, or if their sizes differ."""
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.when(fits & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """The vector at length 1; unchanged if its length is 0."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def encode(a: Column) -> Column:
    """The elements as little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return pack(a)


def decode(blob: Column) -> Column:
    """A vector from little-endian float32 bytes; NULL for none, or for a length that is no multiple of four."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if not b or len(b) % 4 else np.frombuffer(b, dtype="<f4"))

    return unpack(blob)
