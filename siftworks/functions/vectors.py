"""Vectors as arrays: norms, cosines, quantization and calibration, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def quantize(v: Column) -> Column:
    """Components times 127, rounded half to even, as TINYINT."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x.cast("double") * 127))).cast("tinyint"))


def calibrated(similarity: Column, centre: float = 0.65, steepness: float = 25.0) -> Column:
    return 1 / (1 + F.exp(-steepness * ((similarity + 1) / 2 - centre)))
