"""Synthetic part vectors: standard normal numbers hashed from seed, key and dimension, the same whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(2**53)


def normal_vector(keys: list[str], dim: int, seed: int) -> Column:
    """Box-Muller over pairs of hashed uniforms."""
    at = [F.col(k) for k in keys]

    def one(i: Column) -> Column:
        return F.sqrt(-2 * F.ln(_uniform(F.lit(seed), F.lit("r"), *at, i))) * F.cos(2 * math.pi * _uniform(F.lit(seed), F.lit("a"), *at, i))

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def synthetic_vectors(parts: DataFrame, keys: list[str], dim: int = 16, seed: int = 42) -> DataFrame:
    if dim < 1:
        raise ValueError("dim must be positive")
    return parts.withColumn("vector", normal_vector(keys, dim, seed))
