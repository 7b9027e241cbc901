"""Generated vectors for demonstrations and tests: a function of id and seed, the same in each run and on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import normalize


def _unit(seed: int, i: int) -> Column:
    """A number in (0, 1) from a hash of the row's id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "id"), 11) + 0.5) / float(1 << 53)


def _cells(dim: int, cell) -> Column:
    return F.array(*[cell(i) for i in range(dim)])


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """vec_id, embedding: Gaussian directions at length one."""
    x = spark.range(n).select(F.col("id").alias("vec_id"), _cells(dim, lambda i: F.sqrt(-2 * F.log(_unit(seed, 2 * i))) * F.cos(2 * math.pi * _unit(seed, 2 * i + 1))).alias("x"))
    return x.select("vec_id", normalize(F.col("x")).cast("array<float>").alias("embedding"))


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """vec_id, embedding: components from -1 to 1, then at length one."""
    x = spark.range(n).select(F.col("id").alias("vec_id"), _cells(dim, lambda i: _unit(seed, i) * 2 - 1).alias("x"))
    return x.select("vec_id", normalize(F.col("x")).cast("array<float>").alias("embedding"))
