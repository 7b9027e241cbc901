"""Approximate search by random-projection buckets: several tables of signs, candidates from near buckets, exact ranking.

A vector is placed once a table; a query looks into several buckets of each, its own and those that differ in the signs of
which it is least sure. Buckets get smaller in proportion to the table. Candidates meet in a join on the bucket, which
Spark shuffles by bucket, and distances are computed for candidates only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import l2_sq
from nearfield.operators.search import merge


def buckets(vector: Column, dim: int, tables: int, bits: int, probes: int = 1, seed: int = 9) -> Column:
    """The ``probes`` buckets of each table that the vector is most likely to share with one near it; first its own."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    place = np.arange(tables, dtype=np.int64) << bits

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()).astype(np.float64) if len(v) else np.zeros((0, dim))
        side = (x @ planes.T).reshape(len(v), tables, bits)
        code = (side > 0) @ weight + place
        if probes > 1:
            code = (code[..., None] ^ flips(np.abs(side), probes)).reshape(len(v), -1)
        return pd.Series(list(code))

    return of(vector)


def flips(size: np.ndarray, probes: int) -> np.ndarray:
    """For each row of distances to planes, the ``probes`` sets of planes with the least sums of squares, as bit masks.

    Only sets of the planes that lie nearest, as many as give enough sets, are looked at."""
    bits = size.shape[-1]
    few = min(bits, probes.bit_length() + 2)
    order = np.argsort(size, axis=-1, kind="stable")[..., :few]
    cost = np.take_along_axis(size, order, -1) ** 2
    sets = np.array([[m >> i & 1 for m in range(1 << few)] for i in range(few)], np.float64)
    best = np.argsort(cost @ sets, axis=-1, kind="stable")[..., : min(probes, 1 << few)]
    out = np.zeros(best.shape, np.int64)
    for i in range(few):
        out |= (best >> i & 1) << order[..., i : i + 1]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 16, bits: int | None = None, probes: int = 12) -> DataFrame:
    """qid, rank, vec_id, distance of the nearest candidates of each query of (qid, query).

    ``bits`` of a bucket's name: by default 8, or as many as leave some eight vectors a bucket. More tables or probes find more."""
    if bits is None:
        bits = max(8, int(vectors.count()).bit_length() - 4)
    placed = vectors.select("vec_id", F.explode(buckets(F.col("embedding"), dim, tables, bits)).alias("b"))
    looked = queries.select("qid", F.explode(buckets(F.col("query"), dim, tables, bits, probes)).alias("b"))
    pairs = placed.join(looked, "b").select("qid", "vec_id").distinct()
    near = pairs.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "query"), "qid")
    return merge(near.select("qid", "vec_id", l2_sq(F.col("embedding"), F.col("query")).alias("d")), k)
