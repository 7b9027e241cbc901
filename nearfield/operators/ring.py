"""Consistent-hash routing: the ring, owners of ids and strings, and what moves when a shard is added.

The ring has shards x vnodes points, a size set by the configuration and checked. Owners are found by binary search in
the sorted points, for a whole Arrow batch at once; a range join would compare each id with each point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.hashing import fnv1a64_long, fnv1a64_string, fnv_long_array, unsigned_text, vnode_key

#: Points that may be sent to every task.
MOST_POINTS = 1 << 22


def _points(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned hashes in order, and their shards."""
    if shards <= 0 or vnodes <= 0:
        raise ValueError("shards and vnodes must be positive")
    if shards * vnodes > MOST_POINTS:
        raise ValueError(f"a ring may have {MOST_POINTS} points")
    shard = np.repeat(np.arange(shards, dtype=np.int64), vnodes)
    h = fnv_long_array((shard << 32) + np.tile(np.arange(vnodes, dtype=np.int64), shards))
    order = np.lexsort((shard, h))
    return h[order], shard[order].astype(np.int32)


def ring(spark: SparkSession, shards: int, vnodes: int = 150) -> DataFrame:
    """shard_id, vnode, hash (unsigned, as text) of every point."""
    _points(shards, vnodes)
    grid = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard_id"), (F.col("id") % vnodes).cast("int").alias("vnode"))
    return grid.withColumn("hash", unsigned_text(fnv1a64_long(vnode_key(F.col("shard_id"), F.col("vnode")))))


def owner(ids: Column, shards: int, vnodes: int = 150) -> Column:
    """Owning shard of a bigint id: that of the first point at or after its hash, around the ring."""
    h, shard = _points(shards, vnodes)

    @F.pandas_udf("int")
    def of(v: pd.Series) -> pd.Series:
        at = np.searchsorted(h, fnv_long_array(v.fillna(0).to_numpy(np.int64))) % len(h)
        return pd.Series(shard[at], dtype="Int32").where(v.notna().to_numpy())

    return of(ids)


def owner_of_text(key: Column, shards: int, vnodes: int = 150) -> Column:
    """Owning shard of a string; its bytes are hashed in the JVM."""
    h, shard = _points(shards, vnodes)

    @F.pandas_udf("int")
    def of(v: pd.Series) -> pd.Series:
        at = np.searchsorted(h, v.fillna(0).to_numpy(np.int64).view(np.uint64)) % len(h)
        return pd.Series(shard[at], dtype="Int32").where(v.notna().to_numpy())

    return of(fnv1a64_string(key))


def affected_on_add(spark: SparkSession, shards: int, vnodes: int = 150) -> DataFrame:
    """shard_id, first_vnode: the shards that give keys to one more shard, with the new point that first takes some."""
    h, shard = _points(shards, vnodes)
    new = fnv_long_array((np.int64(shards) << 32) + np.arange(vnodes, dtype=np.int64))
    got = pd.DataFrame({"shard_id": shard[np.searchsorted(h, new) % len(h)], "first_vnode": np.arange(vnodes, dtype=np.int32)})
    return spark.createDataFrame(got.groupby("shard_id", as_index=False).min(), "shard_id int, first_vnode int")


def moved(ids: DataFrame, column: str, shards: int, vnodes: int = 150) -> DataFrame:
    """n_ids, n_moved, fraction of ids with another owner after one shard is added."""
    both = ids.select(owner(F.col(column), shards, vnodes).alias("a"), owner(F.col(column), shards + 1, vnodes).alias("b"))
    return both.agg(F.count("*").alias("n_ids"), F.count_if(F.col("a") != F.col("b")).alias("n_moved")).withColumn("fraction", F.when(F.col("n_ids") > 0, F.col("n_moved") / F.col("n_ids")).otherwise(0.0))


def load(routed: DataFrame, shards: int) -> DataFrame:
    """shard_id, n of every shard, also of empty ones."""
    every = routed.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    return every.join(routed.groupBy("shard_id").agg(F.count("*").alias("n")), "shard_id", "left").select("shard_id", F.coalesce("n", F.lit(0)).alias("n"))


def share(loads: DataFrame) -> DataFrame:
    """loads with pct, in tenths of a per cent; 0 if there is nothing."""
    total = F.sum("n").over(Window.partitionBy())
    return loads.withColumn("pct", F.when(total > 0, F.round(100 * F.col("n") / total, 1)).otherwise(0.0))
