"""Snapshots: versioned folders that a small pointer file names once they are complete.

A snapshot holds the vectors, the graph and the log number each shard has reached, so replay after it is idempotent:
only later records of the valid prefix count, and each once. A shard without a snapshot recovers from its log alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.hnsw import EDGES
from nearfield.sources import pointer, segments

GRAPH = "shard_id int, node_id int, adj array<struct<l: array<int>>>"


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON text a node: {"shard_id", "node_id", "adj": [{"l": [...]}, ...]}, layers in order."""
    layers = F.transform(F.array_sort(F.collect_list(F.struct("layer", "neighbours"))), lambda x: F.struct(x["neighbours"].alias("l")))
    return edges.groupBy("shard_id", "node_id").agg(layers.alias("adj")).select(F.to_json(F.struct("shard_id", "node_id", "adj")).alias("value"))


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """shard_id, node_id, layer, neighbours of graphs written as JSON lines; malformed lines fail the read."""
    df = spark.read.schema(GRAPH).option("mode", "FAILFAST").json(path)
    return df.select("shard_id", "node_id", F.posexplode("adj").alias("layer", "a")).select("shard_id", "node_id", "layer", F.col("a.l").alias("neighbours"))


def save(vectors: DataFrame, edges: DataFrame, log: DataFrame | None, path: str, name: str | None = None, more: dict[str, DataFrame] | None = None) -> str:
    """Write a new version, with more tables by name, and then point to it; returns its name. A failure leaves the version before."""
    spark, name = vectors.sparkSession, name or f"v-{uuid.uuid4().hex}"
    for table, df in (more or {}).items():
        df.write.parquet(f"{path}/{name}/{table}")
    segments.create(vectors, f"{path}/{name}/vectors")
    edges.write.partitionBy("shard_id").parquet(f"{path}/{name}/graph")
    upto = log.groupBy("shard_id").agg(F.max("lsn").alias("max_lsn")) if log is not None else spark.createDataFrame([], "shard_id int, max_lsn long")
    upto.coalesce(1).write.parquet(f"{path}/{name}/upto")  # a row a shard
    pointer.put(spark, path, name)
    return name


def current(spark: SparkSession, path: str) -> str | None:
    return pointer.get(spark, path)


def load(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, graph and reached log numbers of the current version. With ``check``, raises if the two disagree on the nodes."""
    name = current(spark, path)
    if name is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    vectors = segments.read(spark, f"{path}/{name}/vectors")
    edges = spark.read.schema(EDGES).parquet(f"{path}/{name}/graph")
    nodes = edges.where("layer = 0").select("shard_id", "node_id").distinct()
    if check and (vectors.join(nodes, ["shard_id", "node_id"], "full_outer").where(F.col("embedding").isNull()).count() or vectors.count() != nodes.count()):
        raise ValueError("vectors and graph of the snapshot have different nodes")
    return vectors, edges, spark.read.schema("shard_id int, max_lsn long").parquet(f"{path}/{name}/upto")


def recover(log: DataFrame, vectors: DataFrame | None, upto: DataFrame | None, dim: int) -> DataFrame:
    """shard_id, lsn, vec_id, embedding: what a snapshot lacks of each shard's valid prefix, each record once.

    Records beyond the snapshot count as far as their numbers follow on from it without a gap; without a snapshot, from 0.
    """
    from nearfield.operators.log import contiguous_prefix, record_ok

    start = None if upto is None else upto.select("shard_id", (F.col("max_lsn") + 1).alias("start"))
    more = ["metadata"] if "metadata" in log.columns else []
    return contiguous_prefix(log, record_ok(dim), ["shard_id"], start).dropDuplicates(["shard_id", "lsn"]).select("shard_id", "lsn", "vec_id", "embedding", *more)
