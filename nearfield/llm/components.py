"""Connected components of a graph too large for one machine, by alternating stars.

Large star: a node tells its larger neighbours the least node it knows; small star: it tells its smaller ones. Each step
is a minimum per node, taken before the shuffle, and a join that adaptive execution can split where a node has very many
neighbours. Edges never outnumber the input's, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import settle


def _ordered(edges: DataFrame) -> DataFrame:
    """(hi, lo) with hi > lo, each once."""
    return edges.where(F.col("hi") != F.col("lo")).select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return _ordered(both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("hi"), F.col("m").alias("lo")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("x"), "m")
    near = edges.join(least, F.col("hi") == F.col("x"))
    return _ordered(near.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("x").alias("hi"), F.col("m").alias("lo"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge of (a, b) whose component's least node is another one.

    Nodes of any ordered type. Loops, nulls and repeated edges do nothing; no edges, no rows. A node that is missing
    from the result is the least of its component.
    """
    a, b = edges.columns[:2]
    now = settle(_ordered(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo")).where("hi is not null and lo is not null")))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = mark
        now = settle(_small(settle(_large(now))))
