"""Streams: bulk inserts, ticks of counters, and token buckets with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearfield.operators.admission import bucket_step
from nearfield.operators.log import split_valid


def bulk_insert(stream: DataFrame, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append valid rows of (vec_id, embedding) to ``path``/rows; count both kinds in ``path``/counts.

    A batch is written under its number, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_valid(batch, dim)
        good.select("vec_id", "embedding").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        counted = batch.agg(F.count_if(F.coalesce(F.size("embedding") == dim, F.lit(False))).alias("inserted"), F.count("*").alias("n"))
        counted.select("inserted", (F.col("n") - F.col("inserted")).alias("failed")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_rates(stream: DataFrame, ts: str, kind: str, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """tick, kind, n over a stream; a tick is given out once the watermark has passed it."""
    w = F.window("__ts", f"{seconds} seconds")
    counted = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("tick"), kind, "n")


def poll(spark: SparkSession, document: Callable[[], DataFrame], path: str, checkpoint: str, seconds: int = 1) -> StreamingQuery:
    """Every ``seconds`` append what ``document`` gives then to ``path``, under the number of the tick; runs until stopped.

    A tick that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        document().write.mode("overwrite").parquet(f"{path}/tick={number}")

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def polled(spark: SparkSession, path: str, most: int = 60) -> DataFrame:
    """The latest ticks of :func:`poll`, with their number."""
    return spark.read.option("basePath", path).parquet(f"{path}/tick=*").orderBy(F.col("tick").desc()).limit(most)


def stream_token_bucket(stream: DataFrame, client: str, ts: str, order: str, capacity: float, refill: float) -> DataFrame:
    """client, order, allowed over a stream; a bucket's state outlives the batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values(["t", "ord"])
        out = []
        for o, t in zip(rows.ord, rows.t, strict=True):
            tokens, ok = bucket_step(tokens, last, t, capacity, refill)
            last = t
            out.append((key[0], o, ok))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame(out, columns=["client", "ord", "allowed"])

    rows = stream.select(F.col(client).cast("long").alias("client"), F.col(order).cast("long").alias("ord"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy("client").applyInPandasWithState(step, "client long, ord long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
