"""The ordered log: validation, numbering, checkpoints, replay of the valid prefix, truncation, tombstones.

A log belongs to a shard; every operator takes the columns that name the log and works on all logs at once. Numbers are
counted in two steps, within ranges of the order and over the ranges' totals, so that one large log is not sorted in one
task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def crc32_f32(vector: pd.Series) -> pd.Series:
    """CRC-32 of a vector's little-endian float32 bytes."""
    return vector.map(lambda v: zlib.crc32(np.asarray(v, "<f4").tobytes()) if v is not None else None).astype("Int64")


def split_valid(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a vector of the right length, and the others with a reason."""
    v = F.col(vector)
    reason = F.when(v.isNull() | (F.size(v) == 0), "missing vector").when(F.size(v) != dim, "dimension mismatch")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


#: Rows that one range of an order holds, about.
ROWS = 1 << 18


def cuts(rows: DataFrame, order: str, least: int = 1) -> list:
    """Values that cut the rows into ranges of about equal counts, of ``ROWS`` rows each and ``least`` of them at least."""
    parts = max(least, -(-rows.count() // ROWS))
    if parts == 1:
        return []
    return sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))


def range_of(value: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted ``bounds``, values of type ``kind``, are less than the value: first by every so many of them."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    every = F.lit(bounds).cast(f"array<{kind}>")
    rough = F.size(F.filter(F.lit(bounds[step - 1 :: step]).cast(f"array<{kind}>"), lambda x: x < value)) if step <= len(bounds) else F.lit(0)
    return rough * step + F.size(F.filter(F.slice(every, rough * step + 1, F.lit(step)), lambda x: x < value))


def same(a: str, b: str, keys: list[str]) -> Column | list[Column]:
    """That two aliased tables agree in keys, nulls included."""
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys] or F.lit(True)


def running(rows: DataFrame, order: str, by: list[str], weight: Column, name: str, least: int = 1) -> DataFrame:
    """``name`` = sum of ``weight`` over the rows of the same log (``by``, or all) up to and with this one, in ascending order.

    The order column is cut into ranges of about equal counts; a sum is that within a range plus the totals of the log's
    ranges before it, so no task sorts a whole log. ``rows`` are read more than once and must agree each time.
    """
    bounds, rows = cuts(rows, order, least), rows.withColumn("__w", weight)
    if not bounds:  # one range
        return rows.withColumn(name, F.sum("__w").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("__w")
    cut = rows.withColumn("__part", range_of(F.col(order), bounds, rows.schema[order].dataType.simpleString()))
    past = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = cut.groupBy(*by, "__part").agg(F.sum("__w").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(past), F.lit(0)))
    here = cut.withColumn("__here", F.sum("__w").over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = here.alias("h").join(before.alias("b"), same("h", "b", [*by, "__part"])).select("h.*", "b.__before")
    return joined.withColumn(name, F.col("__here") + F.col("__before")).drop("__w", "__part", "__here", "__before")


def numbered(rows: DataFrame, order: str, name: str, by: list[str] | None = None, base: int = 0, parts: int = 1) -> DataFrame:
    """``name`` = position of each row in its log (``by``, or all) by the order column, of numbers unique in a log, from ``base``."""
    return running(rows, order, by or [], F.lit(1).cast("long"), "__end", parts).withColumn(name, (F.col("__end") - 1 + base).cast("long")).drop("__end")


def fill_ids(inserts: DataFrame, order: str, total: int) -> DataFrame:
    """vec_id of rows without one, or with a negative one: the vectors before them, counting all inserts."""
    return numbered(inserts, order, "__pos", base=total).withColumn("vec_id", F.when(F.col("vec_id") >= 0, F.col("vec_id")).otherwise(F.col("__pos"))).drop("__pos")


def valid_prefix(log: DataFrame, good: Column, by: list[str] | None = None, lsn: str = "lsn") -> DataFrame:
    """Rows before the first bad one of their log. The first bad number is one row a log; no log is sorted."""
    bad = log.where(~F.coalesce(good, F.lit(False)))
    if by:
        first = bad.groupBy(*by).agg(F.min(lsn).alias("__bad"))
        return log.join(first, by, "left").where(F.col("__bad").isNull() | (F.col(lsn) < F.col("__bad"))).drop("__bad")
    first = bad.agg(F.min(lsn).alias("__bad"))  # one row
    return log.crossJoin(F.broadcast(first)).where(F.col("__bad").isNull() | (F.col(lsn) < F.col("__bad"))).drop("__bad")


def record_ok(dim: int) -> Column:
    """A record's own part of validity: dimension and checksum."""
    return (F.col("dim") == dim) & (F.size("embedding") == dim) & (F.col("crc") == crc32_f32(F.col("embedding")))


#: Numbers of a range in which rows are counted before any are sorted.
RANGE = 1 << 16


def prefix_end(log: DataFrame, good: Column, by: list[str], start: DataFrame | None = None, lsn: str = "lsn") -> DataFrame:
    """(by, start, end) of each log: the numbers from ``start`` (0 where none is given) to before ``end`` are all there and good.

    Whole ranges of numbers are told by their counts; only the first range with a gap is sorted.
    """
    own = log.where(F.coalesce(good, F.lit(False))).select(*by, lsn)
    logs = log.select(*by).distinct()
    if start is not None:
        logs = logs.join(start, by, "left")
    logs = logs.select(*by, (F.coalesce("start", F.lit(0)) if start is not None else F.lit(0)).cast("long").alias("start"))
    at = own.join(F.broadcast(logs), by).where(F.col(lsn) >= F.col("start")).select(*by, (F.col(lsn) - F.col("start")).alias("__at")).distinct()  # a row a log
    ranges = at.groupBy(*by, F.floor(F.col("__at") / RANGE).alias("__r")).agg(F.count("*").alias("__n"))
    placed = ranges.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy("__r")) - 1)  # a row for 65536 numbers
    whole = (F.col("__r") == F.col("__i")) & (F.col("__n") == RANGE)
    edge = placed.groupBy(*by).agg(F.coalesce(F.min(F.when(~whole, F.col("__i"))), F.count("*")).cast("long").alias("__edge"))
    last = at.join(F.broadcast(edge), by).where(F.floor(F.col("__at") / RANGE) == F.col("__edge"))  # a row a log
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__at")) - 1 + F.col("__edge") * RANGE
    more = last.withColumn("__ok", rank == F.col("__at")).groupBy(*by).agg(F.count_if("__ok").alias("__more"))
    found = edge.join(more, by, "left").select(*by, (F.col("__edge") * RANGE + F.coalesce("__more", F.lit(0))).alias("__len"))
    return logs.join(found, by, "left").select(*by, "start", (F.col("start") + F.coalesce("__len", F.lit(0))).alias("end"))


def contiguous_prefix(log: DataFrame, good: Column, by: list[str], start: DataFrame | None = None, lsn: str = "lsn") -> DataFrame:
    """The records of each log from ``start`` on, as far as their numbers follow each other and all are good."""
    ends = prefix_end(log, good, by, start, lsn).select(*by, F.col("start").alias("__start"), F.col("end").alias("__end"))
    return log.where(F.coalesce(good, F.lit(False))).join(F.broadcast(ends), by).where((F.col(lsn) >= F.col("__start")) & (F.col(lsn) < F.col("__end"))).drop("__start", "__end")  # a row a log


def introspect(log: DataFrame, by: list[str], every: int, lsn: str = "lsn", size: Column | None = None) -> DataFrame:
    """(by, current_lsn, checkpoint_lsn, bytes) of each log: the next number, that of the last automatic checkpoint, its size.

    ``size``: bytes of a record; by default its vector's and 24 for what precedes it.
    """
    size = F.size("embedding") * 4 + 24 if size is None else size
    got = log.groupBy(*by).agg((F.max(lsn) + 1).alias("current_lsn"), F.sum(size).cast("long").alias("bytes"))
    return got.select(*by, "current_lsn", checkpoint_lsn(F.col("current_lsn"), every).alias("checkpoint_lsn"), "bytes")


def checkpoint_lsn(count: Column, every: int) -> Column:
    """Number after the last automatic checkpoint."""
    return F.when(F.lit(every) > 0, F.floor(count / every) * every).otherwise(0).cast("long")


def truncate(log: DataFrame, keep_from: int, checkpoint: int, lsn: str = "lsn") -> DataFrame:
    """The log from ``keep_from`` on, numbered from 0 again; as it was if nothing lies beyond the checkpoint."""
    if keep_from <= checkpoint:
        return log
    return numbered(log.where(F.col(lsn) >= keep_from).withColumnRenamed(lsn, "__old"), "__old", lsn).drop("__old")


def delete(vectors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Vectors that no tombstone names."""
    return vectors.join(tombstones.select("vec_id").distinct(), "vec_id", "left_anti")


def found(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """vec_id, found of each delete request."""
    have = vectors.select("vec_id").distinct().withColumn("__have", F.lit(True))
    return requests.join(have, "vec_id", "left").select("vec_id", F.coalesce("__have", F.lit(False)).alias("found"))
