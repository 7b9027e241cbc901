"""Latency and throughput measures over events with a time, an order and a value in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.log import running as running_by
from nearfield.operators.log import same

# Upper bounds of the latency buckets in microseconds, and what each bucket reports as its midpoint.
BOUNDS = (100, 200, 300, 500, 750, 1000, 2000)
MIDPOINTS = (50, 150, 250, 400, 625, 875, 1500, 3000)
LEVELS = (0.50, 0.95, 0.99)


def bucket(us: Column) -> Column:
    """0..7, by strict upper bounds."""
    out = F.when(us < BOUNDS[0], 0)
    for i, b in enumerate(BOUNDS[1:], 1):
        out = out.when(us < b, i)
    return out.otherwise(len(BOUNDS))


def histogram(events: DataFrame, value: str) -> DataFrame:
    """bucket, n of every bucket, also of empty ones."""
    every = events.sparkSession.range(len(MIDPOINTS)).select(F.col("id").cast("int").alias("bucket"))
    got = events.where(F.col(value).isNotNull()).groupBy(bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_percentiles(hist: DataFrame, before: float = 0.0) -> DataFrame:
    """p50, p95, p99: midpoint of the first bucket whose cumulative share reaches the level; ``before`` without data."""
    w = Window.orderBy("bucket")  # eight rows
    share = hist.withColumn("share", F.try_divide(F.sum("n").over(w), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    mids = F.array(*[F.lit(float(x)) for x in MIDPOINTS])
    return share.agg(*[F.coalesce(F.get(mids, F.min(F.when(F.col("share") >= p, F.col("bucket")))), F.lit(before)).alias(f"p{round(100 * p)}") for p in LEVELS])


def exact_percentiles(events: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 of each group (or of all) by linear interpolation; 0 without data.

    Equal values are counted first, then the counts are summed in ranges, so no task holds or sorts a whole group.
    """
    by = by or []
    total = events.groupBy(*by).agg(F.count(value).alias("__total"))
    each = events.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    summed = running_by(each, "__v", by, F.col("__n"), "__end")
    placed = summed.alias("s").join(total.alias("t"), same("s", "t", by)).select("s.*", "t.__total")
    at = {p: p * (F.col("__total") - 1) for p in LEVELS}
    has = lambda i: (F.col("__end") > i) & (F.col("__end") - F.col("__n") <= i)
    picks = [F.max(F.when(has(side(at[p])), F.col("__v"))).alias(f"__{name}{i}") for i, p in enumerate(LEVELS) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    got = total.alias("t").join(placed.groupBy(*by).agg(*picks).alias("g"), same("t", "g", by), "left").select("t.*", *[f"g.__{name}{i}" for i in range(len(LEVELS)) for name in ("lo", "hi")])
    cols = []
    for i, p in enumerate(LEVELS):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        cols.append(F.coalesce(lo + (hi - lo) * (at[p] - F.floor(at[p])), F.lit(0.0)).alias(f"p{round(100 * p)}"))
    return got.select(*by, *cols)


def latest(events: DataFrame, n: int, *order: str) -> DataFrame:
    """The n latest rows, without sorting the table."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def rates(events: DataFrame, ts: str, kind: str, seconds: int = 1) -> DataFrame:
    """second, kind, n: events of each tick."""
    w = F.window(ts, f"{seconds} seconds")
    return events.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("tick"), kind, "n")


def running(ticks: DataFrame, tick: str, *values: str) -> DataFrame:
    """Running totals over ticks, which are already aggregated."""
    w = Window.orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.select("*", *[F.sum(v).over(w).alias(f"total_{v}") for v in values])


def lifetime_rate(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(0.0)


#: Ranges that a selection counts at a time, and rows that it sorts in the end.
CELLS, FEW = 1024, 100_000


def values_at(events: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at positions ``ranks`` of the sorted values, without sorting them.

    The range of values is cut into cells whose rows are counted; the cell with a rank is cut again, until it holds few rows
    or one value. Only counts and at most a hundred thousand values come to the driver.
    """
    v = F.col(value).cast("double")
    some = events.where(v.isNotNull()).select(v.alias("v"))
    out: list[float] = []
    for rank in ranks:
        lo, hi, before = *some.agg(F.min("v"), F.max("v")).first(), 0
        here = some
        while True:
            n = here.count()
            if n <= FEW or lo == hi:
                break
            width = (hi - lo) / CELLS
            cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v") - lo) / width)).cast("int")
            counts = sorted(here.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
            for c, m, a, b in counts:
                if rank < before + m:
                    here, lo, hi = here.where((F.col("v") >= a) & (F.col("v") <= b)), a, b
                    break
                before += m
        out.append(lo if lo == hi else sorted(r[0] for r in here.collect())[rank - before])
    return out


def ranked_percentiles(events: DataFrame, value: str) -> DataFrame:
    """p50, p95, p99 as the value at position floor(p * n) of the sorted values."""
    n = events.where(F.col(value).isNotNull()).count()
    got = values_at(events, value, [min(int(p * n), n - 1) for p in LEVELS]) if n else [None] * len(LEVELS)
    return events.sparkSession.createDataFrame([tuple(got)], "p50 double, p95 double, p99 double")


def gflops(calls_per_second: Column, dim: int) -> Column:
    return calls_per_second * (2 * dim) / 1e9


def status(healthy: Column) -> Column:
    return F.when(healthy, "healthy").otherwise("degraded")


def iso_utc(ts: Column) -> Column:
    """Seconds of a timestamp in UTC, whatever the session's zone: 2024-01-31T12:00:00Z."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def document(shards: DataFrame, rates: DataFrame, levels: DataFrame, now_ms: Column) -> DataFrame:
    """document: one JSON text of what a dashboard polls, from (id, vectors, status), one row of counts and rates, and one of levels.

    ``rates`` has insert_rate, search_rate, total_inserts, total_searches; ``levels`` has p50, p95, p99 in microseconds.
    """
    one = F.lit(1).alias("one")
    listed = shards.groupBy(one).agg(F.sum("vectors").alias("total_vectors"), F.array_sort(F.collect_list(F.struct("id", "vectors", "status"))).alias("shards"))  # a row a shard
    row = listed.join(rates.select("*", one), "one").join(levels.select("*", one), "one")
    names = ["total_vectors", "insert_rate", "search_rate", F.col("p50").alias("p50_us"), F.col("p95").alias("p95_us"), F.col("p99").alias("p99_us"), "total_inserts", "total_searches", now_ms.alias("ts"), "shards"]
    return row.select(F.to_json(F.struct(*names)).alias("document"))


def human(n: Column) -> Column:
    """Counts as text: 1.2M, 3.4K, 56."""
    return F.when(n >= 1e6, F.concat(F.format_string("%.1f", F.round(n / 1e6, 1)), F.lit("M"))).when(n >= 1e3, F.concat(F.format_string("%.1f", F.round(n / 1e3, 1)), F.lit("K"))).otherwise(n.cast("long").cast("string"))


def human_us(us: Column) -> Column:
    return F.when(us >= 1000, F.concat(F.format_string("%.1f", F.round(us / 1000, 1)), F.lit("ms"))).otherwise(F.concat(us.cast("long").cast("string"), F.lit("us")))


def gauge(value: Column, full: float) -> Column:
    """Per cent of a full scale, 100 at most."""
    return F.least(F.lit(100.0), value / full * 100)
