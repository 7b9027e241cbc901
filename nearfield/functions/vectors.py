"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Denominators of the cosine below this count as zero.
TINY = 1e-10


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: _d(x) * _d(x))))


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance: what results are ranked by."""
    return _fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size < TINY, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / size)


def normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(norm(a), F.size(a)).alias("n")), lambda x: F.when(x["n"] == 0, _d(x["v"])).otherwise(_d(x["v"]) / x["n"]))


def preview(a: Column, n: int = 8) -> Column:
    return F.slice(a, 1, n)


def dim_ok(a: Column, dim: int) -> Column:
    """False for null, too."""
    return F.coalesce(F.size(a) == dim, F.lit(False)) & a.isNotNull()


def register(spark: SparkSession) -> None:
    """l2_sq, l2, cosine_distance and fnv1a64 (unsigned, as text) as SQL functions of the session."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {0}), 0D, (s, x) -> s + x)"
    square = fold.format("(cast(x AS double) - cast(y AS double)) * (cast(x AS double) - cast(y AS double))")
    product = fold.format("cast(x AS double) * cast(y AS double)")
    size = "sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double)))"
    both = f"{size.format('a')} * {size.format('b')}"
    given = "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_sq{given} {square}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2{given} sqrt({square})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance{given} CASE WHEN {both} < {TINY} THEN 1D ELSE 1D - {product} / ({both}) END")
    low, high = "(h & 4294967295L) * 435", "shiftrightunsigned(h, 32) * 435"
    times = f"shiftleft(({high} + shiftrightunsigned({low}, 32) + shiftleft(h & 16777215L, 8)) & 4294967295L, 32) | ({low} & 4294967295L)"
    octets = "transform(sequence(0, 7), i -> shiftrightunsigned(v, 8 * i) & 255L)"
    xor = f"aggregate(transform(array(a ^ b), h -> {times}), 0L, (x, y) -> y)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fnv1a64(v BIGINT) RETURNS STRING RETURN conv(hex(aggregate({octets}, {14695981039346656037 - (1 << 64)}L, (a, b) -> {xor})), 16, 10)")
