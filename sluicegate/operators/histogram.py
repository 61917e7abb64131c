"""Histograms of large columns over generated bucket bounds.

A value belongs to the first bound that is not below it. Bounds are a short list made on the
driver; the rows are counted per bucket with one scan and a partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear part of the hybrid bounds, default range of the logarithmic ones.
LINEAR_STEP = 10
LINEAR_MAX = 1000
TOP = 1_000_000.0
LOG_MIN = 1.0


def growth_factor(start: float, steps: int) -> float:
    """Factor that leads from ``start`` to the top bound in ``steps`` steps."""
    return math.pow(TOP / start, 1 / steps)


def hybrid_bounds(n: int) -> list[float]:
    """0, steps of 10 up to 1000, geometric up to a million, infinity; at least 102 bounds."""
    linear = [float(b) for b in range(0, LINEAR_MAX + 1, LINEAR_STEP)]
    steps = n - len(linear) - 1
    factor = growth_factor(LINEAR_MAX, steps) if steps > 0 else 1.0
    geometric = [LINEAR_MAX * math.pow(factor, i + 1) for i in range(steps)]
    return [*linear, *geometric, math.inf]


def pow2_bounds(n: int) -> list[float]:
    """0, 1, 2, 4, ..., infinity; powers beyond the double range are infinite."""
    return [0.0, *[math.ldexp(1.0, i) if i < 1024 else math.inf for i in range(n - 2)], math.inf]


def log_bounds(n: int, low: float = LOG_MIN, high: float = TOP) -> list[float]:
    """0, then equal steps of the logarithm from above ``low`` up to ``high``, infinity."""
    if low <= 0 or high <= 0:
        raise ValueError("a logarithmic range must be above zero")
    step = (math.log(high) - math.log(low)) / (n - 2) if n > 2 else 0.0
    return [0.0, *[math.exp(math.log(low) + step * i) for i in range(1, n - 1)], math.inf]


def with_buckets(df: DataFrame, value: str, sets: dict[str, Sequence[float]]) -> DataFrame:
    """Add, per named bound set, the index of the first bound that is not below ``value``.

    The index is found by a binary search, one narrow projection per halving, so the code
    generated for it stays small however many bounds there are. ``value`` must be a number;
    bounds must rise and end with infinity.
    """
    halvings = max(len(bounds) - 1 for bounds in sets.values()).bit_length()
    size = 1 << halvings
    tables = {name: F.array(*[F.lit(float(b)) for b in bounds],
                            *[F.lit(math.inf)] * (size - len(bounds)))
              for name, bounds in sets.items()}
    df = df.withColumns({name: F.lit(0) for name in sets})
    for step in (1 << i for i in reversed(range(halvings))):
        df = df.withColumns({
            name: F.col(name) + F.when(F.get(table, F.col(name) + F.lit(step - 1)) < F.col(value),
                                       F.lit(step)).otherwise(F.lit(0))
            for name, table in tables.items()})
    return df


def _numbers(df: DataFrame, value: Column) -> DataFrame:
    return (df.select(value.cast("double").alias("_value"))
            .where(F.col("_value").isNotNull() & ~F.isnan("_value")))


def bounds_table(df: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """One row per bound: bucket, upper_bound and the bound to two decimals."""
    literals = F.array(*[F.lit(float(b)) for b in bounds])
    return (df.sparkSession.range(1).select(F.posexplode(literals).alias("bucket", "upper_bound"))
            .withColumn("bound_2dp", F.round("upper_bound", 2)))


def histogram(df: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """Rows per bucket; empty buckets are kept, NULL and NaN are not counted."""
    counts = (with_buckets(_numbers(df, value), "_value", {"bucket": bounds})
              .groupBy("bucket").agg(F.count("*").alias("n")))
    return (bounds_table(df, bounds).join(counts, "bucket", "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))


def compare_bounds(df: DataFrame, value: Column,
                   methods: dict[str, Sequence[float]]) -> DataFrame:
    """How well each bound set spreads a column, from one scan of it.

    Places in all sets rise with the value, so rows are first counted by all places at once: there
    are no more combinations than bounds.
    """
    columns = {f"_{i}": bounds for i, bounds in enumerate(methods.values())}
    indexes = F.array(*[F.struct(F.lit(name).alias("method"), F.col(column).alias("bucket"))
                        for name, column in zip(methods, columns)])
    counts = (with_buckets(_numbers(df, value), "_value", columns)
              .groupBy(*columns).agg(F.count("*").alias("n"))
              .select(F.explode(indexes).alias("b"), "n")
              .groupBy("b.method", "b.bucket").agg(F.sum("n").alias("n")))
    spread = counts.groupBy("method").agg(
        F.count("*").alias("occupied"), F.max("n").alias("largest"), F.sum("n").alias("n_rows"))
    shape = F.array(*[F.struct(
        F.lit(name).alias("method"), F.lit(len(bounds)).alias("n_bounds"),
        F.lit(bounds[1]).alias("first_finite"), F.lit(bounds[-2]).alias("last_finite"))
        for name, bounds in methods.items()])
    table = df.sparkSession.range(1).select(F.inline(shape))
    return table.join(spread, "method", "left")
