"""Running values per key that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(chunked: DataFrame, keys: list[str], value: Column, out: str,
                   how: Callable[[Column], Column] = F.max) -> DataFrame:
    """Add ``out``: ``how`` of ``value`` over the earlier rows with the same keys.

    Each (keys, chunk) is first reduced to one value with map-side combine. The running
    value over those few rows gives what a chunk starts with, and it enters the chunk's
    window as one extra first row. So a window partition holds one chunk of one key, however
    many rows the key has, and the records are shuffled once. ``how`` is max, min or sum.
    """
    part = [*keys, "chunk"]
    valued = chunked.withColumn("_value", value)
    earlier_chunks = (Window.partitionBy(*keys).orderBy("chunk")
                      .rowsBetween(Window.unboundedPreceding, -1))
    starts = (valued.groupBy(*part).agg(how(F.col("_value")).alias("_value"))
              .select(*part, how(F.col("_value")).over(earlier_chunks).alias("_value"))
              .where(F.col("_value").isNotNull() & F.col("chunk").isNotNull())
              .withColumn("_start", F.lit(True)))
    earlier_rows = (Window.partitionBy(*part).orderBy(F.col("arrival_seq").asc_nulls_first())
                    .rowsBetween(Window.unboundedPreceding, -1))
    return (valued.withColumn("_start", F.lit(False))
            .unionByName(starts, allowMissingColumns=True)
            .withColumn(out, how(F.col("_value")).over(earlier_rows))
            .where(~F.col("_start"))
            .drop("_start", "_value"))
