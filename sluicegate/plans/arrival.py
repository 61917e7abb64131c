"""Arrival order at scale: dense sequence numbers and bounded chunks of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

CHUNK_ROWS = 262_144
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_MAX_GAP = 4


def assign_arrival_seq(df: DataFrame, order: list[str], out: str = "arrival_seq",
                       partitions: int | None = None) -> DataFrame:
    """Number rows 0, 1, 2, ... in the order of ``order`` without a one-task window.

    Range partitions are sorted in parallel; the count of rows in earlier partitions is
    added to the row number inside the partition. ``order`` must be unique.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_id = F.monotonically_increasing_id()
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.shiftright(row_id, _ROW_BITS))
              .withColumn("_row", row_id.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    # Range bounds are sampled, so the split has to be fixed before it is counted.
    fixed = materialise(ranged, "arrival")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (fixed.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    return (fixed.join(starts, "_part")
            .withColumn(out, F.col("_start") + F.col("_row"))
            .drop("_part", "_row", "_start"))


@dataclass(frozen=True)
class Chunked:
    """Rows with a ``chunk`` column that rises with ``arrival_seq``."""

    df: DataFrame
    chunks: int
    rows: int


def chunk_column(seq: str, first: int, chunk_rows: int) -> Column:
    """Number of the chunk of column ``seq``, by whole-number division."""
    return F.expr(f"({seq} - {first}L) div {chunk_rows}L")


def split_into_chunks(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Chunked:
    """Cut the arrival order into chunks of at most ``chunk_rows`` rows.

    ``arrival_seq`` is unique, so a span of that many numbers holds no more rows. If the
    numbers are sparse they are made dense first, which keeps the chunks well filled.
    """
    stats = records.agg(F.count("*").alias("n"), F.min("arrival_seq").alias("lo"),
                        F.max("arrival_seq").alias("hi")).first()
    if not stats["n"]:
        return Chunked(records.withColumn("chunk", F.lit(0).cast("bigint")), 0, 0)
    span = stats["hi"] - stats["lo"] + 1
    if span <= chunk_rows or span <= _MAX_GAP * stats["n"]:
        seq, lo, records_in = "arrival_seq", stats["lo"], records
    else:
        records_in = assign_arrival_seq(records, ["arrival_seq"], out="_dense")
        seq, lo, span = "_dense", 0, stats["n"]
    chunked = records_in.withColumn("chunk", chunk_column(seq, lo, chunk_rows)).drop("_dense")
    return Chunked(chunked, -(-span // chunk_rows), stats["n"])
