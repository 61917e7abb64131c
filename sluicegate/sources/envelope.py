"""The record envelope as a table, and record files as source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                    T.StructField("value", T.BinaryType())]))
RECORD_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("headers", HEADERS),
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("ingest_ms", T.LongType()),
])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).parquet(path)


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Record files as a stream; files are taken in the order they were written."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def verdict_stream(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of verdicts to parquet files."""
    return (df.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def memory_stream(df: DataFrame, name: str) -> DataStreamWriter:
    """Writer to an in-memory table, for tests."""
    return df.writeStream.format("memory").queryName(name).outputMode("append")
