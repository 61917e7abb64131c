"""Kafka topics as source and sink of records (needs the Kafka connector package)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.arrival import assign_arrival_seq
from .envelope import HEADERS

# Fixed value: where a new consumer starts.
START = "earliest"
ARRIVAL_ORDER = ["timestamp", "topic", "partition", "offset"]


def source_options(servers: str, topic: str, start: str = START,
                   max_per_trigger: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic,
               "startingOffsets": start, "includeHeaders": "true"}
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of the Kafka source with text key and value and the broker time as store clock."""
    return rows.select("topic", "partition", "offset", F.col("key").cast("string"),
                       F.col("value").cast("string"), "timestamp", "headers",
                       F.unix_millis("timestamp").alias("ingest_ms"))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The whole topic as a batch, in arrival order."""
    rows = spark.read.format("kafka").options(**source_options(servers, topic)).load()
    return in_arrival_order(as_records(rows))


def in_arrival_order(records: DataFrame) -> DataFrame:
    """Number the records by broker time, then topic, partition and offset."""
    return assign_arrival_seq(records, ARRIVAL_ORDER)


def stream_topic(spark: SparkSession, servers: str, topic: str,
                 max_per_trigger: int | None = None) -> DataFrame:
    """The topic as a stream. A micro-batch is numbered when it is verified."""
    options = source_options(servers, topic, max_per_trigger=max_per_trigger)
    return as_records(spark.readStream.format("kafka").options(**options).load())


def to_topic_rows(records: DataFrame, topic: str) -> DataFrame:
    """Columns that the Kafka sink takes."""
    return records.select(F.lit(topic).alias("topic"), F.col("key").cast("binary").alias("key"),
                          F.col("value").cast("binary").alias("value"),
                          F.col("headers").cast(HEADERS).alias("headers"))


def write_topic(records: DataFrame, servers: str, topic: str) -> None:
    (to_topic_rows(records, topic).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save())


def stream_to_topic(records: DataFrame, servers: str, topic: str,
                    checkpoint: str) -> DataStreamWriter:
    return (to_topic_rows(records, topic).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("includeHeaders", "true")
            .option("checkpointLocation", checkpoint))
