"""Record tables derived from the ``events`` table, for tests, checks and benchmarks.

Events arrive in order and are unique, so every 13th is delayed, every 17th is sent again
(kind 1: new offset, every other copy with an upper-case id), every 19th is replayed (kind 2:
old offset), and headers are blanked or damaged on 23, 29, 31 and 37.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import MESSAGE_ID, SENDER, SENDER_TIMESTAMP
from ..plans.arrival import CHUNK_ROWS, assign_arrival_seq, chunk_column
from ..plans.running import running_before
from ..plans.scratch import Scratch, with_settings

TOPIC = "events"
_cache: dict[tuple, DataFrame] = {}


def _header(name: str, text):
    return F.struct(F.lit(name).alias("key"), text.cast("binary").alias("value"))


def _every(n: int):
    return F.col("event_id") % n == 0


def derive_records(events: DataFrame, senders: int = 50, partitions: int = 4,
                   across: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Raw records with headers, one scan of ``events`` and no one-task window.

    ``across`` sends the copies to the next partition, with offsets of their own.
    """
    sender_no = F.col("user_id") % senders
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    delayed = F.col("event_id") * 10 + F.when(_every(13), 2005).otherwise(0)
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(0).alias("shift")),
        F.when(_every(17), F.struct(F.lit(1).alias("kind"), F.lit(3001).alias("shift"))),
        F.when(_every(19), F.struct(F.lit(2).alias("kind"), F.lit(502).alias("shift"))),
    )
    digest = F.md5(F.concat(F.lit("msg-"), F.col("event_id").cast("string")).cast("binary"))
    sent = (events.select("event_id", "user_id", "value", ms.alias("ms"), digest.alias("h"),
                          F.explode(F.array_compact(kinds)).alias("k"))
            .select("event_id", "user_id", "value", "ms", "h", "k.kind",
                    (delayed + F.col("k.shift")).alias("ak"),
                    (sender_no % partitions).cast("int").alias("part")))
    ordered = assign_arrival_seq(sent, ["ak", "event_id", "kind"])
    fresh = F.when(F.col("kind") != 2, 1).otherwise(0)
    numbered = running_before(
        ordered.withColumn("chunk", chunk_column("arrival_seq", 0, chunk_rows)),
        ["part"], fresh, "_earlier", F.sum)
    off0 = F.coalesce("_earlier", F.lit(0)) + fresh - 1
    numbered = numbered.withColumn("off0", off0)
    originals = (numbered.where("kind = 0").where(_every(19))
                 .select("event_id", F.col("off0").alias("base_off")))
    uuid = F.concat_ws("-", *[F.substring("h", at, n) for at, n in
                              ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    sender = F.when(~_every(23), F.concat(F.lit("sender-"), sender_no.cast("string")))
    time = F.when(_every(29), "invalid").otherwise(F.col("ms").cast("string"))
    message_id = (F.when(_every(31), "not-a-uuid").when(_every(37), F.lit(None))
                  .when((F.col("kind") == 1) & _every(2), F.upper(uuid)).otherwise(uuid))
    part, offset = F.col("part"), F.when(F.col("kind") == 2, F.col("base_off")).otherwise(
        F.col("off0"))
    if across:
        part = F.when(F.col("kind") == 1, (part + 1) % partitions).otherwise(part)
        offset = F.when(F.col("kind") == 1, F.col("arrival_seq") + 100_000).otherwise(offset)
    ingest = F.col("arrival_seq") * 500
    headers = F.array_compact(F.array(
        F.when(sender.isNotNull(), _header(SENDER, sender)),
        _header(SENDER_TIMESTAMP, time),
        F.when(message_id.isNotNull(), _header(MESSAGE_ID, message_id))))
    return (numbered.join(originals, "event_id", "left")
            .select(F.lit(TOPIC).alias("topic"), part.cast("int").alias("partition"),
                    offset.cast("bigint").alias("offset"),
                    F.col("event_id").cast("string").alias("key"),
                    F.col("value").cast("string").alias("value"),
                    F.timestamp_millis(ingest).alias("timestamp"), headers.alias("headers"),
                    "arrival_seq", ingest.alias("ingest_ms"), "event_id", "kind"))


def load_records(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Derived records of a data folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(options.items()))
    if key not in _cache:
        # Epoch times are taken from zone-less timestamps, so the zone must be fixed for that.
        other = with_settings(spark, {"spark.sql.session.timeZone": "UTC"})
        records = derive_records(other.read.parquet(f"{sf_dir}/events.parquet"), **options)
        path = Scratch(spark, "records").path("derived")
        records.write.parquet(path)
        _cache[key] = spark.read.schema(records.schema).parquet(path)
    return _cache[key]
