"""State tables and reports over judged records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import SUCCESS
from .normalize import is_keyed, is_timed


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("verified")


def rejected(judged: DataFrame) -> DataFrame:
    """The quarantine side, with the check that failed and why."""
    return judged.where("not verified")


def latest_offsets(judged: DataFrame) -> DataFrame:
    """Last accepted offset per topic partition."""
    return (accepted(judged).groupBy("topic", "partition")
            .agg(F.max_by("offset", "arrival_seq").alias("latest_offset")))


def look_up_offsets(wanted: DataFrame, offsets: DataFrame) -> DataFrame:
    """Latest offset of each wanted (topic, partition), -1 if none was accepted."""
    return (wanted.join(offsets, ["topic", "partition"], "left")
            .withColumn("latest_offset", F.coalesce("latest_offset", F.lit(-1).cast("bigint"))))


def all_watermarks(judged: DataFrame) -> DataFrame:
    """Last accepted sender time per (sender, topic, partition)."""
    return (accepted(judged).where(is_timed())
            .groupBy("sender_raw", "topic", "partition")
            .agg(F.max_by("sender_ts", "arrival_seq").alias("watermark_ms")))


def look_up_watermarks(wanted: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Watermark of each wanted (sender, topic, partition), NULL if there is none."""
    return wanted.join(watermarks, ["sender_raw", "topic", "partition"], "left")


def store_log(judged: DataFrame) -> DataFrame:
    """Key stores in arrival order: the accepted records that have a key."""
    return (accepted(judged).where(is_keyed())
            .select("sender_key", "message_id", F.col("ingest_ms").alias("stored_ms"),
                    F.col("arrival_seq").alias("stored_seq")))


def verdict_summary(judged: DataFrame) -> DataFrame:
    """Records per topic partition, verdict and failing check."""
    return (judged.groupBy("topic", "partition", "verdict", "failed_by")
            .agg(F.count("*").alias("n"), F.min("arrival_seq").alias("first_seq"),
                 F.max("arrival_seq").alias("last_seq")))


def sender_summary(judged: DataFrame) -> DataFrame:
    """Records and rejections per sender."""
    return (judged.groupBy("sender_raw")
            .agg(F.count("*").alias("n"), F.count_if(~F.col("verified")).alias("n_rejected")))


def outcome_counts(judged: DataFrame, outcome: str) -> DataFrame:
    """Records per outcome class; NULL where the check did not run."""
    return judged.groupBy(outcome).agg(F.count("*").alias("n"))


def verdict_report(judged: DataFrame) -> DataFrame:
    """One line per record: verdict, failing check, reason, sender time and id."""
    return judged.select("arrival_seq", "topic", "partition", "offset", "sender_raw",
                         "sender_instant", "message_id", "verdict", "verified", "failed_by",
                         "reason", "uniq_outcome", "offset_outcome", "wm_outcome")


def with_payload(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Raw records with their verdict, for sinks that need key and value again."""
    return records.join(judged.select("arrival_seq", "verdict", "verified", "failed_by"),
                        "arrival_seq")


def accepted_payload(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Raw records that passed. Only the numbers of the rejected ones are looked up, so the
    payload is not shuffled while those fit into a broadcast."""
    gone = rejected(judged).select("arrival_seq")
    return records.join(gone, "arrival_seq", "left_anti").withColumn("verdict", F.lit(SUCCESS))
