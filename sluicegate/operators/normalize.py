"""From the raw record envelope to typed key columns: one narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H

NORMALISED = ["arrival_seq", "topic", "partition", "offset", "sender_raw", "sender_key",
              "time_given", "sender_ts", "id_given", "message_id", "ingest_ms"]


def envelope(records: DataFrame) -> DataFrame:
    """Topic, partition, offset, key and value."""
    return records.select("topic", "partition", "offset", "key", "value")


def header_columns(records: DataFrame, *keep: str) -> DataFrame:
    """The three header texts, last value of a name wins."""
    return records.select(
        *keep,
        H.header_last(F.col("headers"), H.SENDER).alias("sender_raw"),
        H.header_last(F.col("headers"), H.SENDER_TIMESTAMP).alias("time_text"),
        H.header_last(F.col("headers"), H.MESSAGE_ID).alias("id_text"),
    )


def normalise(records: DataFrame, *keep: str) -> DataFrame:
    """Typed columns for the checks; ``keep`` names further columns to pass through.

    ``sender_raw`` is the header as it came (watermark check), ``sender_key`` is trimmed and
    NULL when blank (uniqueness check). ``time_given`` and ``id_given`` tell a missing header
    from one that cannot be parsed. The payload is left out: no check reads it.
    """
    base = ["arrival_seq", "topic", "partition", "offset", "ingest_ms"]
    passed = [c for c in keep if c not in base]
    texts = header_columns(records, *base, *passed).withColumns({
        "sender_text": H.trim_blank(F.col("sender_raw")),
        "id_text": H.trim_blank(F.col("id_text")),
    })
    return texts.select(
        "arrival_seq", "topic", "partition", "offset",
        "sender_raw",
        H.null_if_empty(F.col("sender_text")).alias("sender_key"),
        F.col("time_text").isNotNull().alias("time_given"),
        H.parse_epoch_ms(F.col("time_text")).alias("sender_ts"),
        F.coalesce(F.col("id_text") != "", F.lit(False)).alias("id_given"),
        H.uuid_canonical(F.col("id_text")).alias("message_id"),
        "ingest_ms",
        *passed,
    )


def is_keyed():
    """True for records that the uniqueness check can judge."""
    return F.col("sender_key").isNotNull() & F.col("message_id").isNotNull()


def is_timed():
    """True for records that the watermark check can judge."""
    return F.col("sender_raw").isNotNull() & F.col("sender_ts").isNotNull()


def record_keys(normalised: DataFrame) -> DataFrame:
    """The three composite keys in readable form; NULL where a part is missing."""
    return normalised.select(
        "arrival_seq",
        F.format_string("%s-%d", "topic", "partition").alias("topic_partition"),
        F.when(is_timed(), H.sender_partition_text(
            F.col("sender_raw"), F.col("topic"), F.col("partition"))).alias("sender_partition"),
        H.key_text(F.col("sender_key"), F.col("message_id")).alias("key_text"),
        F.when(is_keyed(), H.sender_message_text(
            F.col("sender_key"), F.col("message_id"))).alias("sender_message"),
    )


def bypassed_records(normalised: DataFrame) -> DataFrame:
    """Records that at least one check cannot judge and therefore lets pass."""
    return (normalised
            .select("arrival_seq", (~is_keyed()).alias("bypasses_uniqueness"),
                    (~is_timed()).alias("bypasses_watermark"))
            .where("bypasses_uniqueness or bypasses_watermark"))
