"""Each check on its own over a table of records.

Without an age limit or lateness threshold the state is a running value of all earlier
records, so the verdict is a window expression. The other two cases walk chunks like the
chain does, with one check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcomes as O
from ..functions.headers import key_text
from ..plans.arrival import CHUNK_ROWS, split_into_chunks
from ..plans.checks import LATE_THRESHOLD_MS, STORE_SIZE, STORE_TTL_MS, SenderWatermark, Uniqueness
from ..plans.running import running_before
from .chain import verify_chain
from .normalize import is_keyed, is_timed


def _verdict(rejected: Column, verdict: str) -> dict[str, Column]:
    result = F.when(rejected, verdict).otherwise(O.SUCCESS)
    return {"verdict": result, "verified": O.is_verified(result)}


def verify_uniqueness(normalised: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A record is a duplicate if an earlier one has its (sender, message id)."""
    needed = normalised.select("arrival_seq", "sender_key", "message_id", "id_given")
    chunked = split_into_chunks(needed, chunk_rows).df
    # Records without a key count for nobody: they have no value and are never duplicates.
    seen = running_before(chunked, ["sender_key", "message_id"],
                          F.when(is_keyed(), F.lit(1)), "_seen")
    duplicate = is_keyed() & F.col("_seen").isNotNull()
    return seen.select("arrival_seq", "sender_key", "message_id",
                       *[c.alias(n) for n, c in
                         _verdict(duplicate, O.FAILED_DUPLICATE).items()],
                       O.uniqueness_outcome(duplicate).alias("uniq_outcome"))


def verify_uniqueness_expiring(normalised: DataFrame, cap: int | None = STORE_SIZE,
                               ttl_ms: int | None = STORE_TTL_MS,
                               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As above with a key store that forgets by size and age."""
    run = verify_chain(normalised, [Uniqueness(cap, ttl_ms)], chunk_rows)
    return run.verdicts.select("arrival_seq", "sender_key", "message_id", "verdict", "verified",
                               "uniq_outcome")


def verify_offsets(normalised: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """An offset must be above all earlier ones of its topic partition."""
    needed = normalised.select("arrival_seq", "topic", "partition", "offset")
    chunked = split_into_chunks(needed, chunk_rows).df
    judged = running_before(chunked, ["topic", "partition"], F.col("offset"), "prev_offset")
    outcome = O.offset_outcome(F.col("prev_offset"))
    return judged.select("arrival_seq", "topic", "partition", "offset", "prev_offset",
                         *[c.alias(n) for n, c in
                           _verdict(outcome == "out_of_order", O.FAILED_LATE_ARRIVAL).items()],
                         outcome.alias("offset_outcome"))


def verify_watermarks(normalised: DataFrame, threshold_ms: int = LATE_THRESHOLD_MS,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A sender's time must not be behind its last accepted one by more than the threshold.

    Accepting a late record moves the watermark back, so with a threshold it is no running
    maximum; a chunk is then summed up by two numbers per key (see the limit gate).
    """
    columns = ["arrival_seq", "topic", "partition", "sender_raw", "sender_ts", "prev_watermark",
               "verdict", "verified", "wm_outcome"]
    if threshold_ms > 0:
        run = verify_chain(normalised, [SenderWatermark(threshold_ms)], chunk_rows)
        return run.verdicts.select(*columns)
    needed = normalised.select("arrival_seq", "topic", "partition", "sender_raw", "time_given",
                               "sender_ts")
    chunked = split_into_chunks(needed, chunk_rows).df
    judged = running_before(chunked, ["sender_raw", "topic", "partition"],
                            F.when(is_timed(), F.col("sender_ts")), "_prev")
    judged = judged.withColumn("prev_watermark", F.when(is_timed(), F.col("_prev")))
    outcome = O.watermark_outcome(F.col("prev_watermark"), threshold_ms)
    return judged.withColumns({
        "wm_outcome": outcome,
        **_verdict(outcome == "late_rejected", O.FAILED_LATE_ARRIVAL),
    }).select(*columns)


def stored_offsets(normalised: DataFrame) -> DataFrame:
    """Offset of the last record of each topic partition: storing without a check."""
    return (normalised.groupBy("topic", "partition")
            .agg(F.max_by("offset", "arrival_seq").alias("stored_offset")))


def stored_watermarks(normalised: DataFrame) -> DataFrame:
    """Time of the last timed record of each sender and partition: storing without a check."""
    return (normalised.where(is_timed()).groupBy("sender_raw", "topic", "partition")
            .agg(F.max_by("sender_ts", "arrival_seq").alias("stored_watermark")))


def stored_keys(normalised: DataFrame) -> DataFrame:
    """Last store of each key, if every keyed record is stored."""
    return (normalised.where(is_keyed()).groupBy("sender_key", "message_id")
            .agg(F.max("ingest_ms").alias("stored_ms"), F.max("arrival_seq").alias("stored_seq"))
            .withColumn("key_text", key_text(F.col("sender_key"), F.col("message_id"))))
