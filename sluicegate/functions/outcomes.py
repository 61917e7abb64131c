"""Verdicts and outcome classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headers import sender_partition_text

# Verdict names and check names.
SUCCESS = "SUCCESS"
FAILED_LATE_ARRIVAL = "FAILED_LATE_ARRIVAL"
FAILED_DUPLICATE = "FAILED_DUPLICATE"

UNIQUENESS = "uniqueness"
OFFSET = "offset"
SENDER_WATERMARK = "sender_watermark"


def is_verified(verdict: Column) -> Column:
    return verdict == F.lit(SUCCESS)


def uniqueness_outcome(duplicate: Column) -> Column:
    """no_sender, no_message_id, invalid_uuid, duplicate or unique."""
    return (F.when(F.col("sender_key").isNull(), "no_sender")
            .when(~F.col("id_given"), "no_message_id")
            .when(F.col("message_id").isNull(), "invalid_uuid")
            .when(duplicate, "duplicate")
            .otherwise("unique"))


def offset_outcome(prev_offset: Column) -> Column:
    """first, in_order or out_of_order; an equal offset is out of order."""
    return (F.when(prev_offset.isNull(), "first")
            .when(F.col("offset") > prev_offset, "in_order")
            .otherwise("out_of_order"))


def lateness_ms(prev_watermark: Column) -> Column:
    """Watermark minus sender time, positive when late; NULL if either is missing."""
    return F.try_subtract(prev_watermark, F.col("sender_ts"))


def watermark_outcome(prev_watermark: Column, threshold_ms: int) -> Column:
    """no_headers, invalid_timestamp, first, in_order, late_accepted or late_rejected.

    The lateness is NULL when it does not fit 64 bits; such a record is beyond any threshold.
    """
    tolerated = lateness_ms(prev_watermark) <= F.lit(max(0, threshold_ms))
    return (F.when(F.col("sender_raw").isNull() | ~F.col("time_given"), "no_headers")
            .when(F.col("sender_ts").isNull(), "invalid_timestamp")
            .when(prev_watermark.isNull(), "first")
            .when(F.col("sender_ts") >= prev_watermark, "in_order")
            .when(tolerated, "late_accepted")
            .otherwise("late_rejected"))


def reason(failed_by: Column, prev_offset: Column, prev_watermark: Column,
           threshold_ms: int) -> Column:
    """One line of text that says why a record was rejected; NULL if it was not."""
    return (
        F.when(failed_by == UNIQUENESS,
               F.format_string("message id %s of sender %s is already stored",
                               F.col("message_id"), F.col("sender_key")))
        .when(failed_by == OFFSET,
              F.format_string("offset %d of %s-%d is not above %d", F.col("offset"),
                              F.col("topic"), F.col("partition"), prev_offset))
        .when(failed_by == SENDER_WATERMARK,
              F.format_string("%s is %d ms behind %d, threshold %d ms",
                              sender_partition_text(F.col("sender_raw"), F.col("topic"),
                                                    F.col("partition")),
                              lateness_ms(prev_watermark), prev_watermark,
                              F.lit(max(0, threshold_ms))))
        .when(failed_by.isNotNull(), F.concat(F.lit("rejected by check "), failed_by))
    )
