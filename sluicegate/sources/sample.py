"""Five sample records for demos and tests: the fourth repeats the id of the second."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..functions.headers import MESSAGE_ID, SENDER, SENDER_TIMESTAMP
from .envelope import RECORD_SCHEMA

# Topic name and message text of the sample.
SAMPLE_TOPIC = "watermark-topic"
SAMPLE_TEXT = "Watermark message"

_START_MS = 1_700_000_000_000
_IDS = ["00000000-0000-0000-0000-00000000000" + n for n in "12325"]


def sample_records(spark: SparkSession, senders=("s1", "s2", "s1", "s2", "s1")) -> DataFrame:
    rows = []
    for i, (sender, message_id) in enumerate(zip(senders, _IDS)):
        ms = _START_MS + 1000 * i
        headers = [(SENDER, sender.encode()), (SENDER_TIMESTAMP, str(ms).encode()),
                   (MESSAGE_ID, message_id.encode())]
        rows.append((SAMPLE_TOPIC, 0, i, None, f"{SAMPLE_TEXT} {i + 1}",
                     datetime.fromtimestamp(ms / 1000, timezone.utc), headers, i, ms))
    return spark.createDataFrame(rows, RECORD_SCHEMA)
