from __future__ import annotations

import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from sluicegate.functions.headers import MESSAGE_ID, SENDER, SENDER_TIMESTAMP  # noqa: E402
from sluicegate.sources.envelope import RECORD_SCHEMA  # noqa: E402
from tools.session import session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", partitions=4, memory="6g")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def make_records(spark):
    """Raw records from dicts; missing fields get plain values in arrival order."""
    def make(rows: list[dict]):
        out = []
        for i, row in enumerate(rows):
            headers = [(name, value.encode()) for name, value in (
                (SENDER, row.get("sender")), (SENDER_TIMESTAMP, row.get("time")),
                (MESSAGE_ID, row.get("id"))) if value is not None]
            headers = row["headers"] if "headers" in row else headers
            ingest = row.get("ingest", i)
            out.append((row.get("topic", "t"), row.get("part", 0), row.get("off", i), None,
                        row.get("value", "v"),
                        datetime.fromtimestamp(ingest / 1000, timezone.utc),
                        headers, i, ingest))
        return spark.createDataFrame(out, RECORD_SCHEMA)
    return make


def uid(n: int) -> str:
    return f"00000000-0000-0000-0000-{n:012d}"


def in_order(df, *columns):
    rows = df.orderBy("arrival_seq").select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]
