import pytest

from sluicegate.operators import reports
from sluicegate.operators.chain import verify_chain
from sluicegate.operators.normalize import normalise
from sluicegate.operators.single import (verify_offsets, verify_uniqueness,
                                         verify_uniqueness_expiring, verify_watermarks)
from sluicegate.plans.checks import SenderWatermark
from tests.conftest import in_order, uid


def timed(*rows):
    return [{"sender": s, "part": p, "off": o, "time": str(t)} for s, p, o, t in rows]


WATERMARK_CASES = {
    "first": (timed(("s1", 0, 0, 1000)), 0, [True]),
    "in order": (timed(("s1", 0, 0, 1000), ("s1", 0, 1, 2000)), 0, [True, True]),
    "late": (timed(("s1", 0, 0, 2000), ("s1", 0, 1, 1000)), 0, [True, False]),
    "two senders": (timed(("s1", 0, 0, 1000), ("s2", 0, 1, 500)), 0, [True, True]),
    "two partitions": (timed(("s1", 0, 0, 1000), ("s1", 1, 0, 500)), 0, [True, True]),
    "within": (timed(("s1", 0, 0, 2000), ("s1", 0, 1, 1500)), 1000, [True, True]),
    "beyond": (timed(("s1", 0, 0, 2000), ("s1", 0, 1, 1000)), 500, [True, False]),
    "creep": (timed(*[("s1", 0, i, t) for i, t in enumerate((2000, 1500, 1000, 400))]), 500,
              [True, True, True, False]),
    "equal": (timed(("s1", 0, 0, 1000), ("s1", 0, 1, 1000)), 0, [True, True]),
    "negative threshold": (timed(("s1", 0, 0, 1000), ("s1", 0, 1, 999)), -5, [True, False]),
    "bad time": ([{"sender": "s1", "time": "invalid-timestamp"}], 0, [True]),
    "no headers": ([{"headers": None}], 0, [True]),
    "empty sender is one": (timed(("", 0, 0, 1000), ("", 0, 1, 500)), 0, [True, False]),
}


@pytest.mark.parametrize("name", WATERMARK_CASES)
@pytest.mark.parametrize("chunk_rows", [1, 1000])
def test_watermark(make_records, name, chunk_rows):
    rows, threshold, want = WATERMARK_CASES[name]
    judged = verify_watermarks(normalise(make_records(rows)), threshold, chunk_rows)
    assert in_order(judged, "verified") == want


@pytest.mark.parametrize("name, rows, threshold, want", [
    ("in order", timed(("s1", 0, 0, 1000), ("s1", 0, 1, 2000)), 0, {("s1", 0): 2000}),
    ("late", timed(("s1", 0, 0, 2000), ("s1", 0, 1, 1000)), 0, {("s1", 0): 2000}),
    ("creep", timed(*[("s1", 0, i, t) for i, t in enumerate((2000, 1500, 1000, 400))]), 500,
     {("s1", 0): 1000}),
    ("two", timed(("s1", 0, 0, 1000), ("s2", 0, 1, 500)), 0, {("s1", 0): 1000, ("s2", 0): 500}),
    ("bad time", [{"sender": "s1", "time": "invalid-timestamp"}], 0, {})])
def test_final_watermark(make_records, name, rows, threshold, want):
    run = verify_chain(normalise(make_records(rows)), [SenderWatermark(threshold)])
    got = {(r.sender_raw, r.partition): r.watermark_ms
           for r in reports.all_watermarks(run.verdicts).collect()}
    assert got == want


U = "unique"
UNIQUENESS_CASES = {
    "missing": ([{"sender": "s1"}, {"id": uid(1)}, {}],
                ["no_message_id", "no_sender", "no_sender"]),
    "duplicate": ([{"sender": "s1", "id": uid(1)}] * 3, [U, "duplicate", "duplicate"]),
    "other sender": ([{"sender": "s1", "id": uid(1)}, {"sender": "s2", "id": uid(1)}], [U, U]),
    "bad ids": ([{"sender": "s1", "id": t} for t in ("invalid-uuid", "", "   ")] * 2,
                ["invalid_uuid", "no_message_id", "no_message_id"] * 2),
    "padded": ([{"sender": "  s1  ", "id": f"  {uid(1)}  "}, {"sender": "s1", "id": uid(1)}],
               [U, "duplicate"]),
    "empty sender": ([{"sender": "", "id": uid(1)}] * 2, ["no_sender", "no_sender"]),
    "upper case": ([{"sender": "s1", "id": "a" + uid(1)[1:]},
                    {"sender": "s1", "id": "A" + uid(1)[1:]}], [U, "duplicate"]),
}


@pytest.mark.parametrize("name", UNIQUENESS_CASES)
@pytest.mark.parametrize("chunk_rows", [1, 1000])
def test_uniqueness(make_records, name, chunk_rows):
    rows, want = UNIQUENESS_CASES[name]
    normalised = normalise(make_records(rows))
    assert in_order(verify_uniqueness(normalised, chunk_rows), "uniq_outcome") == want
    assert in_order(verify_uniqueness_expiring(normalised, chunk_rows=chunk_rows),
                    "uniq_outcome") == want


@pytest.mark.parametrize("chunk_rows", [1, 2, 1000])
def test_expiry_counts_at_stores_only(make_records, chunk_rows):
    idle = [{"sender": "s1", "id": uid(1), "ingest": t} for t in (0, 400_000)]
    judged = verify_uniqueness_expiring(normalise(make_records(idle)), chunk_rows=chunk_rows)
    assert in_order(judged, "uniq_outcome") == ["unique", "duplicate"]
    busy = [(1, 0), (2, 400_000), (1, 400_001)]
    rows = [{"sender": "s1", "id": uid(n), "ingest": t} for n, t in busy]
    judged = verify_uniqueness_expiring(normalise(make_records(rows)), chunk_rows=chunk_rows)
    assert in_order(judged, "uniq_outcome") == ["unique"] * 3
    edge = [(1, 0), (2, 300_000), (1, 300_000)]  # an age equal to the limit is kept
    rows = [{"sender": "s1", "id": uid(n), "ingest": t} for n, t in edge]
    judged = verify_uniqueness_expiring(normalise(make_records(rows)), chunk_rows=chunk_rows)
    assert in_order(judged, "uniq_outcome") == ["unique", "unique", "duplicate"]


@pytest.mark.parametrize("chunk_rows", [1, 2, 1000])
def test_offsets(make_records, chunk_rows):
    rows = [{"off": o} for o in (0, 1, 1, 0, 5, 3, 6)] + [{"off": 0, "part": 1}]
    judged = verify_offsets(normalise(make_records(rows)), chunk_rows)
    assert in_order(judged, "offset_outcome") == [
        "first", "in_order", "out_of_order", "out_of_order", "in_order", "out_of_order",
        "in_order", "first"]
    assert in_order(judged, "prev_offset") == [None, 0, 1, 1, 1, 5, 5, None]


def test_offset_lookup(spark, make_records):
    rows = [{"off": o} for o in (0, 1, 1, 0, 5, 3, 6)]
    offsets = reports.latest_offsets(verify_chain(normalise(make_records(rows))).verdicts)
    wanted = spark.createDataFrame([("t", 0), ("t", 9)], "topic string, partition int")
    got = {r.partition: r.latest_offset
           for r in reports.look_up_offsets(wanted, offsets).collect()}
    assert got == {0: 6, 9: -1}
