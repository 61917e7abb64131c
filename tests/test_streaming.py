import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluicegate import catalogue
from sluicegate.operators import reports
from sluicegate.operators.chain import verify_chain
from sluicegate.operators.normalize import normalise
from sluicegate.plans.checks import default_checks
from sluicegate.sources.envelope import (RECORD_SCHEMA, memory_stream, read_records,
                                         stream_records, verdict_stream, write_table)
from sluicegate.sources.records import load_records
from sluicegate.streaming.consumer import (Consumer, state_keys, state_offsets, state_watermarks)
from sluicegate.streaming import lanes
from sluicegate.streaming.lanes import lane_column, verify_stream
from tests.conftest import SF_SMALL, in_order
from tests.model import judge
from tests.test_chain import as_model, random_rows


def slices(spark, path, n):
    records = load_records(spark, SF_SMALL).select(*RECORD_SCHEMA.names)
    size = -(-records.count() // n)
    for i in range(n):
        write_table(records.where(F.floor(F.col("arrival_seq") / size) == i).coalesce(1),
                    path, "append")
        yield i


@pytest.mark.parametrize("threshold, cap, chunk_rows", [(0, 10_000, 262_144), (500, 100, 200)])
def test_consumer_equals_batch_over_restarts(spark, tmp_path, threshold, cap, chunk_rows):
    """Two runs over three micro-batches, the second resumed from the checkpoint."""
    checks = default_checks(threshold, cap)
    consumer = Consumer(str(tmp_path / "out"), checks, chunk_rows)
    for i in slices(spark, str(tmp_path / "in"), 3):
        if i:
            stream = stream_records(spark, str(tmp_path / "in"), 1)
            consumer.start(stream).awaitTermination()
    batch = verify_chain(normalise(load_records(spark, SF_SMALL)), checks).verdicts
    assert in_order(consumer.verdicts(spark), "failed_by") == in_order(batch, "failed_by")

    state = consumer.state(spark, 2)
    offsets = {tuple(r) for r in reports.latest_offsets(batch).collect()}
    assert {tuple(r) for r in state_offsets(state).collect()} == offsets
    marks = {tuple(r) for r in reports.all_watermarks(batch).collect()}
    assert {tuple(r) for r in state_watermarks(state).collect()} == marks
    if threshold == 0:
        assert state_keys(state).count() == 431


def test_consumer_batch_may_run_twice(spark, tmp_path):
    records = load_records(spark, SF_SMALL)
    consumer = Consumer(str(tmp_path / "out"))
    parts = [records.where("arrival_seq < 500"), records.where("arrival_seq >= 500")]
    for batch_id, part in [(0, parts[0]), (1, parts[1]), (1, parts[1])]:
        consumer.process(part, batch_id)
    batch = verify_chain(normalise(records)).verdicts
    assert in_order(consumer.verdicts(spark), "failed_by") == in_order(batch, "failed_by")


def test_topic_numbers_and_clock_go_on(spark, tmp_path):
    """Three batches, one empty and one with broker times that fall back; one batch is repeated."""
    topic = load_records(spark, SF_SMALL).drop("arrival_seq", "ingest_ms", "event_id", "kind")
    ms = F.unix_millis("timestamp")
    edge = topic.select(F.percentile_approx(ms, 0.5)).first()[0]
    early = topic.where(ms <= edge)
    late = topic.where(ms > edge).withColumn("timestamp", F.timestamp_millis(ms - 100_000))
    clocked = F.unix_millis("timestamp").alias("ingest_ms")
    consumer = Consumer(str(tmp_path / "out"), payload=True)
    for batch_id, part in [(0, early), (1, topic.where("false")), (2, late), (2, late)]:
        consumer.process(part.select("*", clocked), batch_id)
    verdicts = consumer.verdicts(spark)
    numbers = [r.arrival_seq for r in verdicts.select("arrival_seq").collect()]
    assert sorted(numbers) == list(range(topic.count()))

    total = early.count()
    model = (early.withColumn("half", F.lit(0)).unionByName(late.withColumn("half", F.lit(1)))
             .withColumn("arrival_seq", F.row_number().over(Window.orderBy(
                 "half", "timestamp", "topic", "partition", "offset")).cast("bigint") - 1)
             .withColumn("ingest_ms", F.greatest(F.unix_millis("timestamp"), F.when(
                 F.col("half") == 1, edge))))
    batch = verify_chain(normalise(model)).verdicts
    assert in_order(verdicts, "failed_by") == in_order(batch, "failed_by")
    assert total < len(numbers)
    assert consumer.accepted(spark).count() == verdicts.where("verified").count()
    rejected = consumer.rejected(spark)
    assert rejected.count() == verdicts.where("not verified").count()
    assert rejected.where("value is null or failed_by is null").count() == 0


def test_state_is_a_log(spark, tmp_path):
    """Deltas of changed keys, a base every third batch, older folders go; a batch runs twice."""
    records = load_records(spark, SF_SMALL)
    consumer, plain = Consumer(str(tmp_path / "a"), merge_every=3), Consumer(str(tmp_path / "b"))
    n, seen = 8, []
    for batch_id in (0, 1, 2, 2, 3, 4, 5, 6, 7):
        part = records.where(F.floor(F.col("arrival_seq") * n / 1_112) == batch_id)
        consumer.process(part, batch_id)
        seen.append(sorted(p.name for p in (tmp_path / "a" / "state").iterdir()))
    names = lambda *parts: [f"{batch:010d}-{kind}" for batch, kind in parts]
    assert seen[1] == names((0, "delta"), (1, "delta"))
    assert seen[2] == seen[3] == names((0, "delta"), (1, "delta"), (2, "base"))
    assert seen[4] == names((2, "base"), (3, "delta"))
    assert seen[-1] == names((5, "base"), (6, "delta"), (7, "delta"))
    rows = {batch: spark.read.parquet(str(tmp_path / "a" / "state" / name)).count()
            for batch, name in zip((5, 6), seen[-1])}
    assert rows[6] < rows[5]
    plain.process(records, 0)
    shape = ["check", "key", "pieces", "text", "stores", "clock"]
    got = [{str(tuple(r)) for r in c.state(spark).select(*shape).collect()} for c in (consumer, plain)]
    assert got[0] == got[1]


def test_state_has_only_keys_that_a_record_can_meet(spark, tmp_path):
    """A batch of many keys writes those that its store still holds, not all that it saw."""
    records = load_records(spark, SF_SMALL)
    consumer = Consumer(str(tmp_path / "out"), default_checks(cap=20), 200)
    for batch_id, side in enumerate(("arrival_seq < 500", "arrival_seq >= 500")):
        consumer.process(records.where(side), batch_id)
        written = spark.read.parquet(consumer._state_path(batch_id, "delta"))
        assert written.where("check = 'uniqueness'").count() == 20
    batch = verify_chain(normalise(records), default_checks(cap=20)).verdicts
    assert in_order(consumer.verdicts(spark), "failed_by") == in_order(batch, "failed_by")


def test_lanes_equal_batch(spark, tmp_path):
    checks = default_checks(cap=None, ttl_ms=None)
    list(slices(spark, str(tmp_path / "in"), 2))
    verdicts = verify_stream(stream_records(spark, str(tmp_path / "in"), 1), checks=checks)
    query = verdict_stream(verdicts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    batch = verify_chain(normalise(load_records(spark, SF_SMALL)), checks).verdicts
    got = spark.read.parquet(str(tmp_path / "out"))
    columns = ("failed_by", "uniq_outcome", "offset_outcome", "wm_outcome")
    assert in_order(got, *columns) == in_order(batch, *columns)


def test_lane_buckets_split_and_lose_no_key(spark, monkeypatch, tmp_path):
    """Many buckets over several micro-batches; the state holds every live key of the batch run."""
    monkeypatch.setattr(lanes, "FILL", 3)
    checks = default_checks(cap=None, ttl_ms=None)
    list(slices(spark, str(tmp_path / "in"), 4))
    verdicts = verify_stream(stream_records(spark, str(tmp_path / "in"), 1), checks=checks)
    query = verdict_stream(verdicts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    batch = verify_chain(normalise(load_records(spark, SF_SMALL)), checks).verdicts
    assert in_order(spark.read.parquet(str(tmp_path / "out")), "failed_by") == in_order(batch, "failed_by")
    state = lanes.lane_state(spark, str(tmp_path / "checkpoint"), checks)
    assert {tuple(r) for r in state_offsets(state).collect()} == {
        tuple(r) for r in reports.latest_offsets(batch).collect()}
    stored = batch.where("verified and message_id is not null and sender_key is not null")
    assert {tuple(r) for r in state_keys(state).select("sender_key", "message_id").collect()} == {
        tuple(r) for r in stored.select("sender_key", "message_id").collect()}
    entries = (spark.read.format("statestore").option("stateVarName", "states")
               .load(str(tmp_path / "checkpoint")).where("user_map_key.check = 'uniqueness'"))
    assert 1 < entries.count() < stored.count() / 2


class _Entries(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)


def test_lane_state_needs_no_call_for_each_key():
    states, sizes, model = _Entries(), _Entries(), {}
    for batch in range(6):
        after = {f"k{i}": (i, batch, "a\tb\nc") for i in range(batch * 3_000, batch * 3_000 + 5_000)}
        after |= {f"k{i}": None for i in range(batch * 100)}
        lanes._Buckets("c", states, sizes).put(after)
        model = {name: state for name, state in (model | after).items() if state is not None}
        held = lanes._Buckets("c", states, sizes)
        assert held.keys == len(model) and held.get([f"k{i}" for i in range(30_000)]) == model
    assert states.calls < 6 * 5_000 / 10


def test_lane_stream_query_in_parts(spark, monkeypatch):
    """Resumed for every part of the records, the stream gives the same verdicts and state."""
    names = ("stream_lane_store", "stream_lane_keys", "stream_lane_offsets")
    whole = [sorted(map(tuple, catalogue.QUERIES[name](spark, SF_SMALL).collect())) for name in names]
    monkeypatch.setattr(catalogue, "LANE_ROWS", 300)
    parts = [sorted(map(tuple, catalogue.QUERIES[name](spark, SF_SMALL).collect())) for name in names]
    assert parts == whole and all(whole)


def test_lane_stores_forget(spark, make_records, tmp_path):
    """Small stores over several micro-batches and slots of the index; each lane is a store."""
    rows = random_rows(21, 400, 3, 25, 0.2)
    checks = default_checks(50, 8, 90)
    for at in range(0, 400, 100):
        write_table(make_records(rows).where(f"arrival_seq >= {at} and arrival_seq < {at + 100}")
                    .coalesce(1), str(tmp_path / "in"), "append")
    verdicts = verify_stream(stream_records(spark, str(tmp_path / "in"), 1), checks=checks)
    query = verdict_stream(verdicts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = dict(zip(*zip(*in_order(spark.read.parquet(str(tmp_path / "out")), "arrival_seq", "failed_by"))))
    for part in (0, 1):
        own = [i for i, row in enumerate(rows) if row["part"] == part]
        want, *_ = judge(as_model([rows[i] for i in own]), 50, 8, 90)
        assert [got[i] for i in own] == want


def test_sender_lanes_see_ids_across_partitions(spark, make_records, tmp_path):
    from tests.conftest import uid
    rows = [{"sender": "s1", "id": uid(1), "part": 0, "off": 0},
            {"sender": " s1", "id": uid(1), "part": 1, "off": 0},
            {"sender": "s2", "id": uid(1), "part": 1, "off": 1}]
    write_table(make_records(rows), str(tmp_path / "in"))
    verdicts = verify_stream(stream_records(spark, str(tmp_path / "in")), "sender")
    query = memory_stream(verdicts, "sender_lanes").trigger(availableNow=True).start()
    query.awaitTermination()
    assert in_order(spark.table("sender_lanes"), "failed_by") == [None, "uniqueness", None]
    with pytest.raises(ValueError):
        lane_column("other")


def test_record_files_round_trip(spark, make_records, tmp_path):
    write_table(make_records([{"sender": "s"}]), str(tmp_path / "r"))
    got = read_records(spark, str(tmp_path / "r"))
    assert got.schema == RECORD_SCHEMA and got.count() == 1
