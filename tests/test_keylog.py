import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate import catalogue
from sluicegate.operators.chain import verify_chain
from sluicegate.operators.normalize import normalise
from sluicegate.plans.checks import Uniqueness, default_checks
from sluicegate.plans.scratch import with_settings
from sluicegate.sources.envelope import memory_stream, stream_records, write_table
from sluicegate.streaming import keylog, lanes
from sluicegate.streaming.keylog import Digests, KeyLog, key_names
from sluicegate.streaming.lanes import lane_column
from tests.conftest import SF_SMALL, in_order, uid


class _Map(dict):
    """A map state that counts what goes through it."""

    def __init__(self):
        super().__init__()
        self.bytes = 0

    def getValue(self, key):
        self._count(self.get(key))
        return self.get(key)

    def updateValue(self, key, value):
        self._count(value)
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def _count(self, value):
        self.bytes += sum(len(part) for part in value or () if isinstance(part, (str, bytes)))


class _Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, *_):
        return _Value()


def texts(keys):
    return pa.array(keys, pa.list_(pa.string()))


def test_names_are_json_of_any_text():
    odd = ["", "plain", 'a"b', "a\\b", "tab\there", "line\nend", "\x00\x01", "äß€😀", " ", '", "']
    keys = [[a, b] for a in odd for b in odd]
    names = key_names(texts(keys), 2).to_pylist()
    assert [json.loads(name) for name in names] == keys and len(set(names)) == len(keys)
    assert not any("\n" in name or "\t" in name for name in names)


@pytest.mark.parametrize("cap, ttl", [(None, None), (40, None), (None, 300), (60, 200), (3, None)])
def test_log_equals_a_plain_store(monkeypatch, cap, ttl):
    """Batches of all sizes, with blocks of several batches, pieces of a few keys and many merges."""
    monkeypatch.setattr(keylog, "BLOCK_STORES", 16)
    monkeypatch.setattr(keylog, "PIECE_KEYS", 8)
    check, maps, pick = Uniqueness(cap, ttl), [_Map() for _ in range(5)], random.Random(7)
    model, stores, clock, now = {}, 0, None, 0
    for batch in range(60):
        rows = [f"k{pick.randrange(400)}" for _ in range(pick.choice([1, 3, 50]))]
        keys = sorted(set(rows))
        log, names = KeyLog(check, *maps), key_names(texts([["s", key] for key in keys]), 2)
        held, number, time = log.find(Digests.of(names))
        live = held & ~log.dead(number, time, stores, clock)
        want = [key in model and not check.is_dead(*model[key], stores, clock) for key in keys]
        assert live.tolist() == want
        if cap or ttl:
            found = list(zip(number[live].tolist(), time[live].tolist()))
            assert found == [model[key] for key, is_live in zip(keys, want) if is_live]
        taken = {}
        for key in rows:
            now += 1
            if key not in model or check.is_dead(*model[key], stores, clock):
                stores, clock = stores + 1, now
                model[key] = stores, now
                taken.pop(key, None)
                taken[key] = model[key]
        if taken:
            own = key_names(texts([["s", key] for key in taken]), 2)
            numbers, times = (np.array(part) for part in zip(*taken.values()))
            log.store(own, Digests.of(own), numbers, times, stores, clock)
        lines = [line.split("\t") for (entries,) in maps[0].values() for line in entries.split("\n")]
        kept = {json.loads(name)[1]: (state["a"], state["b"]) for name, state in sorted(
            ((name, json.loads(state)) for name, state in lines), key=lambda line: line[1]["a"])}
        alive = {key: state for key, state in model.items() if not check.is_dead(*state, stores, clock)}
        assert {key: state for key, state in kept.items() if not check.is_dead(*state, stores, clock)} == alive
        assert len(KeyLog(check, *maps).runs) < keylog.RUNS + 10
    if cap:
        assert sum(len(entries.split("\n")) for (entries,) in maps[0].values()) < cap + 40
        assert sum(run.keys for run in KeyLog(check, *maps).runs) < cap + 8 * 50


def test_keys_with_half_a_digest_in_common():
    one, maps = np.array([5, 5, 5, 9], np.uint64), [_Map() for _ in range(5)]
    log = KeyLog(Uniqueness(None, None), *maps)
    held = Digests(one, np.array([3, 1, 2, 1], np.uint64))
    log.store(key_names(texts([["s", str(n)] for n in range(4)]), 2), held, np.arange(1, 5), np.arange(4), 4, 3)
    asked = Digests(np.array([9, 5, 5, 5, 5, 9, 1], np.uint64), np.array([1, 2, 4, 1, 3, 2, 1], np.uint64))
    assert log.find(asked)[0].tolist() == [True, True, False, True, True, False, False]


SCHEMA = T.StructType([T.StructField(name, kind()) for name, kind in (
    ("arrival_seq", T.LongType), ("topic", T.StringType), ("partition", T.IntegerType),
    ("offset", T.LongType), ("sender_raw", T.StringType), ("sender_key", T.StringType),
    ("sender_ts", T.LongType), ("message_id", T.StringType), ("ingest_ms", T.LongType))])


def test_state_of_a_batch_does_not_follow_the_store():
    """New keys are appended; what they meet is read as digests."""
    handle = _Handle()
    lane = lanes.LaneProcessor(default_checks(cap=None, ttl_ms=None), SCHEMA)
    lane.init(handle)
    moved, rows = [], 4_000
    for batch in range(16):
        before = sum(state.bytes for state in handle.maps.values())
        lines = [json.dumps({"c0": str(i), "c1": "t", "c2": "0", "c3": str(i), "c4": "s", "c5": "s",
                             "c6": str(i), "c7": uid(i - i % 10), "c8": str(i)})
                 for i in range(batch * rows, (batch + 1) * rows)]
        got = pd.concat(lane.handleInputRows(("l",), iter([pd.DataFrame({"lane": "l", lanes.PACKED: lines})]),
                                             None))
        assert got["failed_by"].isna().sum() == rows / 10
        moved.append(sum(state.bytes for state in handle.maps.values()) - before)
    assert moved[14] < 3 * moved[1]


def test_odd_texts_travel_as_they_are(spark, make_records, tmp_path):
    """Senders with any characters, and missing values; the same id of each is told apart."""
    senders = ['a"b', "a\\b", "a\tb", "a\nb", "a\x01b", "äß😀", " x", "{}", '","', "a", None, "null", "%0A"]
    rows = [{"sender": sender, "id": uid(1), "time": time, "off": i * 10 + at}
            for i, sender in enumerate(senders) for at, time in enumerate(("7", "x", None))]
    write_table(make_records(rows), str(tmp_path / "in"))
    checks = default_checks(cap=None, ttl_ms=None)
    verdicts = lanes.verify_stream(stream_records(spark, str(tmp_path / "in")), checks=checks)
    memory_stream(verdicts, "odd_texts").trigger(availableNow=True).start().awaitTermination()
    batch = verify_chain(normalise(make_records(rows)), checks).verdicts
    columns = [name for name in batch.columns if name in verdicts.columns]
    got = in_order(spark.table("odd_texts"), *columns)
    assert got == in_order(batch, *columns) and {"sender_raw", "failed_by", "sender_ts"} < set(columns)
    assert sum(row[columns.index("failed_by")] is None for row in got) > len(senders)


def test_columns_that_are_no_texts_travel_beside_the_row(spark):
    rows = spark.range(3).select(
        F.lit("l").alias("lane"), F.col("id").alias("n"), F.array("id").alias("many"),
        F.when(F.col("id") > 0, F.timestamp_millis(F.col("id") * 1_500)).alias("at"),
        (F.col("id") / 3).alias("third"), (F.col("id") == 1).alias("flag"),
        F.to_binary(F.lit("00ff"), F.lit("hex")).alias("bytes"), F.lit(None).cast("decimal(20,3)").alias("none"))
    schema = rows.drop("lane").schema
    packed = lanes._pack(rows, schema)
    assert packed.columns == ["lane", lanes.PACKED, "many", "bytes"]
    verdicts = [F.lit(None).cast("string").alias(field.name) for field in lanes.VERDICT_FIELDS]
    back = lanes._unpack(packed.select("*", *verdicts), schema).select(*schema.names)
    assert back.collect() == rows.drop("lane").collect() and back.schema.simpleString() == schema.simpleString()


@pytest.mark.parametrize("rows, files, parts, starts", [(300, 4, 2, 2), (300, 120, 16, 4)])
def test_lane_stream_is_not_started_for_each_part(spark, monkeypatch, rows, files, parts, starts):
    """A part is a micro-batch; one that has fewer files than a micro-batch ends its run."""
    names = ("stream_lane_store", "stream_lane_offsets")
    whole = [sorted(map(tuple, catalogue.QUERIES[name](spark, SF_SMALL).collect())) for name in names]
    run, begun = catalogue._run_lanes, []
    monkeypatch.setattr(catalogue, "_run_lanes", lambda *args: begun.append(1) or run(*args))
    for name, value in (("LANE_ROWS", rows), ("LANE_FILES", files), ("LANE_PARTS", parts)):
        monkeypatch.setattr(catalogue, name, value)
    got = [sorted(map(tuple, catalogue.QUERIES[name](spark, SF_SMALL).collect())) for name in names]
    assert got == whole and all(whole) and len(begun) == starts * len(names)


def test_lane_queries_of_no_events(spark, tmp_path):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_lane_verify", "stream_lane_offsets", "stream_lane_keys"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_lanes_are_spread_over_few_state_partitions(spark, make_records):
    few = make_records([{"part": part} for part in range(3)] * 2)
    other = with_settings(spark, {"spark.sql.shuffle.partitions": "200"})
    held = lambda n: few.select((F.pmod(F.hash(lane_column("partition")), F.lit(n)))).distinct().count()
    found = lanes.lane_partitions(other.createDataFrame(few.collect(), few.schema), "partition")
    assert held(found) == 3 and all(held(n) < 3 for n in range(3, found))
    many = make_records([{"part": part} for part in range(40)])
    assert lanes.lane_partitions(many, "partition") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lanes.lane_partitions(many.limit(0), "partition") == 1
