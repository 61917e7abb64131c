import random
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicegate.operators import reports
from sluicegate.operators.chain import verify_chain
from sluicegate.operators.normalize import normalise
from sluicegate.plans import fold
from sluicegate.plans.checks import (CombiningCheck, CustomCheck, OffsetOrder, Uniqueness,
                                     default_checks)
from sluicegate.sources.records import load_records
from sluicegate.sources.sample import sample_records
from tests.conftest import SF_SMALL, in_order, uid
from tests.model import judge

GOLDEN = [  # threshold, cap, ttl -> duplicates, offset, watermark, accepted
    ((0, 10_000, 300_000), (95, 8, 75, 934)),
    ((0, 10_000, 100_000), (54, 8, 115, 935)),
    ((0, 100, 300_000), (51, 8, 118, 935)),
    ((21_600_000, 10_000, 300_000), (95, 8, 75, 934)),
    ((86_400_000, 10_000, 300_000), (95, 8, 73, 936)),
]


def counts(judged):
    n = {r["failed_by"]: r["count"] for r in judged.groupBy("failed_by").count().collect()}
    return tuple(n.get(k, 0) for k in ("uniqueness", "offset", "sender_watermark", None))


@pytest.mark.parametrize("settings, want", GOLDEN)
def test_golden_counts(spark, settings, want):
    rows = normalise(load_records(spark, SF_SMALL))
    assert counts(verify_chain(rows, default_checks(*settings)).verdicts) == want


def test_golden_counts_in_chunks(spark):
    run = verify_chain(normalise(load_records(spark, SF_SMALL)), chunk_rows=300)
    assert run.chunks == 4
    assert counts(run.verdicts) == (95, 8, 75, 934)


def random_rows(seed, n, senders, ids, hot=0.0):
    rnd = random.Random(seed)
    rows, ingest = [], 0
    for i in range(n):
        ingest += rnd.choice((0, 1, 1, 5, 40))
        base = i * 10 + rnd.choice((0, 0, 0, -60, -200))
        rows.append({
            "sender": rnd.choice((None, "", " s0")) if rnd.random() < 0.1
            else f"s{rnd.randrange(senders)}",
            "time": "bad" if rnd.random() < 0.05 else str(base),
            "id": "bad" if rnd.random() < 0.05
            else uid(0 if rnd.random() < hot else rnd.randrange(ids)),
            "part": rnd.randrange(2),
            "off": i if rnd.random() < 0.9 else rnd.randrange(i + 1), "ingest": ingest})
    return rows


def as_model(rows):
    out = []
    for row in rows:
        sender, time, mid = row["sender"], row["time"], row["id"]
        key = (sender or "").strip()
        ts = int(time) if time != "bad" else None
        out.append({"lane": row["part"], "off": row["off"], "ingest": row["ingest"], "ts": ts,
                    "flow": None if sender is None or ts is None else (sender, row["part"]),
                    "key": (key, mid) if key and mid != "bad" else None})
    return out


@pytest.mark.parametrize("seed, chunk_rows, threshold, cap, ttl, hot", [
    (1, 7, 0, 10_000, 300_000, 0.0),
    (2, 25, 100, 5, 100, 0.0),
    (3, 40, 150, 20, 60, 0.33),   # one id holds a third of the records and keeps expiring
    (4, 13, 0, 3, 10_000, 0.33),
])
def test_random_equals_model(make_records, seed, chunk_rows, threshold, cap, ttl, hot):
    rows = random_rows(seed, 240, 3, 30, hot)
    want, offsets, marks, store = judge(as_model(rows), threshold, cap, ttl)
    run = verify_chain(normalise(make_records(rows)), default_checks(threshold, cap, ttl),
                       chunk_rows)
    assert run.chunks > 1
    assert in_order(run.verdicts, "failed_by") == want
    got = {r.partition: r.latest_offset for r in reports.latest_offsets(run.verdicts).collect()}
    assert got == offsets


@pytest.mark.parametrize("cap, ttl", [(40, 10**9), (10**9, 3_000)])
def test_hot_expiring_id_settles_in_few_passes(spark, cap, ttl):
    """One id in a third of the records is accepted again and again across all chunks."""
    i, hot = F.col("id"), F.xxhash64("id") % 3 == 0
    sender = F.when(hot, "hot").otherwise(F.concat(F.lit("s"), i % 20))
    rows = spark.range(6_000).select(
        i.alias("arrival_seq"), F.lit("t").alias("topic"), (i % 2).cast("int").alias("partition"),
        i.alias("offset"), sender.alias("sender_raw"), sender.alias("sender_key"),
        F.lit(True).alias("time_given"), (i * 10).alias("sender_ts"), F.lit(True).alias("id_given"),
        F.when(hot, "h").otherwise(i.cast("string")).alias("message_id"),
        (i * 10).alias("ingest_ms"))
    model = [{"lane": r.partition, "off": r.offset, "flow": (r.sender_raw, r.partition),
              "ts": r.sender_ts, "key": (r.sender_key, r.message_id), "ingest": r.ingest_ms}
             for r in rows.orderBy("arrival_seq").collect()]
    want, *_ = judge(model, 0, cap, ttl)
    run = verify_chain(rows, default_checks(0, cap, ttl), 250)
    assert run.chunks == 24 and run.passes <= 7
    assert in_order(run.verdicts, "failed_by") == want
    assert want.count("uniqueness") > 1_500


def test_many_copies_of_an_expiring_id_in_a_chunk(spark):
    """The effect of a key lists every place where a seed may die, however many there are."""
    i = F.col("id")
    sender = F.when(i % 8 < 7, "hot").otherwise(F.concat(F.lit("s"), i % 20))
    rows = spark.range(40_000).select(
        i.alias("arrival_seq"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        i.alias("offset"), sender.alias("sender_raw"), sender.alias("sender_key"),
        F.lit(True).alias("time_given"), (i * 10).alias("sender_ts"), F.lit(True).alias("id_given"),
        F.when(i % 8 < 7, "h").otherwise(i.cast("string")).alias("message_id"),
        (i * 10).alias("ingest_ms"))
    checks = default_checks(0, 1, 10**9)
    run = verify_chain(rows, checks, 10_000)
    assert run.chunks == 4 and run.passes <= 4
    # A store of one key forgets the hot one at each of the others, so the first hot record
    # after another sender's is accepted and the rest are copies.
    got = run.verdicts.groupBy("verified").count().collect()
    assert {r.verified: r["count"] for r in got} == {True: 10_000, False: 30_000}


@pytest.mark.parametrize("seed, block", [(1, 2), (3, 4), (4, 3)])
def test_effects_carried_over_many_levels(make_records, monkeypatch, seed, block):
    """Chunks of three records in blocks of a few: five levels and more, the same verdicts."""
    monkeypatch.setattr(fold, "BLOCK", block)
    rows = random_rows(seed, 200, 3, 12, 0.33)
    want, *_ = judge(as_model(rows), 100, 20, 60)
    run = verify_chain(normalise(make_records(rows)), default_checks(100, 20, 60), 3)
    assert run.chunks == 67 and in_order(run.verdicts, "failed_by") == want


def test_one_key_in_two_thousand_chunks(spark):
    """The chunks of a key meet in blocks: no group of rows is larger than a block."""
    effects = spark.range(2_000).select(
        F.col("id").alias("chunk"), F.lit("offset").alias("check"),
        F.array(F.lit("t"), F.lit("0")).alias("key"),
        F.array(F.struct((F.col("id") * 7919 % 2_003 - 1).alias("x"), F.lit(None).cast("long").alias("y"),
                         (F.col("id") * 7919 % 2_003).alias("to"),
                         F.lit(None).cast("long").alias("time"))).alias("pieces"))
    every = effects.select(*[F.col(f.name) if f.name in effects.columns else
                             F.lit(None).cast(f.dataType).alias(f.name) for f in fold.EFFECT_SCHEMA])
    got = {r["chunk"]: r["seed"] for r in fold.carry_effects(every, [OffsetOrder()], 2_000).collect()}
    state = None
    for chunk in range(2_000):
        assert (got[chunk] and got[chunk]["a"]) == state
        value = chunk * 7919 % 2_003
        state = value if state is None or state <= value - 1 else state
    plan = fold.carry_effects(every, [OffsetOrder()], 2_000)._jdf.queryExecution().toString()
    assert f"div {fold.BLOCK}" in plan and "block" in plan


def test_store_effects_compose():
    """Composed pieces end a state where the pieces one after the other do."""
    rng = random.Random(5)
    for _ in range(3_000):
        check = Uniqueness(rng.choice([2, 5, None]), rng.choice([4, 9, None]))
        place, parts = 0, []
        for _ in range(rng.randrange(1, 5)):
            part = []
            for _ in range(rng.randrange(4)):
                place += rng.randrange(1, 4)
                part.append((place, place * 2, place + rng.randrange(1, 3), place * 2 + 1))
            parts.append(part)
        if rng.random() < 0.3:
            parts[0] = [(None, None, 0, 0)]
        whole = reduce(check.composed, parts, [])
        for state in [None, *((-n, -2 * n) for n in range(8))]:
            want = state
            for part in parts:
                want = check.after(want, part)
            assert check.after(state, whole) == want


def test_state_goes_on(make_records):
    rows = random_rows(7, 200, 3, 30)
    want, *_ = judge(as_model(rows), 50, 15, 200)
    checks = default_checks(50, 15, 200)
    records = normalise(make_records(rows))
    first = verify_chain(records.where("arrival_seq < 90"), checks, 40, keep_state=True)
    second = verify_chain(records.where("arrival_seq >= 90"), checks, 40, state=first.state)
    assert in_order(first.verdicts, "failed_by") + in_order(second.verdicts, "failed_by") == want


def test_sparse_arrival_numbers(make_records):
    rows = random_rows(9, 150, 3, 30)
    want, *_ = judge(as_model(rows))
    sparse = normalise(make_records(rows)).withColumn("arrival_seq", F.col("arrival_seq") * 1000)
    run = verify_chain(sparse, chunk_rows=50)
    assert run.chunks == 3
    assert in_order(run.verdicts, "failed_by") == want


def test_end_to_end_cases(make_records):
    rows = [{"sender": "s1", "off": o, "time": str(t)} for o, t in ((0, 1000), (1, 2000))]
    rows += [{"sender": "s2", "off": o, "time": str(t)}
             for o, t in ((10, 5000), (11, 4000), (12, 6000))]
    judged = verify_chain(normalise(make_records(rows))).verdicts
    assert in_order(judged, "verified") == [True, True, True, False, True]
    marks = {r.sender_raw: r.watermark_ms for r in reports.all_watermarks(judged).collect()}
    assert marks == {"s1": 2000, "s2": 6000}
    assert in_order(judged, "reason")[3] == (
        "SenderPartitionKey{sender='s2', topic='t', partition=0} is 1000 ms behind 5000, "
        "threshold 0 ms")


def test_sample_feed(spark):
    judged = verify_chain(normalise(sample_records(spark))).verdicts
    assert in_order(judged, "verdict") == ["SUCCESS"] * 3 + ["FAILED_DUPLICATE", "SUCCESS"]
    other = verify_chain(normalise(sample_records(spark, ("s1", "s2", "s1", "s1", "s1")))).verdicts
    assert in_order(other, "verdict") == ["SUCCESS"] * 5


def test_empty_input(make_records):
    assert verify_chain(normalise(make_records([{}]).where("false"))).verdicts.count() == 0


def test_counting_check_settles_in_few_passes(spark):
    """A quota per sender over fourteen chunks; the counts of chunks add up."""
    i = F.col("id")
    rows = spark.range(2_800).select(
        i.alias("arrival_seq"), F.lit("t").alias("topic"), (i % 2).cast("int").alias("partition"),
        i.alias("offset"), (i % 3).cast("string").alias("sender_raw"),
        (i % 3).cast("string").alias("sender_key"), F.lit(True).alias("time_given"),
        i.alias("sender_ts"), F.lit(True).alias("id_given"), i.cast("string").alias("message_id"),
        i.alias("ingest_ms"))
    quota = CombiningCheck("quota", 5, ("sender_raw",), lambda row, n: (n or 0) < 500,
                           lambda row: 1, lambda a, b: a + b)
    run = verify_chain(rows, [*default_checks(), quota], 200)
    assert run.chunks == 14 and run.passes <= 3
    got = {r.sender_raw: r["count"] for r in
           run.verdicts.where("verified").groupBy("sender_raw").count().collect()}
    assert got == {"0": 500, "1": 500, "2": 500}
    first = run.verdicts.where("not verified").groupBy("sender_raw").agg(F.min("arrival_seq"))
    assert {tuple(r) for r in first.collect()} == {("0", 1500), ("1", 1501), ("2", 1502)}


def test_combining_keeps_the_order(make_records):
    """Values that do not commute: the ids of a sender so far, in order."""
    trail = CombiningCheck("trail", 0, ("sender_raw",), lambda row, ids: len(ids or ()) < 4,
                           lambda row: [row["offset"]], lambda a, b: a + b, ("offset",))
    rows = [{"sender": "ab"[i % 2], "id": uid(i)} for i in range(14)]
    run = verify_chain(normalise(make_records(rows)), [trail], 3, keep_state=True)
    assert in_order(run.verdicts, "verified") == [i < 8 for i in range(14)]
    state = {r["key"][0]: r["text"] for r in run.state.where("check = 'trail'").collect()}
    assert state == {"a": "[0, 2, 4, 6]", "b": "[1, 3, 5, 7]"}


@pytest.mark.parametrize("chunk_rows", [2, 1000])
def test_custom_check(make_records, chunk_rows):
    """At most two accepted records per sender, checked between the built-in ones."""
    quota = CustomCheck("quota", 1, ("sender_key",), lambda row, n: (n or 0) < 2,
                        lambda row, n: (n or 0) + 1, verdict="FAILED_QUOTA")
    rows = [{"sender": "a", "id": uid(i)} for i in (1, 1, 2, 3, 4)] + [{"id": uid(1)}]
    judged = verify_chain(normalise(make_records(rows)), [OffsetOrder(), quota, Uniqueness()],
                          chunk_rows).verdicts
    assert in_order(judged, "verdict") == ["SUCCESS", "FAILED_DUPLICATE", "SUCCESS",
                                           "FAILED_QUOTA", "FAILED_QUOTA", "SUCCESS"]
    # Equal priorities keep their order: offset ran before the quota check.
    assert in_order(judged, "offset_outcome")[3] == "in_order"


@pytest.mark.parametrize("seed", range(4))
def test_chunks_of_a_run_start_from_one_another(seed):
    """From the start of the order on, the first pass of a run is right already."""
    rnd = random.Random(seed)
    n, size, cap = 300, 10, 15
    rows = pa.table({
        "arrival_seq": pa.array(range(n)), "chunk": pa.array([i // size for i in range(n)]),
        "topic": ["t"] * n, "partition": [rnd.randrange(2) for _ in range(n)],
        "offset": [i - rnd.choice((0, 0, 0, 15)) for i in range(n)],
        "sender_raw": [rnd.choice(("a", "b", "c", None)) for _ in range(n)],
        "sender_key": ["a"] * n, "message_id": [str(rnd.randrange(25)) for _ in range(n)],
        "ingest_ms": pa.array([i * 10 for i in range(n)])})
    quota = CombiningCheck("quota", 2, ("sender_raw",), lambda row, n: (n or 0) < 15, lambda row: 1,
                           lambda a, b: a + b)
    checks = [Uniqueness(cap, 250), OffsetOrder(), quota]
    ids = rows.select(["chunk", "message_id"]).group_by(["chunk", "message_id"]).aggregate([]).to_pylist()
    seeds = pa.table({"chunk": [r["chunk"] for r in ids], "check": ["uniqueness"] * len(ids),
                      "key": [["a", r["message_id"]] for r in ids], "seed": pa.nulls(len(ids), fold.STATE)})
    failed = []

    def judge(part, starts):
        failed.extend(fold._verdict_table(part, starts, checks).column("failed_by").to_pylist())
        return fold._effect_table(part, starts, checks)

    fold.each_chunk(rows, seeds, judge, fold.Onward(checks))
    want = fold._verdict_table(rows, None, checks).column("failed_by").to_pylist()
    assert failed == want
    assert {"uniqueness", "offset", "quota"} <= set(want)
