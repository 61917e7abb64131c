import random

import pytest
from pyspark.sql import functions as F

from sluicegate.operators import storelog
from sluicegate.operators.storelog import replay

SHAPE = "op_seq long, kind string, sender_key string, message_id string, op_ms long"


def model(ops, cap, ttl):
    """The store one operation after the other."""
    store, answers = {}, {}
    for seq, kind, sender, mid, ms in ops:
        key = (sender, mid)
        if kind == "store":
            store.pop(key, None)
            store[key] = (ms, seq)
            if ttl is not None:
                store = {k: v for k, v in store.items() if ms - v[0] <= ttl}
            while cap is not None and len(store) > cap:
                del store[next(iter(store))]
        elif kind == "remove":
            store.pop(key, None)
        elif kind == "clear":
            store = {}
        else:
            answers[seq] = key in store
    return answers, {(*k, *v) for k, v in store.items()}


def make_ops(seed, n, ids, clears=0.005, hot=0.0):
    rng, ms, ops = random.Random(seed), 0, []
    for i in range(n):
        ms += rng.choice((0, 1, 1, 4, 30))
        kind = rng.choices(("store", "remove", "exists"), (5, 3, 4))[0]
        mid = "hot" if rng.random() < hot else f"m{rng.randrange(ids)}"
        if rng.random() < clears:
            ops.append((i * 3, "clear", None, None, ms))
        else:
            ops.append((i * 3, kind, "s", mid, ms))
    return ops


@pytest.mark.parametrize("seed, chunk_rows, cap, ttl, ids, clears, hot", [
    (1, 10_000, 7, 300, 40, 0.005, 0.0),
    (2, 40, 7, 10**9, 40, 0.005, 0.0),      # many chunks, entries from several chunks back
    (3, 25, 60, None, 400, 0.0, 0.0),       # the store is larger than a chunk
    (4, 60, None, 200, 30, 0.01, 0.0),
    (5, 50, 5, 90, 30, 0.01, 0.34),         # one key in a third of all operations
    (6, 30, 1, 10**9, 3, 0.02, 0.0),
])
def test_replay_equals_model(spark, seed, chunk_rows, cap, ttl, ids, clears, hot):
    ops = make_ops(seed, 700, ids, clears, hot)
    answers, store = model(ops, cap, ttl)
    got = replay(spark.createDataFrame(ops, SHAPE).repartition(5), cap, ttl, chunk_rows)
    assert {r["op_seq"]: r["is_stored"] for r in got.answers.collect()} == answers
    assert {(r["sender_key"], r["message_id"], r["stored_ms"], r["stored_seq"])
            for r in got.store.collect()} == store
    assert any(answers.values()) and not all(answers.values())


def test_a_removed_key_that_is_stored_again_is_there(spark):
    ops = [(0, "store", "s", "a", 0), (1, "remove", "s", "a", 1), (2, "exists", "s", "a", 1),
           (3, "store", "s", "a", 2), (4, "exists", "s", "a", 2), (5, "remove", "s", "b", 3),
           (6, "clear", None, None, 4), (7, "exists", "s", "a", 5), (8, "store", "s", "b", 6)]
    got = replay(spark.createDataFrame(ops, SHAPE))
    assert {r["op_seq"]: r["is_stored"] for r in got.answers.collect()} == {2: False, 4: True, 7: False}
    assert [(r["message_id"], r["stored_seq"]) for r in got.store.collect()] == [("b", 8)]


def test_room_made_by_a_removal(spark):
    """A key that was dropped for size stays out, though a later removal makes room."""
    ops = [(i, "store", "s", f"m{i}", i) for i in range(4)] + [
        (4, "remove", "s", "m3", 4), (5, "exists", "s", "m0", 5), (6, "exists", "s", "m1", 5),
        (7, "store", "s", "m9", 6), (8, "exists", "s", "m1", 6)]
    got = replay(spark.createDataFrame(ops, SHAPE), cap=3, ttl_ms=None)
    assert {r["op_seq"]: r["is_stored"] for r in got.answers.collect()} == {
        5: False, 6: True, 8: True}


def test_an_empty_log(spark):
    got = replay(spark.createDataFrame([], SHAPE))
    assert got.answers.count() == 0 and got.store.count() == 0


@pytest.mark.parametrize("seed, cap, ids, clears", [(7, 7, 40, 0.005), (8, 30, 400, 0.0), (9, 3, 9, 0.05)])
def test_lasting_entries_are_carried_over_levels_of_blocks(spark, monkeypatch, seed, cap, ids, clears):
    monkeypatch.setattr(storelog, "BLOCK", 3)
    ops = make_ops(seed, 500, ids, clears)
    answers, store = model(ops, cap, None)
    got = replay(spark.createDataFrame(ops, SHAPE), cap, None, 40)
    assert {r["op_seq"]: r["is_stored"] for r in got.answers.collect()} == answers
    assert {(r["sender_key"], r["message_id"], r["stored_ms"], r["stored_seq"])
            for r in got.store.collect()} == store


def test_a_chunk_starts_with_no_more_entries_than_the_store_holds(spark):
    """Ten stores a chunk, cleared every 50 chunks: after a clear a store of 25 is not full."""
    chunks = 300
    lives = spark.range(10 * chunks).select(
        "id", (F.col("id") / 10).cast("bigint").alias("chunk")).select(
        F.col("id").alias("start"), "chunk", F.lit(None).cast("bigint").alias("end_chunk"),
        (F.floor(F.col("chunk") / 50) * 50 + 49).alias("last_chunk"))
    got = dict(storelog._lasting_at_start(lives, chunks, 25).groupBy("chunk").count().collect())
    assert got == {c: min(25, 10 * (c % 50)) for c in range(chunks) if c % 50}
