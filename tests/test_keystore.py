import math

import pytest
from pyspark.sql import functions as F

from sluicegate.operators import bloom, keystore
from tests.conftest import uid


@pytest.fixture
def make_log(spark):
    def make(entries):
        rows = [(s, uid(n), ms, i) for i, (s, n, ms) in enumerate(entries)]
        return spark.createDataFrame(
            rows, "sender_key string, message_id string, stored_ms bigint, stored_seq bigint")
    return make


def ids(store):
    return {(r.sender_key, int(r.message_id[-12:])) for r in store.collect()}


def keys(spark, pairs):
    return spark.createDataFrame([(s, uid(n)) for s, n in pairs],
                                 "sender_key string, message_id string")


def test_store_again_refreshes(make_log):
    store = keystore.upsert(make_log([("s1", 1, 0), ("s2", 1, 5), ("s1", 1, 9)]))
    assert {(r.sender_key, r.stored_ms) for r in store.collect()} == {("s1", 9), ("s2", 5)}
    assert keystore.size(store).first()[0] == 2


def test_remove_and_unknown_keys(spark, make_log):
    store = keystore.upsert(make_log([("s1", 1, 0), ("s1", 2, 0)]))
    assert ids(keystore.remove(store, keys(spark, [("s1", 1), ("s9", 9)]))) == {("s1", 2)}


def test_clear_and_reuse(make_log):
    log = make_log([("s1", 1, 0), ("s1", 2, 1), ("s1", 1, 2)])
    assert ids(keystore.upsert(keystore.after_clear(log, 1))) == {("s1", 1)}
    assert ids(keystore.upsert(keystore.after_clear(log, 2))) == set()


def test_age_counts_strictly(make_log):
    log = make_log([("s1", 1, 0), ("s1", 2, 50), ("s1", 3, 150)])
    assert ids(keystore.live_keys(log, 100, 100)) == {("s1", 2), ("s1", 3)}
    assert ids(keystore.live_keys(log, 100, 99)) == {("s1", 3)}


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_newest_stay(make_log, chunk_rows):
    store = keystore.upsert(make_log([("s1", n, n * 10) for n in range(10)]))
    got = keystore.evict_by_size(store, 5, chunk_rows)
    assert ids(got) == {("s1", n) for n in range(5, 10)}
    assert ids(keystore.evict_by_size(store, 50, chunk_rows)) == {("s1", n) for n in range(10)}


def test_age_before_size(make_log):
    log = make_log([("s1", n, 0) for n in range(2)] + [("s1", n, 150) for n in range(2, 7)])
    assert ids(keystore.live_keys(log, 3, 100)) == {("s1", n) for n in (4, 5, 6)}


def test_no_stores(make_log):
    assert ids(keystore.live_keys(make_log([("s1", 1, 0)]).where("false"), 3, 100)) == set()


@pytest.mark.parametrize("prefilter", ["none", "bloom"])
def test_exists(spark, make_log, prefilter):
    store = keystore.upsert(make_log([("s1", n, n) for n in range(50)]))
    probes = keys(spark, [("s1", n) for n in range(100)] + [("s2", 1)])
    got = {(r.sender_key, int(r.message_id[-12:])): r.is_stored
           for r in keystore.exists(probes, store, prefilter, 50).collect()}
    assert got == {**{("s1", n): n < 50 for n in range(100)}, ("s2", 1): False}


@pytest.mark.parametrize("block_bits", [64, 200])
def test_exists_with_a_filter_of_many_blocks(spark, make_log, monkeypatch, block_bits):
    monkeypatch.setattr(bloom, "BLOCK_BITS", block_bits)
    assert bloom.bloom_shape(60).blocks > 3
    store = keystore.upsert(make_log([("s1", n, n) for n in range(60)]))
    probes = keys(spark, [("s1", n) for n in range(300)] + [("s2", 1)] * 300)
    got = keystore.exists(probes, store, "bloom", 60)
    assert {int(r.message_id[-12:]) for r in got.where("is_stored").collect()} == set(range(60))
    assert got.count() == 600
    maybe = bloom.with_maybe(probes, bloom.build_bloom(store, 60), "maybe").where(
        "maybe and sender_key = 's1'").count()
    assert 60 <= maybe < 90


def test_exists_knows_its_filters(spark, make_log):
    store = keystore.upsert(make_log([("s1", 1, 0)]))
    assert keystore.exists(keys(spark, [("s1", 1)]), store).first()["is_stored"]
    with pytest.raises(ValueError):
        keystore.exists(keys(spark, [("s1", 1)]), store, "other")


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    def numbered(first, n):
        return spark.range(first, first + n).select(
            F.lit("s").alias("sender_key"),
            F.format_string("00000000-0000-0000-0000-%012d", "id").alias("message_id"))
    shape = bloom.bloom_shape()
    assert (shape.keys, shape.hashes) == (12_000, 7)
    assert abs(shape.bits + 12_000 * math.log(0.01) / math.log(2) ** 2) < 1
    found = bloom.build_bloom(numbered(0, 10_000))
    def passing(rows):
        return bloom.with_maybe(rows, found, "maybe").where("maybe").count()

    assert passing(numbered(0, 10_000)) == 10_000
    assert passing(numbered(50_000, 10_000)) < 150
