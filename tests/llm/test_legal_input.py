"""Repeated ids, clashing columns, session settings and long texts give whole, right results."""

import time

from pyspark.sql import functions as F

from sluicegate.llm import exact_dedup, licenses, near_dedup, sharding, token_files
from sluicegate.llm.tokens import public_file
from sluicegate.plans.scratch import Scratch

from .helpers import make_docs

TEXT = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def test_rows_that_share_an_id_are_one_node(spark):
    rows = [(1, TEXT), (1, OTHER), (2, TEXT + " x"), (3, OTHER + " y"), (4, "alone here"), (4, None),
            (None, TEXT)]
    got = near_dedup.mark_near_duplicates(make_docs(spark, rows), near_dedup.Shingling(4, 80)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [
        (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]


def test_a_copy_that_goes_takes_no_other_text_with_it(spark):
    rows = [(9, "same"), (12, "same"), (9, "other"), (None, "same"), (5, None), (6, "")]
    kept = exact_dedup.drop_duplicates(make_docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [
        (12, "same"), (9, "other"), (None, "same"), (6, "")]))


def test_shards_keep_a_column_of_their_name(spark, tmp_path):
    docs = make_docs(spark, [(i, TEXT) for i in range(30)]).withColumn(
        "shard", F.lit("mine")).withColumn("shard_", F.col("doc_id"))
    directory = sharding.write_shards(docs, str(tmp_path / "s"), 1_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("shard = 'mine' and shard_ = doc_id").count() == 30
    assert {r[0] for r in back.select("shard__").distinct().collect()} == {
        r["shard"] for r in directory.collect()}


def test_token_places_whatever_the_session_says(spark):
    docs = make_docs(spark, [(i, "some words " * (i % 7)) for i in range(300)])
    name = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(name, "20")
    try:
        files = token_files.write_token_files(
            docs, Scratch(spark, "t").path("files"), public_file("byte_bpe_50k.json"), 2)
        rows = sorted(files.digests().collect(), key=lambda r: r["doc_id"])
    finally:
        spark.conf.unset(name)
    place = 0
    for row in rows:
        assert row["start"] == place
        place += row["n_tokens"]


def test_files_are_numbered_beyond_five_digits(spark):
    names = ["part-100000-x-c000.parquet", "part-10001-x-c000.parquet", "part-00002-x-c000.parquet"]
    rows = spark.createDataFrame([(n,) for n in names], "file string")
    got = rows.orderBy(token_files.file_number("file")).collect()
    assert [r["file"] for r in got] == names[::-1]


def test_a_long_text_of_hits_takes_linear_time():
    joined = "all rights reserved cc by " * 100_000
    start = time.perf_counter()
    places = sorted(licenses.base_places(joined.strip()))
    assert time.perf_counter() - start < 5
    assert len(places) == 200_000 and places[0][0] == 0 and places[-1][0] == 499_998
