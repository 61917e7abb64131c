from pyspark.sql import functions as F

from sluicegate.plans.arrival import assign_arrival_seq
from sluicegate.plans.running import running_before
from sluicegate.plans.scratch import drop_scratch_tables, scratch_dir
from sluicegate.sources import kafka
from sluicegate.sources.envelope import HEADERS, RECORD_SCHEMA
from sluicegate.sources.records import derive_records, load_records
from sluicegate.sources.sample import sample_records
from tests.conftest import SF_SMALL


def test_kafka_options():
    assert kafka.source_options("h:1", "t", max_per_trigger=5) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest",
        "includeHeaders": "true", "maxOffsetsPerTrigger": "5"}


def test_kafka_rows_in_and_out(spark):
    rows = kafka.to_topic_rows(sample_records(spark), "out")
    assert rows.columns == ["topic", "key", "value", "headers"]
    assert rows.schema["headers"].dataType == HEADERS
    source = sample_records(spark).drop("arrival_seq", "ingest_ms").withColumn(
        "value", F.col("value").cast("binary")).orderBy(F.desc("offset"))
    records = kafka.in_arrival_order(kafka.as_records(source))
    assert set(records.columns) == set(RECORD_SCHEMA.names)
    assert {(r.arrival_seq, r.value) for r in records.collect()} == {
        (i, f"Watermark message {i + 1}") for i in range(5)}


def test_arrival_seq_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = assign_arrival_seq(df, ["k"], partitions=7).collect()
    assert all(r.k == r.arrival_seq for r in got) and len(got) == 1000


def test_running_before_splits_hot_keys(spark):
    rows = spark.range(500).select(
        F.col("id").alias("arrival_seq"), F.when(F.col("id") % 3 > 0, "hot")
        .otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    chunked = rows.withColumn("chunk", F.floor(F.col("arrival_seq") / 20))
    for how, fold in ((F.max, max), (F.sum, sum)):
        got = running_before(chunked, ["k"], F.col("v"), "before", how).collect()
        seen = {}
        for r in sorted(got, key=lambda r: r.arrival_seq):
            assert r.before == (fold(seen[r.k]) if r.k in seen else None)
            seen.setdefault(r.k, []).append(r.v)
        assert len(got) == 500


def test_derived_records(spark):
    records = load_records(spark, SF_SMALL)
    kinds = {r.kind: r["count"] for r in records.groupBy("kind").count().collect()}
    assert kinds == {0: 1000, 1: 59, 2: 53}
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert derive_records(events, across=True).where("kind = 1 and offset >= 100000").count() == 59


def test_scratch_is_in_the_checkpoint_folder(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    drop_scratch_tables(spark)
    assert drop_scratch_tables(spark) == 0
