"""Every operator as a named query over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import headers as H
from .functions.outcomes import UNIQUENESS
from .operators import bloom, histogram, keystore, reports, single
from .operators import normalize as N
from .operators.chain import verify_chain
from .operators.storelog import replay
from .plans.checks import CombiningCheck, CustomCheck, default_checks
from .plans.scratch import Scratch, delete_folder, with_settings
from .sources import kafka
from .sources.envelope import RECORD_SCHEMA, read_records, stream_records, verdict_stream
from .sources.records import load_records
from .streaming.consumer import Consumer, state_keys, state_offsets, state_watermarks
from .streaming.lanes import lane_partitions, lane_state, verify_stream

HOUR_MS = 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SMALL_CHUNK = 2_000  # makes the chain cut even small folders into several chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


def _records(spark, sf_dir, **options):
    return load_records(spark, sf_dir, **options)


def _normalised(spark, sf_dir, **options):
    return N.normalise(load_records(spark, sf_dir, **options))


def _judged(spark, sf_dir, threshold_ms=0, cap=10_000, ttl_ms=300_000, **options):
    return verify_chain(_normalised(spark, sf_dir), default_checks(threshold_ms, cap, ttl_ms),
                        **options).verdicts


def _place(df, *columns):
    """Record columns under names that are easy to use in any SQL dialect."""
    renamed = {"partition": "part", "offset": "off"}
    return df.select(*[F.col(c).alias(renamed.get(c, c)) for c in columns])


# Projections, scalar functions, predicates

@query("envelope")
def _(spark, sf_dir):
    return _place(N.envelope(_records(spark, sf_dir)),
                  "topic", "partition", "offset", "key", "value")


@query("header_last")
def _(spark, sf_dir):
    """An earlier header of the same name must not win."""
    stale = F.array(F.struct(F.lit(H.SENDER).alias("key"), F.lit("stale").cast("binary").alias("value")))
    records = _records(spark, sf_dir).withColumn("headers", F.when(
        F.col("event_id") % 41 == 0, F.concat(stale, "headers")).otherwise(F.col("headers")))
    return N.header_columns(records, "arrival_seq")


@query("parse_epoch_ms")
def _(spark, sf_dir):
    """Good texts, and with a blank, a sign, a fraction or an overflow."""
    text = F.col("time_text")
    forms = F.explode(F.array(text, F.concat(F.lit(" "), text), F.concat(F.lit("+"), text),
                              F.concat(F.lit("-"), text), F.concat(text, F.lit(".0")),
                              F.concat(F.lit("9999999"), text))).alias("time_text")
    return (N.header_columns(_records(spark, sf_dir), "arrival_seq").select("arrival_seq", forms)
            .withColumn("epoch_ms", H.parse_epoch_ms(F.col("time_text"))))


@query("sender_instant")
def _(spark, sf_dir):
    instant = H.sender_instant(F.col("sender_ts"))
    return _normalised(spark, sf_dir).where(N.is_timed()).select(
        "arrival_seq", "sender_ts",
        F.date_format(F.to_utc_timestamp(instant, F.current_timezone()),
                      "yyyy-MM-dd HH:mm:ss.SSS").alias("instant_text"))


@query("lateness")
def _(spark, sf_dir):
    judged = single.verify_watermarks(_normalised(spark, sf_dir))
    return (judged.where(F.col("prev_watermark").isNotNull())
            .select("arrival_seq", F.try_subtract("prev_watermark", "sender_ts")
                    .alias("lateness_ms")))


@query("trim_blank")
def _(spark, sf_dir):
    """Control characters are blanks too; a text of blanks only counts as missing."""
    tab = F.lit("\t\u0001 ")
    padded = (F.when(F.col("event_id") % 3 == 0, F.concat(tab, "sender_raw", F.lit(" \n")))
              .when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), tab))
              .otherwise(F.col("sender_raw")))
    return (N.header_columns(_records(spark, sf_dir), "arrival_seq", "event_id")
            .select("arrival_seq", padded.alias("sender"))
            .select("arrival_seq", H.null_if_empty(H.trim_blank(F.col("sender"))).alias("sender_key")))


@query("uuid_canonical")
def _(spark, sf_dir):
    """Canonical, upper-case, short, long and broken forms of every record's id."""
    u = F.col("id_text")
    forms = F.array(
        u, F.upper(u), F.regexp_replace(u, "-0*", "-"), F.concat(F.lit("0"), u),
        F.concat(F.substring(u, 1, 4), F.lit("-1-2-3-"), F.substring(u, 25, 12)),
        F.concat(F.substring(u, 1, 8), F.lit("-abcde-2-3-"), F.substring(u, 25, 12)),
        F.replace(u, F.lit("-"), F.lit("")), F.concat(F.substring(u, 1, 35), F.lit("g")),
        F.concat(F.lit("1-2-3-4-8"), F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 15)),
        F.concat(F.lit("1-2-3-4-7"), F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 15)))
    return (N.header_columns(_records(spark, sf_dir), "arrival_seq")
            .where(u.isNotNull()).select("arrival_seq", F.explode(forms).alias("id_text"))
            .withColumn("message_id", H.uuid_canonical(F.col("id_text"))))


@query("record_keys")
def _(spark, sf_dir):
    return N.record_keys(_normalised(spark, sf_dir))


@query("normalised_records")
def _(spark, sf_dir):
    return _place(_normalised(spark, sf_dir), *N.NORMALISED)


@query("bypassed_records")
def _(spark, sf_dir):
    return N.bypassed_records(_normalised(spark, sf_dir))


# Single checks

@query("offset_order_verify")
def _(spark, sf_dir):
    judged = single.verify_offsets(_normalised(spark, sf_dir))
    return _place(judged, "arrival_seq", "partition", "offset", "prev_offset", "verdict",
                  "verified", "offset_outcome")


@query("offset_outcome_counts")
def _(spark, sf_dir):
    return reports.outcome_counts(single.verify_offsets(_normalised(spark, sf_dir)),
                                  "offset_outcome")


@query("watermark_verify")
def _(spark, sf_dir):
    return _place(single.verify_watermarks(_normalised(spark, sf_dir)), "arrival_seq",
                  "prev_watermark", "verdict", "verified", "wm_outcome")


@query("watermark_verify_threshold")
def _(spark, sf_dir):
    judged = single.verify_watermarks(_normalised(spark, sf_dir), 6 * HOUR_MS)
    return _place(judged, "arrival_seq", "prev_watermark", "verdict", "verified", "wm_outcome")


@query("watermark_outcome_counts")
def _(spark, sf_dir):
    return reports.outcome_counts(
        single.verify_watermarks(_normalised(spark, sf_dir), 24 * HOUR_MS, SMALL_CHUNK),
        "wm_outcome")


@query("uniqueness_verify")
def _(spark, sf_dir):
    return single.verify_uniqueness(_normalised(spark, sf_dir))


@query("uniqueness_outcome_counts")
def _(spark, sf_dir):
    return reports.outcome_counts(single.verify_uniqueness(_normalised(spark, sf_dir)),
                                  "uniq_outcome")


@query("uniqueness_verify_expiring")
def _(spark, sf_dir):
    return single.verify_uniqueness_expiring(_normalised(spark, sf_dir), 10_000, 100_000)


@query("uniqueness_expiring_chunked")
def _(spark, sf_dir):
    return single.verify_uniqueness_expiring(_normalised(spark, sf_dir), 10_000, 100_000,
                                             SMALL_CHUNK)


@query("stored_offsets_last")
def _(spark, sf_dir):
    return _place(single.stored_offsets(_normalised(spark, sf_dir)),
                  "topic", "partition", "stored_offset")


@query("stored_watermarks_last")
def _(spark, sf_dir):
    return _place(single.stored_watermarks(_normalised(spark, sf_dir)),
                  "sender_raw", "topic", "partition", "stored_watermark")


# The chain

_VERDICT = ("arrival_seq", "verdict", "verified", "failed_by", "uniq_outcome", "offset_outcome",
            "wm_outcome")


@query("chain_verify")
def _(spark, sf_dir):
    return _place(_judged(spark, sf_dir), *_VERDICT)


@query("chain_verify_chunked")
def _(spark, sf_dir):
    return _place(_judged(spark, sf_dir, chunk_rows=SMALL_CHUNK), *_VERDICT)


@query("chain_verify_small_store")
def _(spark, sf_dir):
    return _place(_judged(spark, sf_dir, cap=100), *_VERDICT)


@query("chain_small_store_chunked")
def _(spark, sf_dir):
    return _place(_judged(spark, sf_dir, cap=100, chunk_rows=SMALL_CHUNK), *_VERDICT)


@query("chain_verify_threshold")
def _(spark, sf_dir):
    return _place(_judged(spark, sf_dir, threshold_ms=6 * HOUR_MS, chunk_rows=SMALL_CHUNK),
                  *_VERDICT)


@query("chain_verify_across_partitions")
def _(spark, sf_dir):
    """Copies on another partition: the duplicate check crosses partitions."""
    run = verify_chain(_normalised(spark, sf_dir, across=True), chunk_rows=SMALL_CHUNK)
    return _place(run.verdicts, *_VERDICT)


def _odd_last(row, state):
    return state is None or row["value_class"] != state


def _keep_class(row, state):
    return row["value_class"]


def _custom(spark, sf_dir, **options):
    """A check of its own before the others: a key must not repeat its last accepted class."""
    records = _records(spark, sf_dir)
    value_class = F.floor(F.col("value").cast("double") / 50).cast("int")
    rows = N.normalise(records.withColumn("value_class", value_class), "value_class")
    repeats = CustomCheck("value_repeat", -1, ("sender_raw",), _odd_last, _keep_class,
                          ("value_class",))
    run = verify_chain(rows, [*default_checks(), repeats], **options)
    return _place(run.verdicts, "arrival_seq", "verdict", "verified", "failed_by")


@query("chain_custom_check")
def _(spark, sf_dir):
    return _custom(spark, sf_dir)


@query("chain_custom_check_chunked")
def _(spark, sf_dir):
    return _custom(spark, sf_dir, chunk_rows=SMALL_CHUNK)


QUOTA = 150


@query("chain_counter_check")
def _(spark, sf_dir):
    """A check that counts: a sender may have so many accepted records at most."""
    quota = CombiningCheck("quota", -1, ("sender_raw",), lambda row, n: (n or 0) < QUOTA,
                           lambda row: 1, lambda a, b: a + b)
    run = verify_chain(_normalised(spark, sf_dir), [*default_checks(), quota], SMALL_CHUNK // 2)
    return _place(run.verdicts, "arrival_seq", "verdict", "verified", "failed_by")


@query("accepted_records")
def _(spark, sf_dir):
    return _place(reports.accepted(_judged(spark, sf_dir)), "arrival_seq", "partition", "offset",
                  "sender_raw", "sender_ts", "message_id")


@query("rejected_records")
def _(spark, sf_dir):
    return _place(reports.rejected(_judged(spark, sf_dir)), "arrival_seq", "partition", "offset",
                  "verdict", "failed_by")


@query("accepted_payload")
def _(spark, sf_dir):
    return _place(reports.accepted_payload(_records(spark, sf_dir), _judged(spark, sf_dir)),
                  "arrival_seq", "partition", "offset", "key", "value", "verdict")


def _topic_rows(spark, sf_dir):
    """The records as a Kafka source gives them: bytes, broker time, no number of ours."""
    return _records(spark, sf_dir).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        "topic", "partition", "offset", "timestamp", "headers")


@query("topic_round_trip")
def _(spark, sf_dir):
    """From topic rows through the chain to the rows of a topic of accepted records."""
    records = kafka.in_arrival_order(kafka.as_records(_topic_rows(spark, sf_dir)))
    judged = verify_chain(N.normalise(records)).verdicts
    out = kafka.to_topic_rows(reports.accepted_payload(records, judged), "accepted")
    return out.select("topic", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"),
                      H.header_last(F.col("headers"), H.SENDER).alias("sender_text"),
                      F.size("headers").alias("n_headers"))


@query("verdict_report")
def _(spark, sf_dir):
    return _place(reports.verdict_report(_judged(spark, sf_dir)), "arrival_seq", "verdict",
                  "verified", "failed_by", "reason", "message_id")


@query("verdict_summary")
def _(spark, sf_dir):
    return _place(reports.verdict_summary(_judged(spark, sf_dir)), "topic", "partition",
                  "verdict", "failed_by", "n", "first_seq", "last_seq")


@query("sender_summary")
def _(spark, sf_dir):
    return reports.sender_summary(_judged(spark, sf_dir))


# State tables and the key store

@query("latest_offsets")
def _(spark, sf_dir):
    return _place(reports.latest_offsets(_judged(spark, sf_dir)),
                  "topic", "partition", "latest_offset")


@query("latest_offset_lookup")
def _(spark, sf_dir):
    """Every partition in use and its successor; -1 where nothing was accepted."""
    rows = _normalised(spark, sf_dir)
    wanted = (rows.select("topic", F.explode(F.array("partition", F.col("partition") + 1))
                          .alias("partition")).distinct())
    offsets = reports.latest_offsets(verify_chain(rows).verdicts)
    return _place(reports.look_up_offsets(wanted, offsets), "topic", "partition", "latest_offset")


@query("all_watermarks")
def _(spark, sf_dir):
    return _place(reports.all_watermarks(_judged(spark, sf_dir)),
                  "sender_raw", "topic", "partition", "watermark_ms")


@query("watermark_lookup")
def _(spark, sf_dir):
    """Every sender on every partition that follows one of its own; NULL where none is known."""
    rows = _normalised(spark, sf_dir)
    wanted = (rows.where(F.col("sender_raw").isNotNull())
              .select("sender_raw", "topic",
                      F.explode(F.array("partition", (F.col("partition") + 1) % 4))
                      .alias("partition")).distinct())
    watermarks = reports.all_watermarks(verify_chain(rows).verdicts)
    return _place(reports.look_up_watermarks(wanted, watermarks),
                  "sender_raw", "topic", "partition", "watermark_ms")


def _log(spark, sf_dir):
    """Every keyed record stores its key: the store on its own, without a check before it."""
    return (_normalised(spark, sf_dir).where(N.is_keyed())
            .select("sender_key", "message_id", F.col("ingest_ms").alias("stored_ms"),
                    F.col("arrival_seq").alias("stored_seq")))


@query("key_store_upsert")
def _(spark, sf_dir):
    return keystore.upsert(_log(spark, sf_dir))


@query("stored_keys_text")
def _(spark, sf_dir):
    return single.stored_keys(_normalised(spark, sf_dir))


@query("evict_by_time")
def _(spark, sf_dir):
    return keystore.evict_by_time(keystore.upsert(_log(spark, sf_dir)), 300_000)


@query("evict_by_size")
def _(spark, sf_dir):
    return keystore.evict_by_size(keystore.upsert(_log(spark, sf_dir)), 500)


@query("live_keys")
def _(spark, sf_dir):
    """Keys that the chain's store holds at the end."""
    return keystore.live_keys(reports.store_log(_judged(spark, sf_dir)))


@query("key_store_size")
def _(spark, sf_dir):
    return keystore.size(keystore.live_keys(_log(spark, sf_dir), 500, 300_000))


@query("key_remove")
def _(spark, sf_dir):
    """Remove the keys that were sent again, and keys nobody stored."""
    rows = _normalised(spark, sf_dir).where(N.is_keyed())
    again = N.normalise(_records(spark, sf_dir), "kind").where("kind = 1").where(N.is_keyed())
    unknown = rows.select(F.lit("nobody").alias("sender_key"), "message_id")
    return keystore.remove(keystore.upsert(_log(spark, sf_dir)),
                           again.select("sender_key", "message_id").unionByName(unknown))


OPS_CAP, OPS_TTL_MS = 75, 60_000


def _operations(spark, sf_dir):
    """A log of store operations: every key is stored, some are removed and looked up later."""
    rows = _normalised(spark, sf_dir)
    seq, ms = F.col("arrival_seq"), F.col("ingest_ms")
    keyed = rows.where(N.is_keyed())

    def later(kind, every, records, place):
        return keyed.where(seq % every == 0).select(
            (4 * (seq + records) + place).alias("op_seq"), F.lit(kind).alias("kind"), "sender_key",
            "message_id", (ms + 500 * records).alias("op_ms"))

    clears = rows.where(seq % 3_000 == 2_999).select(
        (4 * seq + 3).alias("op_seq"), F.lit("clear").alias("kind"), ms.alias("op_ms"))
    return (later("store", 1, 0, 0).unionByName(later("remove", 5, 60, 1))
            .unionByName(later("exists", 3, 90, 2)).unionByName(clears, allowMissingColumns=True))


@query("key_store_ops")
def _(spark, sf_dir):
    """Look-ups in a store that is also removed from and cleared in between."""
    return replay(_operations(spark, sf_dir), OPS_CAP, OPS_TTL_MS, SMALL_CHUNK).answers


@query("key_store_after_ops")
def _(spark, sf_dir):
    """What that store holds in the end."""
    return replay(_operations(spark, sf_dir), OPS_CAP, OPS_TTL_MS, SMALL_CHUNK).store


@query("key_store_after_clear")
def _(spark, sf_dir):
    """Clear half way through the log, then go on storing."""
    log = _log(spark, sf_dir)
    middle = log.agg(F.floor(F.max("stored_seq") / 2)).scalar()
    return keystore.upsert(keystore.after_clear(log, middle))


def _probes(spark, sf_dir):
    """Every keyed record's key, and the same ids under a sender that stored nothing."""
    rows = _normalised(spark, sf_dir).where(N.is_keyed())
    return rows.select("arrival_seq", F.explode(F.array(
        "sender_key", F.concat(F.lit("x-"), "sender_key"))).alias("sender_key"), "message_id")


@query("key_exists")
def _(spark, sf_dir):
    live = keystore.live_keys(_log(spark, sf_dir), 500, 300_000)
    return keystore.exists(_probes(spark, sf_dir), live)


@query("bloom_then_exact")
def _(spark, sf_dir):
    live = keystore.live_keys(_log(spark, sf_dir), 500, 300_000)
    return keystore.exists(_probes(spark, sf_dir), live, "bloom", 500)


@query("bloom_build_stats")
def _(spark, sf_dir):
    return bloom.bloom_stats(keystore.upsert(_log(spark, sf_dir)))


# Histograms

def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(hist):
    return hist.withColumn("upper_bound", F.round("upper_bound", 4))


@query("hist_hybrid")
def _(spark, sf_dir):
    return _shown(histogram.histogram(_table(spark, sf_dir, "orders"), F.col("o_totalprice"),
                                      histogram.hybrid_bounds(150)))


@query("hist_pow2")
def _(spark, sf_dir):
    return _shown(histogram.histogram(_table(spark, sf_dir, "lineitem"),
                                      F.col("l_extendedprice"), histogram.pow2_bounds(24)))


@query("hist_log")
def _(spark, sf_dir):
    return _shown(histogram.histogram(_table(spark, sf_dir, "lineitem"),
                                      F.col("l_extendedprice"), histogram.log_bounds(100)))


@query("hist_log_range")
def _(spark, sf_dir):
    return _shown(histogram.histogram(_table(spark, sf_dir, "orders"), F.col("o_totalprice"),
                                      histogram.log_bounds(50, 100.0, 10_000.0)))


@query("histogram_events_value")
def _(spark, sf_dir):
    return _shown(histogram.histogram(_table(spark, sf_dir, "events"), F.col("value"),
                                      histogram.pow2_bounds(10)))


@query("histogram_lateness")
def _(spark, sf_dir):
    judged = single.verify_watermarks(_normalised(spark, sf_dir))
    late = judged.select(F.try_subtract("prev_watermark", "sender_ts").alias("lateness_ms"))
    return _shown(histogram.histogram(late, F.col("lateness_ms"), histogram.log_bounds(30)))


@query("hist_compare")
def _(spark, sf_dir):
    compared = histogram.compare_bounds(
        _table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"),
        {"hybrid": histogram.hybrid_bounds(150), "pow2": histogram.pow2_bounds(24),
         "log": histogram.log_bounds(50), "log 0.1-100": histogram.log_bounds(50, 0.1, 100.0),
         "log 100-10000": histogram.log_bounds(50, 100.0, 10_000.0)})
    return compared.withColumns({c: F.round(c, 4) for c in ("first_finite", "last_finite")})


# Streams

def _chain_stream(spark, sf_dir):
    """The chain as a stream that is stopped and resumed."""
    records = _records(spark, sf_dir)
    path = Scratch(spark, "stream").path("run")
    cut = records.agg(F.floor((F.max("arrival_seq") + 1) / 2)).scalar()
    first_half = F.col("arrival_seq") < cut
    consumer = Consumer(f"{path}/out")
    for side in (first_half, ~first_half):
        (records.where(side).select(*RECORD_SCHEMA.names)
         .write.mode("append").parquet(f"{path}/in"))
        consumer.start(stream_records(spark, f"{path}/in")).awaitTermination()
    return consumer


@query("stream_chain_verify")
def _(spark, sf_dir):
    return _place(_chain_stream(spark, sf_dir).verdicts(spark), *_VERDICT)


@query("stream_latest_offsets")
def _(spark, sf_dir):
    """The last accepted offsets, looked up in the state of the stream."""
    return _place(state_offsets(_chain_stream(spark, sf_dir).state(spark)), "topic", "partition",
                  "latest_offset")


@query("stream_watermarks")
def _(spark, sf_dir):
    """All watermarks, looked up in the state of the stream."""
    return _place(state_watermarks(_chain_stream(spark, sf_dir).state(spark)), "sender_raw", "topic",
                  "partition", "watermark_ms")


@query("stream_live_keys")
def _(spark, sf_dir):
    """The keys that the stream's store holds."""
    return state_keys(_chain_stream(spark, sf_dir).state(spark))


def _topic_stream(spark, sf_dir, payload):
    """Topic rows as a stream of four parts, resumed for each of them."""
    rows, path = _topic_rows(spark, sf_dir), Scratch(spark, "topic").path("run")
    consumer = Consumer(f"{path}/out", payload=payload)
    edges = _records(spark, sf_dir).agg(F.min("timestamp").alias("lo"),
                                        F.max("timestamp").alias("hi"))
    place = F.floor(4 * (F.unix_millis("timestamp") - edges.select(F.unix_millis("lo")).scalar())
                    / (edges.select(F.unix_millis("hi")).scalar()
                       - edges.select(F.unix_millis("lo")).scalar() + 1))
    for quarter in range(4):
        rows.where(place == quarter).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        consumer.start(kafka.as_records(stream)).awaitTermination()
    return consumer


@query("stream_topic_verify")
def _(spark, sf_dir):
    """Numbers and clock go on across micro-batches and a restart."""
    verdicts = _topic_stream(spark, sf_dir, payload=False).verdicts(spark)
    return _place(verdicts, *_VERDICT)


@query("stream_accepted")
def _(spark, sf_dir):
    """The accepted records of a topic stream, with key and value."""
    return _place(_topic_stream(spark, sf_dir, payload=True).accepted(spark),
                  "offset", "partition", "key", "value", "ingest_ms")


LANE_ROWS = 1 << 20  # records that a lane stream takes at a time
LANE_FILES = 8  # files of a part, and of a micro-batch
LANE_PARTS = 16  # parts between two starts of the stream


def _lane_stream(spark, sf_dir, checks):
    """One lane per topic partition with keyed state: the verdicts, and the state that is left.

    A micro-batch is a part of the records, so a lane holds the rows of one part at a time. The stream
    is resumed after several parts only, as each start reads the lanes' whole state again.
    """
    path = Scratch(spark, "lanes").path("run")
    records, staged = _records(spark, sf_dir), f"{path}/staged"
    other = with_settings(spark, {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.minBatchesToRetain": "2",  # it goes on from the last one only
        "spark.sql.shuffle.partitions": str(lane_partitions(records, "partition"))})
    (records.select(*RECORD_SCHEMA.names, F.floor(F.col("arrival_seq") / LANE_ROWS).alias("part_no"))
     .write.partitionBy("part_no").parquet(staged))
    parts = [row[0] for row in spark.read.schema("part_no bigint").parquet(staged).distinct()
             .orderBy("part_no").collect()]
    if not parts:
        spark.createDataFrame([], RECORD_SCHEMA).write.parquet(f"{path}/in")
        schema = _run_lanes(other, path, checks)
    waiting, files = 0, 0
    for part in parts:
        (read_records(spark, f"{staged}/part_no={part}").repartition(LANE_FILES, "arrival_seq")
         .write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{path}/in"))
        delete_folder(spark, f"{staged}/part_no={part}")
        before, files = files, len(read_records(spark, f"{path}/in").inputFiles())
        waiting += 1
        # A part of fewer files must be the last of its run, or later batches would have rows of two parts.
        if waiting == LANE_PARTS or files - before < LANE_FILES or part == parts[-1]:
            schema, waiting = _run_lanes(other, path, checks), 0
    return spark.read.schema(schema).parquet(f"{path}/out"), lane_state(other, f"{path}/checkpoint", checks)


def _run_lanes(spark, path, checks):
    """Judge the files that are new, a part at a time; returns the schema of the verdicts."""
    verdicts = verify_stream(stream_records(spark, f"{path}/in", LANE_FILES), checks=checks).select(*_VERDICT)
    (verdict_stream(verdicts, f"{path}/out", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return verdicts.schema


NO_LIMITS = default_checks(cap=None, ttl_ms=None)
SMALL_STORES = default_checks(cap=100, ttl_ms=100_000)


@query("stream_lane_verify")
def _(spark, sf_dir):
    """With a key store that forgets nothing."""
    return _place(_lane_stream(spark, sf_dir, NO_LIMITS)[0], *_VERDICT)


@query("stream_lane_store")
def _(spark, sf_dir):
    """With a key store per lane that forgets by size and age."""
    return _place(_lane_stream(spark, sf_dir, SMALL_STORES)[0], *_VERDICT)


@query("stream_lane_offsets")
def _(spark, sf_dir):
    """The last accepted offsets, read from the stream's state store."""
    return _place(state_offsets(_lane_stream(spark, sf_dir, NO_LIMITS)[1]), "topic", "partition",
                  "latest_offset")


@query("stream_lane_keys")
def _(spark, sf_dir):
    """The live keys of every lane, read from the stream's state store."""
    state = _lane_stream(spark, sf_dir, SMALL_STORES)[1]
    part = F.get_json_object("lane", "$.partition").cast("int").alias("part")
    entry = F.col("pieces")[0]
    return state.where(F.col("check") == UNIQUENESS).select(
        part, F.col("key")[0].alias("sender_key"), F.col("key")[1].alias("message_id"),
        entry["time"].alias("stored_ms"))
