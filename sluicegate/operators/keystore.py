"""The bounded key store as tables: upsert, look-up, removal, clearing and eviction.

A store log has sender_key, message_id, stored_ms and stored_seq (the arrival order of the
stores); stored_ms does not fall with stored_seq. A store table has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.arrival import CHUNK_ROWS, chunk_column
from ..plans.checks import BLOOM_FPP, STORE_SIZE, STORE_TTL_MS
from ..plans.scratch import materialise
from .bloom import build_bloom, with_maybe

KEY = ["sender_key", "message_id"]


def upsert(log: DataFrame) -> DataFrame:
    """One row per key; storing a key again refreshes its time."""
    return (log.groupBy(*KEY)
            .agg(F.max("stored_ms").alias("stored_ms"), F.max("stored_seq").alias("stored_seq")))


def after_clear(log: DataFrame, clear_seq) -> DataFrame:
    """The log from the clearing on: everything stored up to ``clear_seq`` is gone."""
    return log.where(F.col("stored_seq") > clear_seq)


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Take keys out; keys that are not stored do no harm."""
    return store.join(keys.select(*KEY), KEY, "left_anti")


def evict_by_time(store: DataFrame, ttl_ms: int = STORE_TTL_MS) -> DataFrame:
    """Drop keys that are older than ``ttl_ms`` at the last store; an equal age stays."""
    last_store = store.agg(F.max("stored_ms")).scalar()
    return store.where(last_store - F.col("stored_ms") <= ttl_ms)


def evict_by_size(store: DataFrame, cap: int = STORE_SIZE,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keep the ``cap`` newest keys.

    Counts per chunk of the store order tell which chunks hold them. Only the keys of those
    chunks are ranked, each chunk on its own, so no task sorts more than a chunk.
    """
    chunk = chunk_column("stored_seq", 0, chunk_rows)
    newer = Window.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    needed = (store.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
              .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
              .where(F.col("_newer") < cap).select("_chunk", "_newer"))
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("stored_seq")))
    return (store.withColumn("_chunk", chunk).join(needed, "_chunk")
            .withColumn("_place", place).where(F.col("_newer") + F.col("_place") <= cap)
            .select(*store.columns))


def live_keys(log: DataFrame, cap: int = STORE_SIZE, ttl_ms: int = STORE_TTL_MS) -> DataFrame:
    """The store after the whole log: age first, then size.

    Both evictions look at the whole store before they filter it, so it is written once.
    """
    return evict_by_size(evict_by_time(materialise(upsert(log), "store"), ttl_ms), cap)


def size(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("n"))


def exists(keys: DataFrame, store: DataFrame, prefilter: str = "none", cap: int = STORE_SIZE,
           fpp: float = BLOOM_FPP) -> DataFrame:
    """Add ``is_stored`` to every row of ``keys``.

    With ``prefilter="bloom"`` only keys that pass a Bloom filter of the store are compared;
    the answer is the same. Spark's own run-time filter does that for large joins, so the plain join is
    usually the faster one; the option is there for stores that are asked for much and hold little of it.
    """
    stored = store.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    if prefilter == "none":
        return _flagged(keys, stored)
    if prefilter != "bloom":
        raise ValueError(f"unknown prefilter {prefilter!r}")
    stored = materialise(stored, "stored")
    probed = with_maybe(keys, build_bloom(stored, cap, fpp), "_maybe")
    other = stored.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_hit")
    same = [F.col(c) == F.col(f"_{c}") for c in KEY]
    return (probed.join(other, [F.col("_maybe"), *same], "left")
            .withColumn("is_stored", F.coalesce("_hit", F.lit(False)))
            .drop("_hit", "_maybe", *[f"_{c}" for c in KEY]))


def _flagged(keys: DataFrame, stored: DataFrame) -> DataFrame:
    return (keys.join(stored, KEY, "left")
            .withColumn("is_stored", F.coalesce("_hit", F.lit(False))).drop("_hit"))
