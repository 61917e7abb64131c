"""The chain of checks over a table of records, exact and in parallel.

The verdict of a record depends on the records accepted before it. Records are cut into
bounded chunks of the arrival order; every chunk is walked on its own, starting from the
state that earlier chunks leave behind (its seeds). The seeds are found by repetition:

1. judge all chunks, from the state of an earlier run or from nothing, and note their effects,
2. carry the effects forward to get each chunk's seeds,
3. judge the chunks whose seeds changed again, and go on with 2 until none changes.

The first chunk is right after one pass, and every pass makes at least one more right, so
the repetition ends with the exact result. Passes after the second usually see few chunks.
No step puts a whole key, partition or sender into one task: rows meet by chunk, and effects by
blocks of a key's chunks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcomes as O
from ..plans.arrival import CHUNK_ROWS, split_into_chunks
from ..plans.checks import Check, CombiningCheck, SenderWatermark, default_checks
from ..plans.fold import (BLOCK, EFFECT_SCHEMA, as_function, carry_effects, chunks_in_run, fold_effects,
                          fold_verdicts, run_column, store_totals)
from ..plans.scratch import materialise, materialise_bucketed
from .normalize import NORMALISED, is_keyed, is_timed

STATE_CHUNK = -1
MAX_BUCKETS = 100_000  # Spark takes no more buckets for a table


@dataclass(frozen=True)
class ChainRun:
    """Result of a chain run; ``state`` is there when the run was asked to keep it.

    ``changed`` has the states of keys that these records have, and the totals of the store.
    """

    verdicts: DataFrame
    passes: int
    chunks: int
    state: DataFrame | None = None
    changed: DataFrame | None = None


def _keys_in_several_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, key) of the message ids that more than one chunk has."""
    ids = rows.where(is_keyed()).select("sender_key", "message_id", "chunk")
    names = ["sender_key", "message_id"]
    shared = (ids.groupBy(*names).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
              .where("lo < hi").select(*names))
    # Spark takes the side's size at run time to choose the kind of join.
    found = ids.join(shared, names, "left_semi").distinct()
    return found.select("chunk", F.lit(O.UNIQUENESS).alias("check"),
                        F.array(*names).alias("key"),
                        F.lit(None).cast(EFFECT_SCHEMA["used"].dataType).alias("seed"))


def _seeds_settled_at_once(checks: list[Check]) -> bool:
    """A lone offset or watermark check sums up a chunk exactly whatever its seeds are."""
    return len(checks) == 1 and checks[0].name in (O.OFFSET, O.SENDER_WATERMARK)


def record_columns(checks: list[Check]) -> list[str]:
    """Normalised columns, and what custom checks read besides."""
    return list(dict.fromkeys(NORMALISED + [c for check in checks for c in check.columns]))


def verify_chain(normalised: DataFrame, checks: list[Check] | None = None,
                 chunk_rows: int = CHUNK_ROWS, state: DataFrame | None = None,
                 keep_state: bool = False) -> ChainRun:
    """Judge every record of a normalised table.

    ``checks`` run by rising priority and the first failure decides; equal priorities keep
    their order. ``state`` is the end state of an earlier run to go on from.
    """
    checks = sorted(checks or default_checks(), key=lambda c: c.priority)
    cut = split_into_chunks(normalised.select(*record_columns(checks)), chunk_rows)
    spark = normalised.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = chunks_in_run(cut.chunks, chunk_rows, parallel)
    records = cut.df.withColumn("_run", run_column(together))
    if cut.chunks <= 1 and state is None and not keep_state:
        return ChainRun(with_outcomes(fold_verdicts(records, None, checks), checks), 1, cut.chunks)

    # A bucket holds many runs of chunks, one judged after the other; their number follows the cluster.
    rows = materialise_bucketed(records, "rows", min(parallel, MAX_BUCKETS), "_run")

    before, idle = spark.createDataFrame([], EFFECT_SCHEMA), None
    if state is not None:
        # Only the states of keys that these records have take part.
        asked = materialise(_asked_keys(rows, checks), "asked")
        keys = asked.select("check", "key").distinct()
        idle = state.where(F.col("check").isNotNull()).join(keys, ["check", "key"], "left_anti")
        before = materialise(state.where(F.col("check").isNull()).unionByName(
            state.join(keys, ["check", "key"], "left_semi")), "before")
        # An id that is in one chunk only and has no state meets nothing, so it is not carried.
        met = (_keys_in_several_chunks(rows).select("check", "key")
               .unionByName(before.where(F.col("check") == O.UNIQUENESS).select("check", "key")).distinct())
        is_id = F.col("check") == O.UNIQUENESS
        nothing = (asked.where(~is_id).unionByName(asked.where(is_id).join(met, ["check", "key"], "left_semi")
                                                   .select(*asked.columns))
                   .unionByName(before, allowMissingColumns=True))
        start = materialise(carry_effects(nothing, checks, cut.chunks), "start").where(
            F.col("chunk") > STATE_CHUNK)
    elif any(check.name == O.UNIQUENESS for check in checks):
        start = materialise(_keys_in_several_chunks(rows), "touch")
    else:
        start = None
    # Carrying states inside a run costs more than it saves where no state adds up.
    onward = any(isinstance(check, CombiningCheck) for check in checks)
    effects = materialise(fold_effects(rows, start, checks, together, onward), "effects")
    passes = 1
    while True:
        seeds = materialise(carry_effects(effects.unionByName(before), checks, cut.chunks), "seeds")
        current = seeds.where(F.col("chunk") > STATE_CHUNK)
        # A lone chunk started from the state, and nothing comes before it.
        if _seeds_settled_at_once(checks) or cut.chunks == 1:
            break
        changed = materialise(current.where(~F.col("used").eqNullSafe(F.col("seed")))
                              .select("chunk").distinct(), "changed")
        if changed.isEmpty():
            break
        if passes > cut.chunks:
            raise RuntimeError("the chain does not settle: is arrival_seq unique and stable?")
        again = fold_effects(rows.join(changed, "chunk", "left_semi"),
                             current.join(changed, "chunk", "left_semi"), checks, together)
        effects = materialise(again.unionByName(effects.join(changed, "chunk", "left_anti")),
                              "effects")
        passes += 1
    if not keep_state:
        judged = fold_verdicts(rows, current, checks, together)
        return ChainRun(with_outcomes(judged, checks), passes, cut.chunks)
    judged = materialise(fold_verdicts(rows, current, checks, together, numbered=True), "judged")
    end = _end_state(seeds, effects.unionByName(before), judged, before, checks)
    return ChainRun(with_outcomes(judged.drop("store_no"), checks), passes, cut.chunks,
                    end if idle is None else end.unionByName(idle), end)


def _asked_keys(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """(chunk, check, key) of all keys, as effects that change nothing."""
    found = None
    for check in checks:
        columns = check.key_columns
        given = (is_timed() if isinstance(check, SenderWatermark) else
                 reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))
        keys = rows.where(given).select(
            "chunk", F.lit(check.name).alias("check"),
            F.array(*[F.col(c).cast("string") for c in columns]).alias("key")).distinct()
        found = keys if found is None else found.unionByName(keys)
    return found.select(*[F.col(f.name) if f.name in found.columns else
                          F.lit(None).cast(f.dataType).alias(f.name) for f in EFFECT_SCHEMA])


def _end_state(seeds: DataFrame, effects: DataFrame, judged: DataFrame, before: DataFrame,
               checks: list[Check]) -> DataFrame:
    """States after the last record, in the form of effects of a chunk before all others.

    Of the store's keys those are left out that no later record can meet.
    """
    ends = (seeds.where(F.col("check") != O.UNIQUENESS).groupBy("check", "key")
            .agg(F.max_by("after", "chunk").alias("after")).where(F.col("after").isNotNull()))
    keys = ends.select("check", "key", *[c.alias(name) for name, c in as_function("after").items()])
    totals = (effects.where(F.col("check").isNull())
              .agg(F.sum("stores").alias("stores"), F.max("clock").alias("clock"))
              .where(F.col("stores").isNotNull()))
    store = next((check for check in checks if check.name == O.UNIQUENESS), None)
    if store is not None:
        entry = F.col("pieces")[0]
        stored = (judged.where(F.col("store_no").isNotNull())
                  .join(F.broadcast(store_totals(effects, BLOCK)), "chunk")
                  .select(F.array("sender_key", "message_id").alias("key"),
                          (F.col("base") + F.col("store_no")).alias("to"),
                          F.col("ingest_ms").alias("time"))
                  .unionByName(before.where(F.col("check") == O.UNIQUENESS).select(
                      "key", entry["to"].alias("to"), entry["time"].alias("time"))))
        if store.cap is not None:
            stored = stored.where(totals.select("stores").scalar() - F.col("to") < store.cap)
        if store.ttl_ms is not None:
            stored = stored.where(totals.select("clock").scalar() - F.col("time") <= store.ttl_ms)
        newest = stored.groupBy("key").agg(F.max(F.struct("to", "time")).alias("last"))
        nothing = F.lit(None).cast("bigint")
        keys = keys.unionByName(newest.select(
            F.lit(O.UNIQUENESS).alias("check"), "key", F.array(F.struct(
                nothing.alias("x"), nothing.alias("y"), F.col("last.to").alias("to"),
                F.col("last.time").alias("time"))).alias("pieces"),
            F.lit(None).cast("string").alias("text")))
    return (keys.unionByName(totals, allowMissingColumns=True)
            .withColumns({"chunk": F.lit(STATE_CHUNK).cast("bigint"),
                          "used": F.lit(None).cast(EFFECT_SCHEMA["used"].dataType)})
            .select(*EFFECT_SCHEMA.names))


def with_outcomes(judged: DataFrame, checks: list[Check]) -> DataFrame:
    """Verdict, outcome class of every check that ran, and the reason of a rejection."""
    place = {check.name: i for i, check in enumerate(checks)}
    threshold = next((c.threshold_ms for c in checks if isinstance(c, SenderWatermark)), 0)
    failed_by = F.col("failed_by")
    verdict = F.lit(None).cast("string")
    for check in checks:
        verdict = F.when(failed_by == check.name, check.verdict).otherwise(verdict)
    verdict = F.when(failed_by.isNull(), O.SUCCESS).otherwise(verdict)

    def ran(name: str, outcome):
        if name not in place:
            return F.lit(None).cast("string")
        return F.when(F.col("n_checked") > place[name], outcome)

    prev_offset, prev_watermark = F.col("prev_offset"), F.col("prev_watermark")
    return judged.withColumns({
        "verdict": verdict,
        "verified": O.is_verified(verdict),
        "uniq_outcome": ran(O.UNIQUENESS, O.uniqueness_outcome(
            F.coalesce(failed_by == O.UNIQUENESS, F.lit(False)))),
        "offset_outcome": ran(O.OFFSET, O.offset_outcome(prev_offset)),
        "wm_outcome": ran(O.SENDER_WATERMARK, O.watermark_outcome(prev_watermark, threshold)),
        "reason": O.reason(failed_by, prev_offset, prev_watermark, threshold),
        "sender_instant": F.timestamp_millis(F.col("sender_ts")),
    }).drop("chunk", "_run", "n_checked")
