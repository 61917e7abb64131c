"""Verify a stream exactly: every micro-batch runs the chain from the state before it.

The state is kept as a log: a batch writes the states of its own keys only, as a delta, so what it
writes follows the batch and not the state. Every few batches the deltas are merged into a new base,
without the keys of the store that nothing can meet any more. A batch looks up the states of its keys
in the base and the deltas since. A batch that is run again after a failure starts from the
same folders and overwrites its own output only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.outcomes import OFFSET, SENDER_WATERMARK, UNIQUENESS
from ..operators.chain import verify_chain
from ..operators.normalize import normalise
from ..operators.reports import verdict_report
from ..plans.arrival import CHUNK_ROWS
from ..plans.checks import Check, Uniqueness, default_checks
from ..plans.fold import EFFECT_SCHEMA
from ..plans.scratch import delete_folder, folders
from ..sources.kafka import ARRIVAL_ORDER, in_arrival_order


class Consumer:
    """Runs the chain on a stream and keeps verdicts and state below ``path``.

    ``path`` must be storage that all executors share. Records without ``arrival_seq`` are
    numbered on from the micro-batch before, and their store clock never falls below the one
    reached there. With ``payload`` the raw records go to ``accepted`` and ``rejected`` as well.
    Every ``merge_every``-th state is a base; older folders go with the batch after it.
    """

    def __init__(self, path: str, checks: list[Check] | None = None,
                 chunk_rows: int = CHUNK_ROWS, payload: bool = False, merge_every: int = 16):
        self.path = path.rstrip("/")
        self.checks = checks or default_checks()
        self.chunk_rows = chunk_rows
        self.payload = payload
        self.merge_every = merge_every

    def start(self, records: DataFrame, **trigger) -> StreamingQuery:
        return (records.writeStream.foreachBatch(self.process)
                .option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        records = batch if "arrival_seq" in batch.columns else self._number(batch, batch_id)
        # Dead keys of the store may be among them; the check knows them by their age.
        base, deltas = self._folders(spark, batch_id - 1)
        known = base is not None or deltas
        before = self._newest(self._read(spark, base, deltas)) if known else None
        run = verify_chain(normalise(records), self.checks, self.chunk_rows, before,
                           keep_state=True)
        report = self._out("verdicts", batch_id)
        verdict_report(run.verdicts).write.mode("overwrite").parquet(report)
        if self.payload:
            self._write_payload(records, spark.read.parquet(report), batch, batch_id)
        self._write_state(spark, run.changed, batch_id)
        delete_folder(spark, self._progress_path(batch_id - 2))

    def _write_state(self, spark: SparkSession, changed: DataFrame, batch_id: int) -> None:
        base, deltas = self._folders(spark, batch_id - 1)
        if len(deltas) + 1 < self.merge_every:
            changed.write.mode("overwrite").parquet(self._state_path(batch_id, "delta"))
        else:
            merged = self._newest([*self._read(spark, base, deltas), (batch_id, changed)])
            self._live(merged).write.mode("overwrite").parquet(self._state_path(batch_id, "base"))
        if base == batch_id - 1:
            # The batch that wrote this base is over, so nothing older is asked for again.
            for old in self._listed(spark):
                if old[0] < base:
                    delete_folder(spark, self._state_path(*old))

    def _number(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Numbers and clock go on where the batch before ended; the payload is left out."""
        spark = batch.sparkSession
        reached = spark.read.parquet(self._progress_path(batch_id - 1)).first() if batch_id else None
        first, clock = reached or (0, None)
        numbered = in_arrival_order(batch.drop("key", "value")).withColumns({
            "arrival_seq": F.col("arrival_seq") + F.lit(first),
            "ingest_ms": F.greatest("ingest_ms", F.lit(clock).cast("bigint"))})
        (numbered.agg(F.coalesce(F.max("arrival_seq") + 1, F.lit(first)).alias("next_seq"),
                      F.coalesce(F.max("ingest_ms"), F.lit(clock).cast("bigint")).alias("clock"))
         .write.mode("overwrite").parquet(self._progress_path(batch_id)))
        return numbered

    def _write_payload(self, records: DataFrame, report: DataFrame, batch: DataFrame,
                       batch_id: int) -> None:
        """Raw records by verdict; only the rejected ones, usually few, are looked up."""
        gone = report.where("not verified").select("arrival_seq", "verdict", "failed_by", "reason")
        if "arrival_seq" in batch.columns:
            key = ["arrival_seq"]
        else:
            key = ARRIVAL_ORDER
            gone = records.select("arrival_seq", *key).join(gone, "arrival_seq").drop("arrival_seq")
        for name, rows in (("accepted", batch.join(gone.select(*key), key, "left_anti")),
                           ("rejected", batch.join(gone, key))):
            rows.write.mode("overwrite").parquet(self._out(name, batch_id))

    def _out(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch_id={batch_id}"

    def _progress_path(self, batch_id: int) -> str:
        return f"{self.path}/progress-{batch_id:010d}"

    def accepted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/accepted")

    def rejected(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rejected")

    def verdicts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/verdicts")

    def state(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The state after a batch, or the last: the newest entry of every key, live ones of the store."""
        batch_id = max((batch for batch, _ in self._listed(spark)), default=-1) if (
            batch_id is None) else batch_id
        return self._live(self._newest(self._read(spark, *self._folders(spark, batch_id))))

    def _state_path(self, batch_id: int, kind: str) -> str:
        return f"{self.path}/state/{batch_id:010d}-{kind}"

    def _listed(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(batch, kind) of all complete folders of the state log."""
        names = folders(spark, f"{self.path}/state", "_SUCCESS")
        return sorted((int(name[:10]), name[11:]) for name in names)

    def _folders(self, spark: SparkSession, batch_id: int) -> tuple[int | None, list[int]]:
        """The last base up to a batch, and the deltas since."""
        listed = [entry for entry in self._listed(spark) if entry[0] <= batch_id]
        base = max((batch for batch, kind in listed if kind == "base"), default=None)
        return base, [batch for batch, kind in listed
                      if kind == "delta" and (base is None or batch > base)]

    def _read(self, spark: SparkSession, base: int | None,
              deltas: list[int]) -> list[tuple[int, DataFrame]]:
        read = spark.read.schema(EFFECT_SCHEMA)
        found = [] if base is None else [(base, read.parquet(self._state_path(base, "base")))]
        found += [(batch, read.parquet(self._state_path(batch, "delta"))) for batch in deltas]
        return found or [(-1, spark.createDataFrame([], EFFECT_SCHEMA))]

    def _newest(self, parts: list[tuple[int, DataFrame]]) -> DataFrame:
        if len(parts) == 1:
            return parts[0][1]
        every = [part.withColumn("batch", F.lit(batch)) for batch, part in parts]
        rest = [name for name in EFFECT_SCHEMA.names if name not in ("check", "key")]
        newest = F.max_by(F.struct(*rest), "batch").alias("newest")
        # Grouped by its keys only, so that a look-up of some keys is done before.
        return (reduce(DataFrame.unionByName, every).groupBy("check", "key").agg(newest)
                .select("check", "key", "newest.*").select(*EFFECT_SCHEMA.names))

    def _live(self, state: DataFrame) -> DataFrame:
        """Drop stored keys that no later record can meet, so the state stays bounded."""
        store = next((c for c in self.checks if isinstance(c, Uniqueness)), None)
        if store is None:
            return state
        totals = state.where(F.col("check").isNull())
        entry = F.col("pieces")[0]
        dead = F.lit(False)
        if store.cap is not None:
            dead = dead | (totals.select("stores").scalar() - entry["to"] >= store.cap)
        if store.ttl_ms is not None:
            dead = dead | (totals.select("clock").scalar() - entry["time"] > store.ttl_ms)
        is_key = F.coalesce(F.col("check") == UNIQUENESS, F.lit(False))
        return state.where(~is_key | ~F.coalesce(dead, F.lit(False)))


def _keyed_state(state: DataFrame, check: str, names: list[str]) -> DataFrame:
    key, entry = F.col("key"), F.col("pieces")[0]
    return state.where(F.col("check") == check).select(
        *[key[i].alias(name) for i, name in enumerate(names)], entry["to"].alias("to"),
        entry["time"].alias("time"))


def state_offsets(state: DataFrame) -> DataFrame:
    return _keyed_state(state, OFFSET, ["topic", "partition"]).select(
        "topic", F.col("partition").cast("int").alias("partition"), F.col("to").alias("latest_offset"))


def state_watermarks(state: DataFrame) -> DataFrame:
    return _keyed_state(state, SENDER_WATERMARK, ["sender_raw", "topic", "partition"]).select(
        "sender_raw", "topic", F.col("partition").cast("int").alias("partition"),
        F.col("to").alias("watermark_ms"))


def state_keys(state: DataFrame) -> DataFrame:
    return _keyed_state(state, UNIQUENESS, ["sender_key", "message_id"]).select(
        "sender_key", "message_id", F.col("time").alias("stored_ms"))
