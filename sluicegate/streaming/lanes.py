"""Verify a stream with keyed state per lane, for low latency.

A lane sees only its own records. ``partition`` lanes are exact when copies of a message id
stay in one topic partition and the key store forgets nothing another lane would still hold;
``sender`` lanes see an id on every partition, but keep offsets per sender. Size and age
limits of the key store apply per lane. ``Consumer`` is exact in all cases.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from ..functions.outcomes import UNIQUENESS
from ..operators.chain import record_columns, with_outcomes
from ..operators.normalize import normalise
from ..plans.checks import Check, CombiningCheck, CustomCheck, Uniqueness, default_checks
from ..plans.fold import VERDICT_FIELDS, open_lanes, verdict_columns
from ..plans.lanes import STATE, StoreLane, walk
from .keylog import Digests, KeyLog, key_names

_SEEDS = pa.schema([("check", pa.string()), ("key", pa.list_(pa.string())), ("seed", STATE)])


def lane_column(lane: str) -> Column:
    place = F.to_json(F.struct("topic", "partition"))
    if lane == "partition":
        return place
    if lane == "sender":
        # Records without a sender stay spread over their partitions.
        return F.coalesce(F.concat(F.lit("sender:"), "sender_key"), place)
    raise ValueError(f"unknown lane {lane!r}")


def lane_partitions(records: DataFrame, lane: str) -> int:
    """Fewest state partitions, up to the session's, that spread the lanes of some records best.

    Every partition costs a worker's call and a commit in each micro-batch, also without a lane. Their
    number is fixed when a stream starts for the first time; where lanes are many, it is the session's.
    """
    most = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark places a key by this hash.
    found = (normalise(records).select(F.hash(lane_column(lane)).alias("place")).distinct()
             .limit(most + 1).collect())
    places = np.array([row[0] for row in found], np.int64)
    if len(places) > most:
        return most
    fullest = [np.bincount(places % n, minlength=1).max() for n in range(1, most + 1)]
    return 1 + int(np.argmin(fullest))


FILL = 256  # mean number of keys of a bucket
PACKED, PACKED_TEXT = "row", "_packed"  # the column that rows travel in, and its name inside a lane


def _packs(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.IntegralType | T.FractionalType | T.TimestampType | T.StringType
                      | T.BooleanType)


def _pack(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as a JSON text each, and columns that are no texts, numbers, times or flags as they are.

    Spark hands rows to Python one by one, field by field, and pandas would make floating numbers of those
    with missing values; a text is read again for many rows at a time.
    """
    def text(field):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(column).cast("string")
        # JSON has no bytes that are no characters; two texts must not become one.
        return F.validate_utf8(column) if isinstance(field.dataType, T.StringType) else column.cast("string")

    packed = F.struct(*[text(field).alias(f"c{at}") for at, field in enumerate(schema) if _packs(field)])
    return rows.select("lane", F.to_json(packed).alias(PACKED),
                       *[field.name for field in schema if not _packs(field)])


def _unpack(rows: DataFrame, schema: T.StructType) -> DataFrame:
    names = {field.name: f"c{at}" for at, field in enumerate(schema) if _packs(field)}
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names.values()])
    read = rows.withColumn(PACKED, F.from_json(PACKED, texts, {"maxStringLen": str((1 << 31) - 1)}))

    def value(field):
        if not _packs(field):
            return F.col(field.name)
        column = F.col(PACKED)[names[field.name]]
        if isinstance(field.dataType, T.TimestampType):
            return F.timestamp_micros(column.cast("bigint")).alias(field.name)
        return column.cast(field.dataType).alias(field.name)
    return read.select(*[value(field) for field in schema], *[
        F.col(field.name).cast(field.dataType).alias(field.name) for field in VERDICT_FIELDS])


def _packed_schema(schema: T.StructType) -> T.StructType:
    """What the lanes give back: the row as it came, and the verdict with its numbers as texts."""
    return T.StructType([T.StructField(PACKED, T.StringType()), *[
        field for field in schema if not _packs(field)], *[
        T.StructField(field.name, T.StringType()) for field in VERDICT_FIELDS]])


class _Buckets:
    """States of a check's keys, many to an entry of Spark's state: a call for each key takes too long.

    A bucket is a text with a line per key: the key, a tab, its state; both are JSON, so they have no
    tab or line end. Their number grows with the keys by linear hashing: only the buckets that give
    keys to new ones are split, and a batch looks at the buckets of its own keys only.
    """

    def __init__(self, check: str, states, sizes):
        self.check, self.states, self.sizes = check, states, sizes
        self.buckets, self.keys = sizes.getValue((check,)) or (1, 0)

    def _place(self, code: int, buckets: int) -> int:
        bits = (buckets - 1).bit_length()
        place = code & ((1 << bits) - 1)
        return place if place < buckets else code & ((1 << bits - 1) - 1)

    def _by_bucket(self, names) -> dict[int, list[str]]:
        found: dict[int, list[str]] = {}
        for name in names:
            found.setdefault(self._place(zlib.crc32(name.encode()), self.buckets), []).append(name)
        return found

    def _read(self, bucket: int) -> dict[str, str]:
        held = self.states.getValue((self.check, bucket))
        return dict(line.split("\t") for line in held[0].split("\n")) if held else {}

    def _write(self, bucket: int, entries: dict[str, str]) -> None:
        if entries:
            self.states.updateValue((self.check, bucket), (
                "\n".join([f"{name}\t{state}" for name, state in entries.items()]),))
        else:
            self.states.removeKey((self.check, bucket))

    def get(self, names: list[str]) -> dict[str, tuple]:
        """States of those of the keys that have one."""
        found = {}
        for bucket, wanted in self._by_bucket(names).items() if self.keys else ():
            entries = self._read(bucket)
            found |= {name: _state(entries[name]) for name in wanted if name in entries}
        return found

    def put(self, after: dict[str, tuple | None]) -> None:
        """New states; None removes a key."""
        changed, empty = False, not self.keys
        if empty:
            self.buckets = max(1, -(-len(after) // FILL))
        for bucket, names in self._by_bucket(after).items():
            before = {} if empty else self._read(bucket)
            entries = dict(before)
            for name in names:
                if after[name] is None:
                    entries.pop(name, None)
                else:
                    a, b, text = after[name]
                    entries[name] = json.dumps({"a": a, "b": b, "text": text})
            if entries != before:
                self._write(bucket, entries)
                self.keys, changed = self.keys + len(entries) - len(before), True
        if self.buckets * FILL < self.keys:
            self._grow()
        if changed:
            self.sizes.updateValue((self.check,), (self.buckets, self.keys))

    def _grow(self) -> None:
        """Go on to as many buckets as the keys need; only those that new ones take from are read."""
        wanted = -(-self.keys // FILL)
        for source in {self._source(place) for place in range(self.buckets, wanted)}:
            entries, parts = self._read(source), {source: {}}
            for name, state in entries.items():
                parts.setdefault(self._place(zlib.crc32(name.encode()), wanted), {})[name] = state
            for place, part in parts.items():
                if place != source or len(part) != len(entries):
                    self._write(place, part)
        self.buckets = wanted

    def _source(self, place: int) -> int:
        """The bucket that holds the keys of a new one."""
        while place >= self.buckets:
            place &= (1 << place.bit_length() - 1) - 1
        return place


def _state(entry: str) -> tuple:
    found = json.loads(entry)
    return found["a"], found["b"], found["text"]


class LaneProcessor(StatefulProcessor):
    """Keeps one state per check and key of the lane, and the log and totals of its key store.

    Keys that are dead at the end of their own batch are not stored at all.
    """

    def __init__(self, checks: list[Check], rows: T.StructType):
        self.checks = checks
        self.schema = to_arrow_schema(rows)
        self.packed = {f"c{at}": field.name for at, field in enumerate(rows) if _packs(field)}

    def init(self, handle) -> None:
        self.states = handle.getMapState("states", "check string, bucket bigint", "entries string")
        self.sizes = handle.getMapState("sizes", "check string", "buckets bigint, keys bigint")
        self.totals = handle.getValueState("totals", "stores bigint, clock bigint")
        piece = "check string, run bigint, piece bigint"
        self.log = [self.states, handle.getMapState("hashes", piece, "hashes binary"),
                    handle.getMapState("places", piece, "places binary"),
                    handle.getMapState("runs", "check string", "next bigint, runs string"),
                    handle.getMapState("ends", "check string", "oldest bigint, newest bigint")]

    def _table(self, batches: Iterator) -> pa.Table:
        """The rows of a batch in order, as they came and read; pandas holds one part of them at a time."""
        texts = pa.schema([(name, pa.string()) for name in self.packed])

        def column(values, field):
            if pa.types.is_timestamp(field.type):
                return values.cast(pa.int64()).cast(field.type)
            return values.cast(field.type)

        parts = []
        for part in batches:
            rows = pa.array(part[PACKED], pa.string())
            lines = "\n".join(part[PACKED]).encode()
            read = pj.read_json(pa.BufferReader(lines), pj.ReadOptions(
                use_threads=False, block_size=max(len(lines) + 1, 1 << 10)), pj.ParseOptions(explicit_schema=texts))
            columns = {field: read.column(name) for name, field in self.packed.items()}
            parts.append(pa.Table.from_arrays([rows, *[
                column(columns[field.name], field) if field.name in columns
                else pa.Array.from_pandas(part[field.name], type=field.type) for field in self.schema]],
                schema=pa.schema([(PACKED_TEXT, pa.string()), *self.schema])))
        return pa.concat_tables(parts).sort_by("arrival_seq").combine_chunks()

    def handleInputRows(self, key, rows, timerValues):
        table = self._table(rows)
        stores, clock = self.totals.get() or (0, None)
        tables, known, seeds, store = {}, {}, [], None
        for check, lane in zip(self.checks, open_lanes(table, None, self.checks)):
            if isinstance(check, Uniqueness):
                tables[check.name] = log = KeyLog(check, *self.log)
                names = key_names(lane.keys.texts(lane.keys.in_rows), len(check.key_columns))
                known[check.name] = lane.keys.in_rows, names, Digests.of(names)
                seeds.append(self._store_seeds(check, lane, log, known[check.name][2], stores, clock))
                continue
            held = tables[check.name] = _Buckets(check.name, self.states, self.sizes)
            known[check.name] = held.get([json.dumps(parts) for parts in lane.keys.texts(
                lane.keys.in_rows).to_pylist()]) if held.keys else {}
            # Without a state a key needs no seed: its first record is sure.
            seeds.append(pa.Table.from_pylist([{
                "check": check.name, "key": json.loads(name), "seed": dict(zip(("a", "b", "text"), state))}
                for name, state in known[check.name].items()], schema=_SEEDS))
        lanes = open_lanes(table, pa.concat_tables(seeds), self.checks)
        del seeds
        passed = walk(table.num_rows, lanes)
        for check, lane in zip(self.checks, lanes):
            before = known[check.name]
            if isinstance(check, Uniqueness):
                if lane.stores:
                    first, stores, clock = stores, stores + lane.stores, lane.last_clock
                    self.totals.update((stores, clock))
                    tables[check.name].store(*self._stored(lane, passed == len(lanes), first, *before),
                                             stores, clock)
                continue
            effects, after = lane.effects(), {}
            for parts, pieces, text in zip(*[effects[c].to_pylist() for c in ("key", "pieces", "text")]):
                if pieces or text is not None:
                    name = json.dumps(parts)
                    after[name] = self._after(check, before.get(name), pieces, text)
            tables[check.name].put(after)
        judged = verdict_columns(table, passed, lanes, self.checks).select([
            PACKED_TEXT, *[field.name for field in self.schema if field.name not in self.packed.values()],
            *[field.name for field in VERDICT_FIELDS]])
        for batch in judged.to_batches(max_chunksize=OUT_ROWS):
            yield _to_pandas(batch)

    def _after(self, check: Check, state: tuple | None, pieces: list[dict] | None,
               text: str | None) -> tuple:
        """The state (value, time, text) that an effect leaves."""
        if isinstance(check, CustomCheck | CombiningCheck):
            return None, None, check.after_text(state and state[2], text)
        found = [(p["x"], p["y"], p["to"], p["time"]) for p in pieces]
        return *check.after(state and state[:2], found), None

    def _store_seeds(self, check: Uniqueness, lane: StoreLane, log: KeyLog, keys: Digests, stores: int,
                     clock: int | None) -> pa.Table:
        """Seeds of the batch's keys that are live: (age in stores, time, clock)."""
        held, number, time = log.find(keys)
        live = np.flatnonzero(held & ~log.dead(number, time, stores, clock))
        n = len(live)
        seed = pa.StructArray.from_arrays(
            [pa.array(stores - number[live]), pa.array(time[live]), pa.array([clock] * n, pa.int64()),
             pa.nulls(n, pa.string())], fields=list(STATE))
        return pa.Table.from_arrays([pa.array([check.name] * n, pa.string()),
                                     lane.keys.texts(lane.keys.in_rows[live]), seed], schema=_SEEDS)

    def _stored(self, lane: StoreLane, accepted: np.ndarray, stores: int, known: np.ndarray, names: pa.Array,
                digests: Digests) -> tuple[pa.Array, Digests, np.ndarray, np.ndarray]:
        """Per key its last store in the batch, by number: names, digests, numbers and times."""
        rows = np.flatnonzero(accepted & (lane.codes >= 0))
        last = np.full(lane.keys.size, -1)
        last[lane.codes[rows]] = np.arange(len(rows))
        codes = np.flatnonzero(last >= 0)
        codes = codes[np.argsort(last[codes])]
        # Rows come before seeds, so their keys have the same codes with and without them.
        at = np.searchsorted(known, codes)
        return (names.take(pa.array(at)), digests.take(at), last[codes] + stores + 1,
                lane.times[rows][last[codes]])


OUT_ROWS = 10_000


def _to_pandas(batch: pa.RecordBatch):
    """A part of the verdicts, their numbers as texts."""
    def column(values: pa.Array) -> pa.Array:
        return values.cast(pa.string()) if pa.types.is_integer(values.type) else values
    return pa.table([column(c) for c in batch.columns], names=[PACKED, *batch.schema.names[1:]]).to_pandas()


def verify_stream(records: DataFrame, lane: str = "partition",
                  checks: list[Check] | None = None) -> DataFrame:
    """Stream of verdicts for a stream of raw records with ``arrival_seq``.

    Needs the RocksDB state store. Lateness of a record is judged against its key's state,
    never against a global event-time watermark, so no record is dropped silently.
    """
    checks = sorted(checks or default_checks(), key=lambda c: c.priority)
    rows = normalise(records).select(*record_columns(checks))
    keyed = _pack(rows.withColumn("lane", lane_column(lane)), rows.schema)
    judged = keyed.groupBy("lane").transformWithStateInPandas(
        LaneProcessor(checks, rows.schema), _packed_schema(rows.schema), "Append", "None")
    return with_outcomes(_unpack(judged, rows.schema), checks)


def lane_state(spark: SparkSession, checkpoint: str, checks: list[Check] | None = None) -> DataFrame:
    """The lanes' states, read beside or after a stream: ``lane``, ``check``, ``key``, ``pieces``, ``text``.

    They have the form of the consumer's state. Of stored keys only the live ones are returned.
    """
    checks = checks or default_checks()

    def read(name: str) -> DataFrame:
        return (spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
                .withColumn("lane", F.col("key.lane")))

    nothing = F.lit(None).cast("bigint")
    states = (read("states")
              .select("lane", "user_map_key.check",
                      F.explode(F.split("user_map_value.entries", "\n")).alias("line"))
              .withColumn("line", F.split("line", "\t"))
              .select("lane", "check", F.from_json(F.col("line")[0], "array<string>").alias("key"),
                      F.from_json(F.col("line")[1], "a bigint, b bigint, text string").alias("value"))
              .select("lane", "check", "key", F.when(F.col("value.a").isNotNull(), F.array(F.struct(
                  nothing.alias("x"), nothing.alias("y"), F.col("value.a").alias("to"),
                  F.col("value.b").alias("time")))).alias("pieces"), F.col("value.text").alias("text")))
    store = next((c for c in checks if isinstance(c, Uniqueness)), None)
    if store is None or (store.cap is None and store.ttl_ms is None):
        return states
    totals = read("totals").select("lane", "value.stores", "value.clock")
    entry, dead = F.col("pieces")[0], F.lit(False)
    if store.cap is not None:
        dead = dead | (F.col("stores") - entry["to"] >= store.cap)
    if store.ttl_ms is not None:
        dead = dead | (F.col("clock") - entry["time"] > store.ttl_ms)
    gone = (F.col("check") == UNIQUENESS) & F.coalesce(dead, F.lit(False))
    return states.join(totals, "lane", "left").where(~gone).select(*states.columns)
