"""The bounded key store over a log of operations: store, remove, clear and look up, in order.

A store puts a key with its time, drops keys that are older than the age limit, then the oldest
beyond the size limit. Removals make room, so a key's fate depends on what was stored *and* removed
after it; keys that were dropped do not come back. The log is replayed in parallel:

- An *entry* lasts from a store to the next store or removal of its key, or to a clear.
- After a store, the ``cap``-th newest entry that lasts is its *mark*. An entry is out as soon as a mark
  is above it. Entries that are out may be counted among those that last, since they are older than
  the mark that put them out, and only the highest mark so far matters.
- Marks are found chunk by chunk. A chunk needs the ``cap`` newest entries that last at its start. When
  some of them end inside the chunk, an older one may become the ``cap``-th newest, but that one is
  below a mark already. What lasts is carried over the chunks by a scan with levels, ``cap`` entries
  a chunk at most, so neither a clear nor entries that last for long make a chunk look back far.
- An entry is too old when the last store is later than its time by more than the age limit.

Running values over the log are taken by chunk (see ``running_before``), so a key with a third of all
operations is no task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.arrival import CHUNK_ROWS, split_into_chunks
from ..plans.checks import STORE_SIZE, STORE_TTL_MS
from ..plans.running import running_before
from ..plans.scratch import materialise
from .keystore import KEY

STORE, REMOVE, CLEAR, EXISTS = "store", "remove", "clear", "exists"
_NEVER = 1 << 62
BLOCK = 64  # chunks, or blocks of the level below, that are swept in one task


@dataclass(frozen=True)
class Replay:
    """``answers`` of the look-ups and the ``store`` after the whole log."""

    answers: DataFrame
    store: DataFrame


class _Lasting:
    """Entries in the order of their start, linked, with the place of the ``cap``-th newest."""

    def __init__(self, cap: int, starts: list[int], room: int):
        size = len(starts) + room
        self.cap, self.used = cap, 0
        self.starts, self.before, self.after = [0] * size, [-1] * size, [-1] * size
        self.place: dict[int, int] = {}
        self.clear()
        for start in starts:
            self.add(start)

    def clear(self) -> None:
        self.newest, self.n, self.mark = -1, 0, -1
        self.place.clear()

    def add(self, start: int) -> None:
        at, self.used = self.used, self.used + 1
        self.starts[at], self.before[at], self.place[start] = start, self.newest, at
        if self.newest >= 0:
            self.after[self.newest] = at
        self.newest = at
        self.n += 1
        if self.n == self.cap:
            self.mark = self._oldest(at)
        elif self.n > self.cap:
            self.mark = self.after[self.mark]

    def _oldest(self, at: int) -> int:
        for _ in range(self.cap - 1):
            at = self.before[at]
        return at

    def end(self, start: int) -> None:
        """An entry ends; one that is not here is older than any that can matter."""
        at = self.place.pop(start, None)
        if at is None:
            return
        if self.n <= self.cap:
            self.mark = -1
        elif at >= self.mark:
            self.mark = self.before[self.mark]
        older, newer = self.before[at], self.after[at]
        if older >= 0:
            self.after[older] = newer
        if newer >= 0:
            self.before[newer] = older
        else:
            self.newest = older
        self.n -= 1

    def mark_start(self) -> int | None:
        return self.starts[self.mark] if self.mark >= 0 else None


def _mark_chunk(rows: pa.Table, lasting: pa.Table, cap: int) -> pa.Table:
    """The rows of a chunk with the mark after each store."""
    rows = rows.sort_by("arrival_seq")
    entries = _Lasting(cap, np.sort(lasting.column("start").to_numpy()).tolist(), rows.num_rows)
    marks: list[int | None] = []
    for kind, seq, held in zip(*[rows.column(c).to_pylist() for c in ("kind", "arrival_seq", "held_seq")]):
        if kind == CLEAR:
            entries.clear()
        elif kind != EXISTS and held is not None:
            entries.end(held)
        if kind == STORE:
            entries.add(seq)
        marks.append(entries.mark_start() if kind == STORE else None)
    return rows.append_column("mark", pa.array(marks, pa.int64()))


def _lives(placed: DataFrame) -> DataFrame:
    """``start``, ``chunk`` and ``last_chunk`` of every entry; without an end the last is far away."""
    back = placed.select("arrival_seq", "chunk", "kind").withColumns(
        {"arrival_seq": -F.col("arrival_seq"), "chunk": -F.col("chunk")})
    cleared = running_before(back, [], F.when(F.col("kind") == CLEAR, F.struct(
        F.col("arrival_seq").alias("seq"), F.col("chunk").alias("chunk"))), "clear")
    starts = cleared.where(F.col("kind") == STORE).select(
        (-F.col("arrival_seq")).alias("start"), (-F.col("chunk")).alias("chunk"),
        (-F.col("clear.chunk")).alias("clear_chunk"))
    ends = placed.where(F.col("kind").isin(STORE, REMOVE) & F.col("held_seq").isNotNull()).select(
        F.col("held_seq").alias("start"), F.col("chunk").alias("end_chunk"))
    return starts.join(ends, "start", "left").select(
        "start", "chunk",
        F.coalesce(F.least("end_chunk", "clear_chunk"), F.lit(_NEVER)).alias("last_chunk"))


def _newest(entries: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` newest entries of every place; older ones of a place are out at its end."""
    newer = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("start")))
    return entries.withColumn("_newer", newer).where(F.col("_newer") <= cap).drop("_newer")


def _sweep(cap: int, width: int):
    """The newest entries that last at the start of every place of a block; carried ones come first."""
    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        at, start, last, until = (rows.column(c).to_numpy() for c in ("at", "start", "last", "until"))
        order = np.lexsort((start, at))
        at, start, last = at[order], start[order], last[order]
        held, ends, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        places = np.arange(block * BLOCK, min((block + 1) * BLOCK, int(until[0])))
        borders = np.searchsorted(at, places, "left")  # the carried ones are filed before the block
        done = 0
        for place, border in zip(places.tolist(), borders.tolist()):
            held = np.concatenate([held, start[done:border]])
            ends, done = np.concatenate([ends, last[done:border]]), border
            lasting = np.flatnonzero(ends // width >= place)[-cap:]
            held, ends = held[lasting], ends[lasting]
            found.append((np.full(len(held), place), held, ends))
        return pa.table(dict(zip(("at", "start", "last"), (
            np.concatenate([part[i] for part in found]) for i in range(3)))))

    return run


def _carried(entries: DataFrame, places: int, cap: int, width: int = 1) -> DataFrame:
    """For every place the ``cap`` newest entries of earlier places that last at its start.

    ``at`` is a place of ``width`` chunks and ``last`` a chunk. Places are swept by blocks, and a block
    starts with what the same step on blocks finds for it, so a task gets a block of ``cap`` entries
    a place at most, however many chunks there are and however long entries last.
    """
    entries = materialise(_newest(entries.where(F.expr(f"last div {width}L > at")), cap), "lasting")
    blocked = entries.withColumn("block", F.expr(f"at div {BLOCK}L"))
    if places > BLOCK:
        blocks = -(-places // BLOCK)
        upper = _carried(blocked.select(F.col("block").alias("at"), "start", "last"), blocks, cap,
                         width * BLOCK)
        blocked = blocked.unionByName(upper.select(
            (F.col("at") * BLOCK - 1).alias("at"), "start", "last", F.col("at").alias("block")))
    return blocked.withColumn("until", F.lit(places).cast("bigint")).groupBy("block").applyInArrow(
        _sweep(cap, width), "at bigint, start bigint, last bigint")


def _lasting_at_start(lives: DataFrame, chunks: int, cap: int) -> DataFrame:
    """For every chunk the entries that last at its start and can still be a mark."""
    entries = lives.select(F.col("chunk").alias("at"), "start", F.col("last_chunk").alias("last"))
    return _carried(entries, chunks, cap).select(F.col("at").alias("chunk"), "start")


def replay(log: DataFrame, cap: int | None = STORE_SIZE, ttl_ms: int | None = STORE_TTL_MS,
           chunk_rows: int = CHUNK_ROWS) -> Replay:
    """Replay a log with the columns ``op_seq`` (unique), ``kind``, ``sender_key``, ``message_id`` and
    ``op_ms``, which does not fall with ``op_seq``. Only ``clear`` has no key.
    """
    rows = split_into_chunks(log.select(F.col("op_seq").alias("arrival_seq"), "kind", *KEY, "op_ms"),
                             chunk_rows)
    kind = F.col("kind")
    changes = F.when(kind.isin(STORE, REMOVE), F.struct(
        F.col("arrival_seq").alias("seq"), "kind", F.col("op_ms").alias("ms")))
    placed = running_before(rows.df, KEY, changes, "last")
    placed = running_before(placed, [], F.when(kind == CLEAR, F.col("arrival_seq")), "cleared")
    placed = running_before(placed, [], F.when(kind == STORE, F.col("op_ms")), "clock")
    there = (F.col("last.kind") == STORE) & (F.col("cleared").isNull()
                                             | (F.col("last.seq") > F.col("cleared")))
    placed = materialise(placed.select(
        "arrival_seq", "chunk", "kind", *KEY, "op_ms", "clock",
        F.when(there, F.col("last.seq")).alias("held_seq"),
        F.when(there, F.col("last.ms")).alias("held_ms")), "operations")
    lives = materialise(_lives(placed), "entries")
    if cap is None:
        marked = placed.withColumn("mark", F.lit(None).cast("bigint"))
    else:
        schema = T.StructType([*placed.schema.fields, T.StructField("mark", T.LongType())])
        lasting = _lasting_at_start(lives, rows.chunks, cap)
        marked = materialise(placed.groupBy("chunk").cogroup(lasting.groupBy("chunk")).applyInArrow(
            lambda ops, held: _mark_chunk(ops, held, cap), schema), "marked")
    marked = running_before(marked, [], F.col("mark"), "above")

    def stays(seq: str, ms: str, above, clock):
        inside = F.coalesce(F.col(seq) >= above, F.lit(True))
        return inside if ttl_ms is None else inside & (clock - F.col(ms) <= ttl_ms)

    found = F.col("held_seq").isNotNull() & stays("held_seq", "held_ms", F.col("above"), F.col("clock"))
    answers = marked.where(kind == EXISTS).select(
        F.col("arrival_seq").alias("op_seq"), *KEY, F.coalesce(found, F.lit(False)).alias("is_stored"))
    entries = marked.where(kind == STORE).select(
        F.col("arrival_seq").alias("stored_seq"), *KEY, F.col("op_ms").alias("stored_ms"))
    open_ = lives.where(F.col("last_chunk") == _NEVER).select(F.col("start").alias("stored_seq"))
    ends = marked.agg(F.max("mark").alias("above"),
                      F.max(F.when(kind == STORE, F.col("op_ms"))).alias("clock"))
    store = entries.join(open_, "stored_seq").where(stays(
        "stored_seq", "stored_ms", ends.select("above").scalar(), ends.select("clock").scalar()))
    return Replay(answers, store.select(*KEY, "stored_ms", "stored_seq"))
