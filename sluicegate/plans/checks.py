"""The record checks as the chain sees them: state, admission, and how state crosses chunks.

A check has keyed state. Inside a chunk a *lane* judges the rows. What a chunk does to a key's
state is its *effect*: a list of pieces ``(x, y, to, time)``, sorted. A state takes the first piece
whose condition it meets, or stays as it is. Effects are functions, so they compose: the
pieces of a run of chunks are again such a list. Checks of the user's keep one text instead.

- Limit checks have one piece: a state up to ``x`` becomes ``to``; without ``x`` every state does.
- The key store has pieces for points in time: a key that is forgotten after ``x`` stores at
  the clock ``y`` is stored again as store ``to`` at ``time``; without both it is, always.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.outcomes import (FAILED_DUPLICATE, FAILED_LATE_ARRIVAL, OFFSET,
                                  SENDER_WATERMARK, UNIQUENESS)
from .lanes import (CombiningLane, CustomLane, Keys, LimitLane, StoreLane, integers, read_text,
                    write_text)

# Default settings.
STORE_SIZE = 10_000
STORE_TTL_MS = 300_000
BLOOM_FPP = 0.01
LATE_THRESHOLD_MS = 0
UNIQUENESS_PRIORITY = 0
OFFSET_PRIORITY = 1
WATERMARK_PRIORITY = 2

@dataclass(frozen=True)
class Uniqueness:
    """(sender, message id) must not be live in a store of ``cap`` keys and ``ttl_ms`` age.

    A key is live while fewer than ``cap`` keys were stored after it and the last store is
    at most ``ttl_ms`` later. Age counts at stores only, never at look-ups.
    """

    cap: int | None = STORE_SIZE
    ttl_ms: int | None = STORE_TTL_MS
    priority: int = UNIQUENESS_PRIORITY
    name: str = UNIQUENESS
    verdict: str = FAILED_DUPLICATE

    key_columns = ("sender_key", "message_id")
    columns = ("sender_key", "message_id", "ingest_ms")

    def lane(self, rows: pa.Table, keys: pa.Array, seeds: pa.Array) -> StoreLane:
        return StoreLane(self, rows, Keys(rows, self.key_columns, keys), seeds)

    def is_dead(self, number: int, time: int, stores: int, clock: int | None) -> bool:
        """Whether store ``number`` made at ``time`` is forgotten after ``stores`` stores."""
        return (self.cap is not None and stores - number >= self.cap) or (
            self.ttl_ms is not None and clock is not None and clock - time > self.ttl_ms)

    def seed(self, state: tuple | None, base: int, clock: int | None) -> tuple | None:
        """(age in stores, time, clock) of a state that is live when a chunk starts."""
        if state is None or self.is_dead(*state, base, clock):
            return None
        number, time = state
        return base - number, time, clock

    def placed(self, pieces: list[tuple] | None, base: int, clock: int | None) -> list[tuple]:
        """The pieces of a chunk with store numbers that count from the first chunk."""
        return [(None, None, base + to, time) if x is None else
                (base + x, clock if y is None else y, base + to, time) for x, y, to, time in pieces or ()]

    def after(self, state: tuple | None, pieces: list[tuple]) -> tuple | None:
        """Keys are forgotten in the order of their age, so the first piece that holds is meant."""
        for x, y, to, time in pieces:
            if state is None or x is None or self.is_dead(*state, x, y):
                return to, time
        return state

    def composed(self, first: list[tuple], then: list[tuple]) -> list[tuple]:
        """``first``, then ``then``: what the first stores may be forgotten and stored again."""
        ends = [(x, y, *self.after((to, time), then)) for x, y, to, time in first]
        if first and first[-1][0] is None:
            return self._shortest(ends)
        return self._shortest(ends + then)

    def _shortest(self, pieces: list[tuple]) -> list[tuple]:
        """Of neighbours with equal ends the later holds whenever the earlier does."""
        return [piece for at, piece in enumerate(pieces)
                if at + 1 == len(pieces) or piece[2:] != pieces[at + 1][2:]]


class _Limited:
    """States of limit checks: (value, None)."""

    def after(self, state: tuple | None, pieces: list[tuple]) -> tuple | None:
        for x, _, to, _ in pieces:
            if state is None or x is None or state[0] <= x:
                return to, None
        return state


@dataclass(frozen=True)
class OffsetOrder(_Limited):
    """Offsets of a topic partition must rise strictly."""

    priority: int = OFFSET_PRIORITY
    name: str = OFFSET
    verdict: str = FAILED_LATE_ARRIVAL

    key_columns = ("topic", "partition")
    columns = ("topic", "partition", "offset")

    def lane(self, rows: pa.Table, keys: pa.Array, seeds: pa.Array) -> LimitLane:
        return LimitLane(Keys(rows, self.key_columns, keys), integers(rows, "offset"), -1, seeds)


@dataclass(frozen=True)
class SenderWatermark(_Limited):
    """A sender's time may be behind its last accepted one by at most the threshold."""

    threshold_ms: int = LATE_THRESHOLD_MS
    priority: int = WATERMARK_PRIORITY
    name: str = SENDER_WATERMARK
    verdict: str = FAILED_LATE_ARRIVAL

    key_columns = ("sender_raw", "topic", "partition")
    columns = ("sender_raw", "topic", "partition", "sender_ts")

    def lane(self, rows: pa.Table, keys: pa.Array, seeds: pa.Array) -> LimitLane:
        # A record without a time is not judged, so its key is taken away.
        timed = pc.if_else(pc.is_valid(rows.column("sender_ts")), rows.column("sender_raw"), None)
        keyed = rows.select(["topic", "partition"]).append_column("sender_raw", timed)
        return LimitLane(Keys(keyed, self.key_columns, keys),
                         integers(rows, "sender_ts"), max(0, self.threshold_ms), seeds)


@dataclass(frozen=True)
class CustomCheck:
    """A check of your own.

    ``verify(row, state)`` returns True to let the record pass; ``store(row, state)`` returns
    the new state after the whole chain accepted it. ``row`` has the ``columns``, ``state`` is
    None at first and must be a JSON value. Rows with a NULL key column pass and store nothing.
    Key columns are compared as texts, so they must be texts, whole numbers, dates or booleans.
    A chunk's effect is the state it ends in, whatever it started from, so a state that depends on
    the one before takes a pass for each chunk; ``CombiningCheck`` does not.
    """

    name: str
    priority: int
    key_columns: tuple[str, ...]
    verify: Callable[[dict, Any], bool]
    store: Callable[[dict, Any], Any]
    columns: tuple[str, ...] = ()
    verdict: str = FAILED_LATE_ARRIVAL

    def __post_init__(self):
        _with_keys(self)

    def lane(self, rows: pa.Table, keys: pa.Array, seeds: pa.Array) -> CustomLane:
        return CustomLane(self, rows, Keys(rows, self.key_columns, keys), seeds)

    def after_text(self, state: str | None, effect: str | None) -> str | None:
        return state if effect is None else effect


@dataclass(frozen=True)
class CombiningCheck:
    """A check whose state adds up: counters, sums, extremes, sets.

    ``lift(row)`` is what an accepted record adds and ``combine(a, b)`` adds up two such values,
    earlier ones first; it must be associative. ``verify(row, total)`` judges by the total so far,
    None at first. Values must be JSON values. A chunk's effect is what its accepted records
    add, so any number of chunks settles in a few passes. Rows with a NULL key column pass and add
    nothing.
    """

    name: str
    priority: int
    key_columns: tuple[str, ...]
    verify: Callable[[dict, Any], bool]
    lift: Callable[[dict], Any]
    combine: Callable[[Any, Any], Any]
    columns: tuple[str, ...] = ()
    verdict: str = FAILED_LATE_ARRIVAL

    def __post_init__(self):
        _with_keys(self)

    def lane(self, rows: pa.Table, keys: pa.Array, seeds: pa.Array) -> CombiningLane:
        return CombiningLane(self, rows, Keys(rows, self.key_columns, keys), seeds)

    def added(self, total: Any, value: Any) -> Any:
        return value if total is None else total if value is None else self.combine(total, value)

    def store(self, row: dict, total: Any) -> Any:
        return self.added(total, self.lift(row))

    def after_text(self, state: str | None, effect: str | None) -> str | None:
        if state is None or effect is None:
            return effect if state is None else state
        return write_text(self.combine(read_text(state), read_text(effect)))


def _with_keys(check: CustomCheck | CombiningCheck) -> None:
    object.__setattr__(check, "columns", tuple(dict.fromkeys([*check.columns, *check.key_columns])))


Check = Uniqueness | OffsetOrder | SenderWatermark | CustomCheck | CombiningCheck


def default_checks(threshold_ms: int = LATE_THRESHOLD_MS, cap: int | None = STORE_SIZE,
                   ttl_ms: int | None = STORE_TTL_MS) -> list[Check]:
    return [Uniqueness(cap, ttl_ms), OffsetOrder(), SenderWatermark(threshold_ms)]
