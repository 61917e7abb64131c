"""The key store of a lane in Spark's state: a log of stores, and an index that is looked up as a whole.

A call to the state takes too long to make one for each key, and entries of many keys that are written
again for each new key make a batch cost as much as all that the store holds. So what a batch stores is
appended: to the log, in blocks of consecutive stores, and to the index, as a run of digests. Runs are
merged when eight have gathered behind one that is not larger than the rest, so a key is written again a
logarithmic number of times. Looking up a batch reads 16 bytes a stored key, in arrays.

A key is known by its digest of 128 bits (BLAKE2b). Keys are forgotten in the order of their stores, so
forgetting drops whole blocks and runs at the old end; what is dead inside of them is told by its number.
"""

from __future__ import annotations

import json
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_STORES = 1_024  # most stores of a block of the log
PIECE_KEYS = 32_768  # mean number of keys of a piece of a run, at most
RUNS = 8  # runs that are merged at a time, at least
_NEEDS_ESCAPE = r'["\\\x00-\x1f\x7f]'


def key_names(keys: pa.ListArray, width: int) -> pa.Array:
    """Lists of texts as JSON."""
    flat, n = keys.flatten(), len(keys)
    parts = []
    for at in range(width):
        part = flat.take(pa.array(np.arange(n) * width + at))
        odd = pc.match_substring_regex(part, _NEEDS_ESCAPE).to_numpy(zero_copy_only=False).astype(bool)
        if odd.any():
            escaped = [json.dumps(text)[1:-1] for text in part.filter(pa.array(odd)).to_pylist()]
            part = pc.replace_with_mask(part, pa.array(odd), pa.array(escaped, pa.string()))
        parts.append(pc.binary_join_element_wise('"', part, '"', ""))
    inside = pc.binary_join_element_wise(*parts, ", ")
    return pc.binary_join_element_wise("[", inside, "]", "")


class Digests:
    """Digests of keys, in two halves."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low

    @classmethod
    def of(cls, names: pa.Array) -> Digests:
        found = [blake2b(name, digest_size=16).digest() for name in names.cast(pa.binary()).to_pylist()]
        halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        return cls(halves[:, 0].copy(), halves[:, 1].copy())

    def take(self, places: np.ndarray) -> Digests:
        return Digests(self.high[places], self.low[places])


class _Run:
    """Consecutive stores: number in the state, bits of its pieces, keys, and its last store and time."""

    def __init__(self, no: int, bits: int, keys: int, number: int, time: int):
        self.no, self.bits, self.keys, self.number, self.time = no, bits, keys, number, time

    def as_list(self) -> list[int]:
        return [self.no, self.bits, self.keys, self.number, self.time]


class KeyLog:
    """``blocks``, ``hashes``, ``places``, ``runs`` and ``ends`` are map states."""

    def __init__(self, check, blocks, hashes, places, runs, ends):
        self.check, self.blocks, self.hashes, self.places = check, blocks, hashes, places
        self._directory, self._ends = runs, ends
        self.limited = (check.cap, check.ttl_ms) != (None, None)
        self.block_stores = max(1, min(BLOCK_STORES, BLOCK_STORES if check.cap is None else check.cap // 4))
        held = runs.getValue((check.name,))
        self.next, self.runs = (held[0], [_Run(*run) for run in json.loads(held[1])]) if held else (0, [])

    # The index

    def find(self, keys: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are held, and the number and time of their last stores.

        Without limits only the first is asked for, and the others are zero.
        """
        n = len(keys.high)
        order = np.argsort(keys.high, kind="stable")
        high, low = keys.high[order], keys.low[order]
        held, number, time = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for run in self.runs:  # later runs overwrite what earlier ones say
            for piece, a, b in _cuts(high, run.bits):
                if a == b:
                    continue
                there = self._hashes(run, piece)
                at = _places(there, high[a:b], low[a:b])
                found = np.flatnonzero(at >= 0)
                held[a + found] = True
                if self.limited and len(found):
                    numbers, times = self._numbers(run, piece)
                    number[a + found], time[a + found] = numbers[at[found]], times[at[found]]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return held[back], number[back], time[back]

    def _hashes(self, run: _Run, piece: int) -> np.ndarray:
        held = self.hashes.getValue((self.check.name, run.no, piece))
        return np.frombuffer(held[0] if held else b"", "<u8").reshape(2, -1)

    def _numbers(self, run: _Run, piece: int) -> np.ndarray:
        held = self.places.getValue((self.check.name, run.no, piece))
        return np.frombuffer(held[0] if held else b"", "<i8").reshape(2, -1)

    def _write(self, run: _Run, piece: int, rows: np.ndarray, places: np.ndarray) -> None:
        if rows.shape[1]:
            self.hashes.updateValue((self.check.name, run.no, piece), (rows.astype("<u8").tobytes(),))
            self.places.updateValue((self.check.name, run.no, piece), (places.astype("<i8").tobytes(),))

    def _drop(self, run: _Run) -> None:
        for piece in range(1 << run.bits):
            self.hashes.removeKey((self.check.name, run.no, piece))
            self.places.removeKey((self.check.name, run.no, piece))

    def _add_run(self, keys: Digests, numbers: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(keys.high, kind="stable")
        rows, places = np.stack([keys.high[order], keys.low[order]]), np.stack([numbers[order], times[order]])
        run = _Run(self.next, _bits(len(order)), len(order), int(numbers[-1]), int(times[-1]))
        for piece, a, b in _cuts(rows[0], run.bits):
            self._write(run, piece, rows[:, a:b], places[:, a:b])
        self.runs.append(run)
        self.next += 1

    def _merge(self, stores: int, clock: int | None) -> None:
        """Merge the last runs from the first that is not larger than those after it together."""
        for at in range(len(self.runs) - RUNS + 1):
            if self.runs[at].keys <= sum(run.keys for run in self.runs[at + 1:]):
                break
        else:
            return
        old = self.runs[at:]
        run = _Run(self.next, _bits(sum(r.keys for r in old)), 0, old[-1].number, old[-1].time)
        held: dict[int, tuple] = {}
        for piece in range(1 << run.bits):
            parts = [self._overlap(source, run.bits, piece, held) for source in reversed(old)]
            rows = np.concatenate([part[0] for part in parts], axis=1)
            places = np.concatenate([part[1] for part in parts], axis=1)
            order = np.argsort(rows[0], kind="stable")
            rows, places = rows[:, order], places[:, order]
            # Of the stores of a key the last comes first; only it can be live.
            kept = np.ones(len(order), bool)
            kept[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            if self.limited:
                kept &= ~self.dead(*places, stores, clock)
            self._write(run, piece, rows[:, kept], places[:, kept])
            run.keys += int(kept.sum())
        for source in old:
            self._drop(source)
        self.runs[at:] = [run] if run.keys else []
        self.next += 1

    def _overlap(self, run: _Run, bits: int, piece: int, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """What a run has in the range of a piece of ``bits`` bits."""
        if run.bits > bits:
            own = range(piece << run.bits - bits, piece + 1 << run.bits - bits)
            found = [(self._hashes(run, each), self._numbers(run, each)) for each in own]
            return tuple(np.concatenate(part, axis=1) for part in zip(*found))
        own = piece >> bits - run.bits
        if held.get(run.no, (None,))[0] != own:
            held[run.no] = own, self._hashes(run, own), self._numbers(run, own)
        _, rows, places = held[run.no]
        a, b = np.searchsorted(rows[0] >> np.uint64(64 - bits), [piece, piece + 1]) if bits else (0, rows.shape[1])
        return rows[:, a:b], places[:, a:b]

    def dead(self, number: np.ndarray, time: np.ndarray, stores: int, clock: int | None) -> np.ndarray:
        dead = np.zeros(len(number), bool)
        if self.check.cap is not None:
            dead |= stores - number >= self.check.cap
        if self.check.ttl_ms is not None and clock is not None:
            dead |= clock - time > self.check.ttl_ms
        return dead

    # The log

    def store(self, names: pa.Array, keys: Digests, numbers: np.ndarray, times: np.ndarray, stores: int,
              clock: int | None) -> None:
        """Take a batch's last stores of its keys, in their order; the store then has ``stores`` and ``clock``."""
        live = np.flatnonzero(~self.dead(numbers, times, stores, clock))
        if self.limited:
            self._forget(stores, clock)
        if len(live):
            self._append(names.take(pa.array(live)), numbers[live], times[live])
            self._add_run(keys.take(live), numbers[live], times[live])
            self._merge(stores, clock)
        self._directory.updateValue((self.check.name,), (
            self.next, json.dumps([run.as_list() for run in self.runs])))

    def _append(self, names: pa.Array, numbers: np.ndarray, times: np.ndarray) -> None:
        lines = pc.binary_join_element_wise(
            names, '\t{"a": ', pa.array(numbers).cast(pa.string()), ', "b": ', pa.array(times).cast(pa.string()),
            "}", "").to_pylist()
        block = numbers // self.block_stores
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            where = (self.check.name, int(block[a]))
            # Only the first block of a batch may have been begun by the one before.
            held = self.blocks.getValue(where) if a == 0 else None
            self.blocks.updateValue(where, ("\n".join(lines[a:b] if held is None else [held[0], *lines[a:b]]),))
        before = self._ends.getValue((self.check.name,))
        self._ends.updateValue((self.check.name,), (before[0] if before else int(block[0]), int(block[-1])))

    def _forget(self, stores: int, clock: int | None) -> None:
        """Drop blocks and runs that are dead as a whole, from the old end on.

        If stores are left out between two blocks, as they were dead, those before them are dead, too.
        """
        while self.runs and self.check.is_dead(self.runs[0].number, self.runs[0].time, stores, clock):
            self._drop(self.runs.pop(0))
        block, last = self._ends.getValue((self.check.name,)) or (0, -1)
        while block <= last:
            held = self.blocks.getValue((self.check.name, block))
            if held:
                entry = json.loads(held[0].rpartition("\t")[2])
                if not self.check.is_dead(entry["a"], entry["b"], stores, clock):
                    break
                self.blocks.removeKey((self.check.name, block))
            block += 1
        if block <= last:
            self._ends.updateValue((self.check.name,), (block, last))
        else:
            self._ends.removeKey((self.check.name,))


def _bits(keys: int) -> int:
    return max(0, (-(-keys // PIECE_KEYS) - 1).bit_length())


def _cuts(high: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The pieces that sorted digests fall into by their first bits: number, start and end."""
    starts = np.searchsorted(high, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0]
    ends = [*starts[1:], len(high)]
    return list(zip(range(1 << bits), starts, ends))


def _places(there: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of digests among sorted ones, or -1."""
    size = there.shape[1]
    at = np.searchsorted(there[0], high)
    found = np.full(len(high), -1)
    open_ = np.arange(len(high))
    while len(open_):
        open_ = open_[at[open_] < size]
        open_ = open_[there[0][at[open_]] == high[open_]]
        same = there[1][at[open_]] == low[open_]
        found[open_[same]] = at[open_[same]]
        # Another key with the same first half: look at the next.
        open_ = open_[~same]
        at[open_] += 1
    return found
