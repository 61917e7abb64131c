"""One check inside a chunk, for whole arrays where the outcome is sure.

A row is *sure* if it passes a check whatever becomes of the rows before it: its value is not below
any earlier one, or its id is new. Rows that are sure for every check are accepted at once. Only the
others, the suspects, are asked one after the other; the state they meet is that of the last
accepted row of their key, which is the last sure one or a suspect accepted since.
"""

from __future__ import annotations

import bisect
import json
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .limits import HIGHEST, Groups, reach, states_before

STATE = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("text", pa.string())])
PIECE = pa.struct([("x", pa.int64()), ("y", pa.int64()), ("to", pa.int64()), ("time", pa.int64())])


def integers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().fill_null(0).to_numpy().astype(np.int64)


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 0, 1, 2, ... in the order in which values first appear, and how many there are."""
    encoded = pa.array(codes).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)


class Keys:
    """Small integers for the composite keys of a chunk; -1 where a part is missing.

    Keys travel as lists of texts, so the keys of the seeds are compared as such.
    """

    def __init__(self, rows: pa.Table, columns: tuple[str, ...], seeds: pa.Array):
        n, more = rows.num_rows, len(seeds)
        given = np.asarray(seeds.flatten().to_numpy(zero_copy_only=False), dtype=object).reshape(
            more, len(columns)) if more else np.empty((0, len(columns)), object)
        missing = np.zeros(n + more, bool)
        codes, distinct = np.zeros(n + more, np.int64), 1
        self.parts = []
        for at, name in enumerate(columns):
            part = pa.concat_arrays([rows.column(name).cast(pa.string()).combine_chunks(),
                                     pa.array(given[:, at].tolist(), pa.string())])
            encoded = part.dictionary_encode()
            missing |= encoded.is_null().to_numpy(zero_copy_only=False)
            # Missing values get a code of their own, so no valid key shares one with them.
            n_values = len(encoded.dictionary)
            index = encoded.indices.fill_null(n_values).to_numpy().astype(np.int64)
            if distinct * (n_values + 1) > 1 << 62:
                codes, distinct = _numbered(codes)
            codes, distinct = codes * (n_values + 1) + index, distinct * (n_values + 1)
            self.parts.append(part)
        codes, self.size = _numbered(codes)
        self._first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(
            codes) else codes
        codes = codes.copy()
        codes[missing] = -1
        self.rows, self.seeds = codes[:n], codes[n:]
        self.in_rows = np.unique(self.rows[self.rows >= 0])

    def texts(self, codes: np.ndarray) -> pa.Array:
        """The keys of some codes as lists of texts."""
        places = pa.array(self._first[codes])
        width = len(self.parts)
        flat = pa.concat_arrays([part.take(places) for part in self.parts])
        woven = np.arange(width * len(codes)).reshape(width, -1).T.reshape(-1)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(codes) + 1) * width, pa.int32()), flat.take(pa.array(woven)))


def _null_pieces(n: int) -> pa.Array:
    return pa.nulls(n, pa.list_(PIECE))


def read_text(text: str | None) -> Any:
    return None if text is None else json.loads(text)


def write_text(state: Any) -> str | None:
    return None if state is None else json.dumps(state)


class Lane:
    """``rows`` are all rows of a chunk in order; ``seeds`` the states its keys start with."""

    def __init__(self, keys: Keys, seeds: pa.Array):
        self.keys, self.codes = keys, keys.rows
        self.seeds = seeds
        self.sure = np.ones(len(self.codes), bool)

    def meet(self, suspects: np.ndarray, accepted: np.ndarray) -> None:
        """Called before the suspects are asked, with the rows accepted at once."""

    def admits(self, at: int) -> bool:
        """Whether suspect number ``at`` passes."""
        raise NotImplementedError

    def would_admit(self, at: int) -> bool:
        return self.admits(at)

    def commit(self, at: int) -> None:
        """Suspect number ``at`` was accepted by all checks."""

    def turned_away(self, at: int, later: list[Lane]) -> None:
        """Suspect number ``at`` failed here; ``later`` were not asked."""

    def settle(self, accepted: np.ndarray, failed_here: np.ndarray) -> None:
        """Called when the outcome of all rows is known."""

    def _used(self, codes: np.ndarray) -> pa.Array:
        place = np.full(self.keys.size, -1)
        place[self.keys.seeds] = np.arange(len(self.keys.seeds))
        return self.seeds.take(pa.array(place[codes], pa.int64(), mask=place[codes] < 0))

    def effects(self) -> dict[str, pa.Array]:
        """``key``, ``used`` seed, ``pieces`` and ``text`` of every key the chunk touches."""
        raise NotImplementedError


class LimitLane(Lane):
    """Admit a value while the state is at most ``value + slack``."""

    def __init__(self, keys: Keys, values: np.ndarray, slack: int, seeds: pa.Array):
        super().__init__(keys, seeds)
        self.values, self.slack = values, slack
        self.keyed = np.flatnonzero(self.codes >= 0)
        self.groups = Groups(self.codes[self.keyed])
        self.seed = np.zeros(keys.size, np.int64)
        self.seeded = np.zeros(keys.size, bool)
        state = pc.struct_field(seeds, "a") if len(seeds) else pa.array([], pa.int64())
        self.seeded[keys.seeds] = state.is_valid().to_numpy(zero_copy_only=False)
        self.seed[keys.seeds] = state.fill_null(0).to_numpy()
        held = self.values[self.keyed][self.groups.order]
        before = self.groups.shifted(self.groups.highest(held), 0)
        code = self.groups.codes
        before = np.where(self.groups.new, self.seed[code], np.where(
            self.seeded[code], np.maximum(before, self.seed[code]), before))
        known = ~self.groups.new | self.seeded[code]
        self.sure[self.keyed] = self.groups.back(~known | (before <= reach(held, slack)))

    def settled_alone(self) -> np.ndarray:
        """Whether each row is admitted, if no other check rejects rows."""
        held = self.values[self.keyed][self.groups.order]
        code = self.groups.codes
        state, known = states_before(self.groups, held, self.slack, self.seed[code], self.seeded[code])
        passed = np.ones(len(self.codes), bool)
        passed[self.keyed] = self.groups.back(~known | (state <= reach(held, self.slack)))
        return passed

    def _latest(self, accepted: np.ndarray) -> np.ndarray:
        """The last accepted row of its key before each row, or -1."""
        found = np.full(len(self.codes), -1)
        rows = self.keyed[self.groups.order]
        at = self.groups.latest(accepted[rows])
        found[rows] = np.where(at >= 0, rows[at], -1)
        return found

    def meet(self, suspects: np.ndarray, accepted: np.ndarray) -> None:
        self._code = self.codes[suspects].tolist()
        self._value = self.values[suspects].tolist()
        self._sure = self._latest(accepted)[suspects].tolist()
        self._row = suspects.tolist()
        self._since: dict[int, tuple[int, int]] = {}

    def admits(self, at: int) -> bool:
        code = self._code[at]
        if code < 0:
            return True
        row, value = self._since.get(code, (-1, 0))
        if self._sure[at] > row:
            value = int(self.values[self._sure[at]])
        elif row < 0:
            if not self.seeded[code]:
                return True
            value = int(self.seed[code])
        return value <= self._value[at] + self.slack

    def commit(self, at: int) -> None:
        if self._code[at] >= 0:
            self._since[self._code[at]] = (self._row[at], self._value[at])

    def settle(self, accepted: np.ndarray, failed_here: np.ndarray) -> None:
        self._counted = accepted | failed_here
        latest = self._latest(accepted)
        code = np.maximum(self.codes, 0)
        state = np.where(latest >= 0, self.values[latest], self.seed[code] if self.keys.size else 0)
        known = (latest >= 0) | (self.seeded[code] if self.keys.size else False)
        self.prev = pa.array(state, pa.int64(), mask=(self.codes < 0) | ~known)

    def effects(self) -> dict[str, pa.Array]:
        """Rows that another check rejected do not count, whatever their value."""
        rows = self.keyed[self._counted[self.keyed]]
        groups = Groups(self.codes[rows])
        values = self.values[rows][groups.order]
        limit, last = groups.composed(reach(values, self.slack), values)
        limits, lasts = np.zeros(self.keys.size, np.int64), np.zeros(self.keys.size, np.int64)
        has = np.zeros(self.keys.size, bool)
        found = groups.codes[groups.last]
        limits[found], lasts[found], has[found] = limit[groups.last], last[groups.last], True
        codes = self.keys.in_rows
        return {"key": self.keys.texts(codes), "used": self._used(codes),
                "pieces": single_pieces(limits[codes], lasts[codes], has[codes]),
                "text": pa.nulls(len(codes), pa.string())}


def single_pieces(limit: np.ndarray, last: np.ndarray, has: np.ndarray) -> pa.Array:
    """Lists of one piece (limit, last); the highest limit holds for every state."""
    limit, last = limit[has], last[has]
    none = pa.nulls(len(limit), pa.int64())
    pieces = pa.StructArray.from_arrays(
        [pa.array(limit, pa.int64(), mask=limit == HIGHEST), none, pa.array(last, pa.int64()), none],
        fields=list(PIECE))
    ends = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pieces, mask=pa.array(~has))
    return lists.cast(pa.list_(PIECE))


class StoreLane(Lane):
    """Bounded key store; stores are numbered, seeds have numbers up to zero.

    Keys that other chunks have too come with a seed, if only an empty one, and are watched: for each
    of their records that only this check may reject, the stores so far and their clock are noted.
    From that follows where a chain of stores that starts at such a record ends, so the effect
    tells the end for every seed and not just for the one the chunk started with.
    """

    def __init__(self, check, rows: pa.Table, keys: Keys, seeds: pa.Array):
        super().__init__(keys, seeds)
        self.check, self.times = check, integers(rows, "ingest_ms")
        self.start_ms = int(self.times[0]) if len(self.times) else 0
        self.clock = None
        self._seed: dict[int, tuple[int, int] | None] = {}
        for code, state in zip(keys.seeds.tolist(), seeds.to_pylist()):
            self._seed[code] = None
            if state is not None and state["a"] is not None:
                self._seed[code] = (-state["a"], state["b"])
                self.clock = state["c"]
        keyed = np.flatnonzero(self.codes >= 0)
        groups = Groups(self.codes[keyed])
        watched = np.zeros(keys.size, bool)
        watched[keys.seeds] = True
        self.sure[keyed] = groups.back(groups.new & ~watched[groups.codes])
        self.first_row = np.full(keys.size, -1)
        self.first_row[groups.codes[groups.first]] = keyed[groups.order][groups.first]

    def meet(self, suspects: np.ndarray, accepted: np.ndarray) -> None:
        stored = accepted & (self.codes >= 0)
        self._stored = np.cumsum(stored)
        last = np.maximum.accumulate(np.where(stored, np.arange(len(stored)), -1))
        self._row = suspects.tolist()
        self._code = self.codes[suspects].tolist()
        self._time = self.times[suspects].tolist()
        self._before = self._stored[suspects].tolist()  # suspects are not among them
        self._last = last[suspects].tolist() if len(suspects) else []
        self._sure_row = np.where(self.codes >= 0, np.where(
            stored[self.first_row[self.codes]], self.first_row[self.codes], -1), -1)[suspects].tolist()
        self._state: dict[int, tuple[int, int]] = {}
        self._accepted_rows: list[int] = []
        self._accepted_times: list[int] = []
        self.copies: dict[int, list] = {code: [] for code in self._seed}

    def _now(self, at: int) -> tuple[int, int | None]:
        """Stores so far and the time of the last."""
        stores = self._before[at] + len(self._accepted_rows)
        if self._accepted_rows and self._accepted_rows[-1] > self._last[at]:
            return stores, self._accepted_times[-1]
        return stores, int(self.times[self._last[at]]) if self._last[at] >= 0 else self.clock

    def admits(self, at: int) -> bool:
        code = self._code[at]
        if code < 0:
            return True
        state = self._state.get(code)
        if state is None:
            row = self._sure_row[at]
            if 0 <= row < self._row[at]:
                earlier = bisect.bisect_left(self._accepted_rows, row)
                state = (int(self._stored[row]) + earlier, int(self.times[row]))
            else:
                state = self._seed.get(code)
        return state is None or self.check.is_dead(*state, *self._now(at))

    def turned_away(self, at: int, later: list[Lane]) -> None:
        if self._code[at] in self.copies and all(lane.would_admit(at) for lane in later):
            self.copies[self._code[at]].append((*self._now(at), self._time[at]))

    def commit(self, at: int) -> None:
        code = self._code[at]
        if code < 0:
            return
        stores, clock = self._now(at)
        if code in self.copies:
            self.copies[code].append((stores, clock, self._time[at]))
        self._state[code] = (stores + 1, self._time[at])
        self._accepted_rows.append(self._row[at])
        self._accepted_times.append(self._time[at])

    def settle(self, accepted: np.ndarray, failed_here: np.ndarray) -> None:
        stored = np.flatnonzero(accepted & (self.codes >= 0))
        self.stores = len(stored)
        self.last_clock = int(self.times[stored[-1]]) if len(stored) else None

    def effects(self) -> dict[str, pa.Array]:
        codes = self.keys.seeds
        ends = [self._ends(self.copies[code]) or None for code in codes.tolist()]
        return {"key": self.keys.texts(codes), "used": self.seeds, "text": pa.nulls(len(codes), pa.string()),
                "pieces": pa.array([some and [dict(zip(("x", "y", "to", "time"), end)) for end in some]
                                    for some in ends], pa.list_(PIECE))}

    def _ends(self, copies: list[tuple]) -> list[list]:
        """[stores, clock, number, time]: a seed first found dead there ends as that store."""
        ends: list = [None] * len(copies)
        after = len(copies)
        for at in range(len(copies) - 1, -1, -1):
            stores, _, time = copies[at]
            while after - 1 > at and self.check.is_dead(stores + 1, time, *copies[after - 1][:2]):
                after -= 1
            ends[at] = ends[after] if after < len(copies) else (stores + 1, time)
        kept = []
        for at, (stores, clock, _) in enumerate(copies):
            # Seeds die in the order of their age, so of equal ends the last entry is enough.
            if at + 1 == len(copies) or ends[at] != ends[at + 1]:
                kept.append([stores, clock, *ends[at]])
            if clock is not None and self.check.is_dead(0, self.start_ms, stores, clock):
                if not kept or kept[-1][:2] != [stores, clock]:
                    kept.append([stores, clock, *ends[at]])
                break
        return kept


class CustomLane(Lane):
    """A check of the user's: every row with a key is asked in turn."""

    def __init__(self, check, rows: pa.Table, keys: Keys, seeds: pa.Array):
        super().__init__(keys, seeds)
        self.check, self.rows = check, rows.select(check.columns)
        self.sure = self.codes < 0
        texts = pc.struct_field(seeds, "text").to_pylist() if len(seeds) else []
        self.state = {code: read_text(text) for code, text in zip(keys.seeds.tolist(), texts)}
        self.effect: dict[int, Any] = {}

    def meet(self, suspects: np.ndarray, accepted: np.ndarray) -> None:
        self._code = self.codes[suspects].tolist()
        self._rows = self.rows.take(pa.array(suspects)).to_pylist()

    def admits(self, at: int) -> bool:
        code = self._code[at]
        return code < 0 or self.check.verify(self._rows[at], self.state.get(code))

    def commit(self, at: int) -> None:
        code = self._code[at]
        if code >= 0:
            self.state[code] = self.check.store(self._rows[at], self.state.get(code))
            self._note(at, code)

    def _note(self, at: int, code: int) -> None:
        """Keep the state as what the chunk leaves."""
        self.effect[code] = self.state[code]

    def effects(self) -> dict[str, pa.Array]:
        codes = self.keys.in_rows
        return {"key": self.keys.texts(codes), "used": self._used(codes), "pieces": _null_pieces(len(codes)),
                "text": pa.array([write_text(self.effect.get(code)) for code in codes.tolist()],
                                 pa.string())}


class CombiningLane(CustomLane):
    """The same with a state that adds up; the chunk leaves what its accepted rows add."""

    def _note(self, at: int, code: int) -> None:
        self.effect[code] = self.check.store(self._rows[at], self.effect.get(code))


def walk(n: int, lanes: list[Lane]) -> np.ndarray:
    """Per row the number of checks passed; rows that pass all move every state."""
    if len(lanes) == 1 and isinstance(lanes[0], LimitLane):
        passed = lanes[0].settled_alone().astype(np.int64)
    else:
        passed = np.full(n, len(lanes))
        sure = np.ones(n, bool)
        for lane in lanes:
            sure &= lane.sure
        suspects = np.flatnonzero(~sure)
        # A suspect is asked only where it is not sure, and moves only states that are asked for.
        asked, busy = [], []
        for number, lane in enumerate(lanes):
            lane.meet(suspects, sure)
            unsure = ~lane.sure[suspects]
            if unsure.any():
                asked.append((number, lane, lane.admits, unsure.tolist()))
                busy.append(lane.commit)
        outcome = []
        for at in range(len(suspects)):
            for number, lane, admits, unsure in asked:
                if unsure[at] and not admits(at):
                    lane.turned_away(at, lanes[number + 1:])
                    outcome.append(number)
                    break
            else:
                for commit in busy:
                    commit(at)
                outcome.append(len(lanes))
        passed[suspects] = outcome
    accepted = passed == len(lanes)
    for at, lane in enumerate(lanes):
        lane.settle(accepted, passed == at)
    return passed
