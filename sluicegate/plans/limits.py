"""Running states of limit checks for whole arrays, and their composition.

A limit check admits a value while its state is at most ``value + slack``; then the value is the state.
A row, or any run of rows, so is a function of the state with two numbers: a state up to *limit* becomes
*last*, a higher one stays, and no state at all becomes *last*. Such functions compose to
another one, so states of many rows follow from a parallel scan instead of a walk.
"""

from __future__ import annotations

import numpy as np

HIGHEST = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


def reach(values: np.ndarray, slack: int) -> np.ndarray:
    """``values + slack`` without running over."""
    if slack > 0:
        return np.where(values > HIGHEST - slack, HIGHEST, values + np.int64(slack))
    return np.where(values < LOWEST - slack, LOWEST, values + np.int64(slack))


class Groups:
    """Places of rows sorted by group; within a group they keep their order."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.new = np.ones(len(codes), bool)
        self.new[1:] = self.codes[1:] != self.codes[:-1]
        self.first = np.flatnonzero(self.new)
        self.last = np.append(self.first[1:], len(codes)) - 1 if len(codes) else self.first
        self.start = np.maximum.accumulate(np.where(self.new, np.arange(len(codes)), 0))

    def back(self, values: np.ndarray) -> np.ndarray:
        """Sorted values in the order of the rows."""
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def shifted(self, values: np.ndarray, nothing) -> np.ndarray:
        """For each sorted row the value of the row before it in its group."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.new] = nothing
        return out

    def highest(self, values: np.ndarray) -> np.ndarray:
        """Highest value of the group up to and including each sorted row."""
        if not len(values):
            return values
        distinct, rank = np.unique(values, return_inverse=True)
        group = np.cumsum(self.new) - 1
        return distinct[np.maximum.accumulate(group * len(distinct) + rank) % len(distinct)]

    def latest(self, marked: np.ndarray) -> np.ndarray:
        """Place among the sorted rows of the last marked row before each, or -1."""
        at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else (
            np.zeros(0, np.int64))
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        return np.where(before >= self.start, before, -1)

    def composed(self, limit: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The function of all rows of the group up to and including each sorted row."""
        place, step = np.arange(len(limit)), 1
        depth = place - self.start
        longest = int(depth.max()) if len(depth) else 0
        while step <= longest:
            at = np.flatnonzero(depth >= step)
            limit_a, last_a, limit_b, last_b = limit[at - step], last[at - step], limit[at], last[at]
            goes_on = last_a <= limit_b
            limit, last = limit.copy(), last.copy()
            limit[at] = np.where(goes_on, np.maximum(limit_a, limit_b), limit_a)
            last[at] = np.where(goes_on, last_b, last_a)
            step *= 2
        return limit, last


def states_before(groups: Groups, values: np.ndarray, slack: int, seeds: np.ndarray,
                  seeded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, whether there is one) before each sorted row, if only this check rejects rows.

    ``seeds`` and ``seeded`` give the state of each row's group at the start.
    """
    limit, last = groups.composed(reach(values, slack), values)
    later = ~groups.new
    limit, last = groups.shifted(limit, LOWEST), groups.shifted(last, LOWEST)
    moved = later & (~seeded | (seeds <= limit))
    return np.where(moved, last, seeds), moved | seeded
