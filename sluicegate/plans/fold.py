"""Judge chunks of records, and carry their effects to later chunks.

Effects are functions of a key's state and compose. They are carried by a segmented scan with
levels: the chunks of a key are cut into blocks, every block is composed to one function (up),
blocks of blocks are, until a key has one block left, whose states are found one after the other (top);
each block then starts from the state found for it (down). So no task gets more than one
block of a key, however many chunks have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.outcomes import OFFSET, SENDER_WATERMARK, UNIQUENESS
from .checks import Check, CombiningCheck, CustomCheck, Uniqueness
from .lanes import PIECE, STATE, Lane, single_pieces, walk
from .limits import HIGHEST, LOWEST, Groups

BLOCK = 256  # chunks, or blocks of the level below, of a key that meet in one task
RUN_ROWS = 65_536  # neighbouring chunks of up to so many records go to Python in one call
RUNS_A_TASK = 8

VERDICT_FIELDS = [T.StructField("failed_by", T.StringType()),
                  T.StructField("n_checked", T.IntegerType()),
                  T.StructField("prev_offset", T.LongType()),
                  T.StructField("prev_watermark", T.LongType())]
_KEY = [("check", pa.string()), ("key", pa.list_(pa.string()))]
_FUNCTION = [("pieces", pa.list_(PIECE)), ("text", pa.string())]
_EFFECT_ARROW = pa.schema([("chunk", pa.int64()), *_KEY, ("used", STATE), *_FUNCTION,
                           ("stores", pa.int64()), ("clock", pa.int64())])
# A state is a constant function: ``a`` is its number or value, ``b`` its time.
_LEVEL_ARROW = pa.schema([("at", pa.int64()), *_KEY, *_FUNCTION])
_SEED_ARROW = pa.schema([("at", pa.int64()), *_KEY, ("used", STATE), ("seed", STATE), ("before", STATE),
                         ("after", STATE)])
EFFECT_SCHEMA = from_arrow_schema(_EFFECT_ARROW)


def open_lanes(rows: pa.Table, seeds: pa.Table | None, checks: list[Check]) -> list[Lane]:
    lanes = []
    for check in checks:
        own = seeds.filter(pc.equal(seeds.column("check"), check.name)) if seeds else None
        keys = own.column("key").combine_chunks() if own else pa.array([], pa.list_(pa.string()))
        states = own.column("seed").combine_chunks() if own else pa.array([], STATE)
        lanes.append(check.lane(rows, keys, states))
    return lanes


def verdict_columns(rows: pa.Table, passed: np.ndarray, lanes: list[Lane],
                    checks: list[Check]) -> pa.Table:
    last = len(checks)
    names = pa.array([check.name for check in checks] + [None], pa.string())

    def prev(name: str) -> pa.Array:
        for at, (check, lane) in enumerate(zip(checks, lanes)):
            if check.name == name and hasattr(lane, "prev"):
                # A check that was not asked has compared with nothing.
                return pc.if_else(pa.array(passed >= at), lane.prev, pa.scalar(None, pa.int64()))
        return pa.nulls(rows.num_rows, pa.int64())

    columns = {
        "failed_by": names.take(pa.array(passed)),
        "n_checked": pa.array(np.minimum(passed + 1, last), pa.int32()),
        "prev_offset": prev(OFFSET), "prev_watermark": prev(SENDER_WATERMARK),
    }
    for name, values in columns.items():
        rows = rows.append_column(name, values)
    return rows


def _verdict_table(rows: pa.Table, seeds: pa.Table | None, checks: list[Check],
                   numbered: bool = False) -> pa.Table:
    lanes = open_lanes(rows, seeds, checks)
    passed = walk(rows.num_rows, lanes)
    judged = verdict_columns(rows, passed, lanes, checks)
    if not numbered:
        return judged
    stored = np.zeros(rows.num_rows, bool)
    for check, lane in zip(checks, lanes):
        if check.name == UNIQUENESS:
            stored = (passed == len(checks)) & (lane.codes >= 0)
    return judged.append_column("store_no", pa.array(np.cumsum(stored), pa.int64(), mask=~stored))


def _effect_table(rows: pa.Table, seeds: pa.Table | None, checks: list[Check]) -> pa.Table:
    if not rows.num_rows:
        return _EFFECT_ARROW.empty_table()
    lanes = open_lanes(rows, seeds, checks)
    walk(rows.num_rows, lanes)
    chunk, tables = rows.column("chunk")[0].as_py(), []
    for check, lane in zip(checks, lanes):
        columns = lane.effects()
        n = len(columns["key"])
        columns |= {"chunk": pa.array(np.full(n, chunk)), "check": pa.array([check.name] * n, pa.string()),
                    "stores": pa.nulls(n, pa.int64()), "clock": pa.nulls(n, pa.int64())}
        tables.append(pa.Table.from_arrays([columns[name] for name in _EFFECT_ARROW.names],
                                           schema=_EFFECT_ARROW))
        if check.name == UNIQUENESS:
            tables.append(pa.Table.from_pylist([{
                "chunk": chunk, "stores": lane.stores, "clock": lane.last_clock}], schema=_EFFECT_ARROW))
    return pa.concat_tables(tables)


def chunks_in_run(chunks: int, chunk_rows: int, parallel: int) -> int:
    """How many neighbouring chunks make a run, so that calls are large and tasks still have several."""
    return max(1, min(RUN_ROWS // chunk_rows, chunks // (RUNS_A_TASK * parallel)))


def run_column(together: int) -> Column:
    """Number of the run of a chunk."""
    return F.expr(f"chunk div {together}L")


def each_chunk(rows: pa.Table, seeds: pa.Table | None, judge, onward: Onward | None = None) -> pa.Table:
    """The chunks of a run, each judged on its own from its own seeds.

    With ``onward`` they start from what the chunks before them in the run left, where that is known.
    """
    if not rows.num_rows:
        return judge(rows, None)
    rows = rows.sort_by("arrival_seq")
    chunk = rows.column("chunk").to_numpy()
    if chunk[0] == chunk[-1]:
        return judge(rows, seeds)
    borders = _borders(chunk)
    if not seeds:
        parts = [None] * len(borders)
    else:
        seeds = seeds.sort_by("chunk").combine_chunks()
        of, own = seeds.column("chunk").to_numpy(), chunk[[a for a, _ in borders]]
        first, after = (np.searchsorted(of, own, side).tolist() for side in ("left", "right"))
        parts = [_cut(seeds, a, b) for a, b in zip(first, after)]
    rows, judged = rows.combine_chunks(), []
    for (a, b), part in zip(borders, parts):
        if onward:
            part = onward.seeds(part, int(chunk[a]), b - a)
        judged.append(judge(_cut(rows, a, b), part))
        if onward:
            onward.note(judged[-1])
    return pa.concat_tables(judged).combine_chunks()


class Onward:
    """States that the chunks of a run leave to the next, as far as the run alone tells them.

    They are a better guess than nothing to start with; the passes after find out which were right.
    """

    def __init__(self, checks: list[Check]):
        self.rules = {check.name: check for check in checks}
        self.states: dict[tuple, tuple | str] = {}  # the last touched at the end
        self.base, self.clock = 0, None

    def seeds(self, given: pa.Table | None, chunk: int, n_rows: int) -> pa.Table:
        """The given seeds and, of the states found so far, no more than the chunk has rows."""
        names, keys, states = [], [], []
        known = set()
        for row in given.to_pylist() if given else ():
            at = (row["check"], tuple(row["key"]))
            known.add(at)
            names.append(at[0])
            keys.append(row["key"])
            states.append(self._seed(at) if at in self.states else row["seed"])
        # Ids that no other chunk has are not watched, so they are among the given ones or not asked for.
        recent = [at for at in self.states if at[0] != UNIQUENESS][-n_rows:]
        for at in recent:
            if at not in known:
                names.append(at[0])
                keys.append(list(at[1]))
                states.append(self._seed(at))
        return pa.table({"chunk": pa.array([chunk] * len(names), pa.int64()), "check": pa.array(names, pa.string()),
                         "key": pa.array(keys, pa.list_(pa.string())), "seed": pa.array(states, STATE)})

    def _seed(self, at: tuple) -> dict | None:
        check, state = self.rules[at[0]], self.states[at]
        if isinstance(check, Uniqueness):
            seed = check.seed(state, self.base, self.clock)
            return seed and dict(zip("abc", seed))
        return {"text": state} if isinstance(check, CustomCheck | CombiningCheck) else {"a": state[0]}

    def note(self, effects: pa.Table) -> None:
        stores, clock = 0, None
        for row in effects.to_pylist():
            if row["check"] is None:
                stores, clock = row["stores"] or 0, row["clock"]
                continue
            check, at = self.rules[row["check"]], (row["check"], tuple(row["key"]))
            used = row["used"]
            if isinstance(check, Uniqueness):
                known = used is not None and used["a"] is not None
                before = (self.base - used["a"], used["b"]) if known else None
                pieces = check.placed([(p["x"], p["y"], p["to"], p["time"]) for p in row["pieces"] or ()],
                                      self.base, self.clock)
                state = check.after(before, pieces)
            elif isinstance(check, CustomCheck | CombiningCheck):
                state = check.after_text(used and used["text"], row["text"])
            else:
                before = (used["a"], None) if used is not None and used["a"] is not None else None
                state = check.after(before, _pieces(row, check))
            self.states.pop(at, None)
            if state is not None:
                self.states[at] = state
        self.base, self.clock = self.base + stores, self.clock if clock is None else clock


def _borders(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return list(zip(start.tolist(), np.append(start[1:], len(values)).tolist()))


def _cut(table: pa.Table, start: int, end: int) -> pa.Table:
    """A copy of some rows; Arrow's casts of slices are not safe."""
    return table.take(pa.array(np.arange(start, end)))


def _grouped(rows: DataFrame, seeds: DataFrame | None, schema: T.StructType, judge,
             together: int, onward: Callable[[], Onward | None] = lambda: None) -> DataFrame:
    if seeds is None:
        return rows.groupBy("_run").applyInArrow(lambda t: each_chunk(t, None, judge, onward()), schema)
    starts = seeds.select("chunk", "check", "key", "seed", run_column(together).alias("_run"))
    return (rows.groupBy("_run").cogroup(starts.groupBy("_run"))
            .applyInArrow(lambda t, s: each_chunk(t, s, judge, onward()), schema))


def fold_verdicts(rows: DataFrame, seeds: DataFrame | None, checks: list[Check], together: int = 1,
                  numbered: bool = False) -> DataFrame:
    """Rows plus ``failed_by``, number of checks run, and the states compared with.

    ``together`` chunks make a run, whose number the rows have as ``_run``.
    ``numbered`` adds ``store_no``: which store of its chunk a record is, if it is one.
    """
    more = [T.StructField("store_no", T.LongType())] if numbered else []
    schema = T.StructType(rows.schema.fields + VERDICT_FIELDS + more)
    return _grouped(rows, seeds, schema, lambda t, s: _verdict_table(t, s, checks, numbered), together)


def fold_effects(rows: DataFrame, seeds: DataFrame | None, checks: list[Check],
                 together: int = 1, onward: bool = False) -> DataFrame:
    """What each chunk does to the states of the keys in it, and how many keys it stores.

    With ``onward``, for the first pass, a chunk starts from what those before it in its run leave.
    """
    return _grouped(rows, seeds, EFFECT_SCHEMA, lambda t, s: _effect_table(t, s, checks), together,
                    lambda: Onward(checks) if onward else None)


# ---------------------------------------------------------------- the scan over chunks

def _same_key(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether each row but the first has the values of the row before it; keys are lists."""
    same = np.ones(max(0, batch.num_rows - 1), bool)
    for name in names:
        column = batch.column(name)
        if pa.types.is_list(column.type):
            sizes = pc.list_value_length(column).to_numpy()
            codes = column.flatten().dictionary_encode().indices.to_numpy()
            starts = np.cumsum(sizes) - sizes
            equal = sizes[1:] == sizes[:-1]
            for at in range(int(sizes.max())):
                has = equal & (sizes[1:] > at)
                left, right = starts[:-1][has] + at, starts[1:][has] + at
                equal[has] &= codes[left] == codes[right]
            same &= equal
        else:
            values = column.to_numpy(zero_copy_only=False)
            same &= values[1:] == values[:-1]
    return same


class _Scan:
    """States or composed functions of sorted runs of rows with the same key and block."""

    def __init__(self, checks: list[Check]):
        self.rules = {check.name: check for check in checks}
        self.key: tuple | None = None  # of the run that goes on in the next batch
        self.function = None           # composed so far: (limit, last), pieces or text

    def runs(self, batch: pa.RecordBatch) -> Iterator[tuple[Check, int, int, np.ndarray, bool]]:
        """(check, start, end, starts of runs in it, whether the first run goes on)."""
        checks = batch.column("check").to_pylist()
        new = np.concatenate([[True], ~_same_key(batch, ["check", "key", "block"])])
        first = (checks[0], tuple(batch.column("key")[0].as_py()), batch.column("block")[0].as_py())
        goes_on = first == self.key
        borders = [0, *[i for i in range(1, len(checks)) if checks[i] != checks[i - 1]], len(checks)]
        for start, end in zip(borders, borders[1:]):
            yield self.rules[checks[start]], start, end, new[start:end], goes_on and start == 0
        self.key = (checks[-1], tuple(batch.column("key")[-1].as_py()), batch.column("block")[-1].as_py())


def _limits(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(limit, last, whether there is a function) of lists of at most one piece."""
    has = pc.fill_null(pc.greater(pc.list_value_length(pieces), 0), False).to_numpy(zero_copy_only=False)
    flat = pieces.flatten()
    limit, last = np.full(len(has), LOWEST), np.full(len(has), LOWEST)
    limit[has] = pc.struct_field(flat, "x").fill_null(HIGHEST).to_numpy()
    last[has] = pc.struct_field(flat, "to").to_numpy()
    return limit, last, has


class _LimitScan:
    """All prefixes of runs of limit functions at once; the open run is put before the rows."""

    def __init__(self, scan: _Scan, pieces: pa.Array, new: np.ndarray, goes_on: bool):
        limit, last, has = _limits(pieces)
        own = scan.function if goes_on else None
        self.skip = 0
        if own is not None:
            self.skip = 1
            limit, last = np.append(own[0], limit), np.append(own[1], last)
            has, new = np.append(own[2], has), np.concatenate([[True, False], new[1:]])
        self.groups = Groups(np.cumsum(new))
        self.limit, self.last = self.groups.composed(limit, last)
        seen = np.cumsum(has)
        before = np.concatenate([[0], seen])[self.groups.start]
        self.known = seen > before
        scan.function = (self.limit[-1], self.last[-1], bool(self.known[-1]))

    def states(self) -> tuple[pa.Array, pa.Array]:
        """State before and after each row."""
        last, known = self.last, self.known
        before, had = self.groups.shifted(last, 0), self.groups.shifted(known, False)
        return _value_states(before[self.skip:], had[self.skip:]), _value_states(
            last[self.skip:], known[self.skip:])


def _value_states(values: np.ndarray, known: np.ndarray) -> pa.Array:
    none = pa.nulls(len(values), pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(values, pa.int64()), none, none, pa.nulls(len(values), pa.string())],
        fields=list(STATE), mask=pa.array(~known))


def _up(checks: list[Check]):
    """One composed function per run, as a row of the next level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held = _Scan(checks), []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for check, start, end, new, goes_on in scan.runs(batch):
                if held and not goes_on:
                    out += held
                held = []
                part = batch.slice(start, end - start)
                last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
                if isinstance(check, Uniqueness | CustomCheck | CombiningCheck):
                    functions = _composed_rows(scan, check, part, new, goes_on)
                    pieces = pa.array([_as_dicts(functions[i][0]) for i in last], pa.list_(PIECE))
                    text = pa.array([functions[i][1] for i in last], pa.string())
                else:
                    found = _LimitScan(scan, part.column("pieces"), new, goes_on)
                    at = last + found.skip
                    pieces = single_pieces(found.limit[at], found.last[at], found.known[at])
                    text = pa.nulls(len(at), pa.string())
                rows = pa.RecordBatch.from_arrays(
                    [part.column("block").take(pa.array(last)), part.column("check").take(pa.array(last)),
                     part.column("key").take(pa.array(last)), pieces, text], schema=_LEVEL_ARROW)
                out.append(rows.slice(0, rows.num_rows - 1))
                held = [rows.slice(rows.num_rows - 1)]
            yield from out
        yield from held

    return run


def _as_dicts(pieces: list[tuple] | None) -> list[dict] | None:
    return [dict(zip(("x", "y", "to", "time"), piece)) for piece in pieces] if pieces else None


def _pieces(row: dict, check: Check) -> list[tuple]:
    pieces = [(p["x"], p["y"], p["to"], p["time"]) for p in row["pieces"] or ()]
    if "base" in row and isinstance(check, Uniqueness):
        return check.placed(pieces, row["base"] or 0, row["clock_in"])
    return pieces


def _composed_rows(scan: _Scan, check: Check, part: pa.RecordBatch, new: np.ndarray,
                   goes_on: bool) -> list[tuple[list[tuple], str | None]]:
    pieces, text = scan.function if goes_on else ([], None)
    out = []
    for at, row in enumerate(part.to_pylist()):
        if new[at] and not (at == 0 and goes_on):
            pieces, text = [], None
        if isinstance(check, Uniqueness):
            pieces = check.composed(pieces, _pieces(row, check))
        else:
            text = check.after_text(text, row["text"])
        out.append((pieces, text))
    scan.function = (pieces, text)
    return out


def _down(checks: list[Check]):
    """State before and after every row; start rows (``at`` is null) bring a run's first state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(checks)
        for batch in batches:
            if not batch.num_rows:
                continue
            for check, start, end, new, goes_on in scan.runs(batch):
                part = batch.slice(start, end - start)
                if isinstance(check, Uniqueness):
                    before, after, seed = _store_states(scan, check, part, new, goes_on)
                elif isinstance(check, CustomCheck | CombiningCheck):
                    before, after = _text_states(scan, check, part, new, goes_on)
                    seed = before
                else:
                    before, after = _LimitScan(scan, part.column("pieces"), new, goes_on).states()
                    seed = before
                rows = pa.RecordBatch.from_arrays(
                    [part.column("at"), part.column("check"), part.column("key"), part.column("used"),
                     seed, before, after], schema=_SEED_ARROW)
                yield rows.filter(rows.column("at").is_valid())

    return run


def _store_states(scan: _Scan, check: Uniqueness, part: pa.RecordBatch, new: np.ndarray, goes_on: bool):
    state = scan.function if goes_on else None
    before, after, seeds = [], [], []
    for at, row in enumerate(part.to_pylist()):
        if new[at] and not (at == 0 and goes_on):
            state = None
        seed = check.seed(state, row["base"] or 0, row["clock_in"]) if "base" in row else state
        seeds.append(seed and dict(zip("abc", seed)))
        before.append(state and dict(zip("ab", state)))
        state = check.after(state, _pieces(row, check))
        after.append(state and dict(zip("ab", state)))
    scan.function = state
    return tuple(pa.array(found, STATE) for found in (before, after, seeds))


def _text_states(scan: _Scan, check: CustomCheck | CombiningCheck, part: pa.RecordBatch, new: np.ndarray,
                 goes_on: bool):
    state = scan.function if goes_on else None
    before, after = [], []
    for at, text in enumerate(part.column("text").to_pylist()):
        if new[at] and not (at == 0 and goes_on):
            state = None
        before.append(state and {"text": state})
        state = check.after_text(state, text)
        after.append(state and {"text": state})
    scan.function = state
    return pa.array(before, STATE), pa.array(after, STATE)


def as_function(state: str) -> dict:
    """``pieces`` and ``text`` of the constant function of a state column."""
    piece = F.struct(F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"),
                     F.col(f"{state}.a").alias("to"), F.col(f"{state}.b").alias("time"))
    return {"pieces": F.when(F.col(f"{state}.a").isNotNull(), F.array(piece)),
            "text": F.col(f"{state}.text")}


def _scanned(level: DataFrame, checks: list[Check], places: int, block: int) -> DataFrame:
    """States before and after every row of a level; ``at`` is below ``places``."""
    blocked = level.withColumn("block", F.expr(f"at div {block}L"))
    order = ["check", "key", "block", "at"]
    if places > block:
        upper = (blocked.repartition("check", "key", "block").sortWithinPartitions(*order)
                 .mapInArrow(_up(checks), from_arrow_schema(_LEVEL_ARROW)))
        starts = _scanned(upper.withColumn("used", F.lit(None).cast(from_arrow_schema(
            pa.schema([("used", STATE)]))["used"].dataType)), checks, -(-places // block), block)
        starts = starts.where(F.col("before").isNotNull()).select(
            "check", "key", F.col("at").alias("block"),
            *[column.alias(name) for name, column in as_function("before").items()])
        blocked = blocked.unionByName(starts, allowMissingColumns=True)
    return (blocked.repartition("check", "key", "block")
            .sortWithinPartitions(*order[:3], F.asc_nulls_first("at"))
            .mapInArrow(_down(checks), from_arrow_schema(_SEED_ARROW)))


def store_totals(effects: DataFrame, block: int) -> DataFrame:
    """Per chunk the number of earlier stores and the time of the last one.

    Blocks of chunks are added up first, so a task sees a block of chunks or one row per block.
    """
    totals = effects.where(F.col("check").isNull()).select(
        "chunk", "stores", "clock", F.expr(f"(chunk + 1) div {block}L").alias("block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("stores").alias("stores"), F.max("clock").alias("clock"))
    blocks = blocks.select("block", F.sum("stores").over(earlier).alias("more"),
                           F.max("clock").over(earlier).alias("until"))
    inside = Window.partitionBy("block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    found = totals.withColumns({"own": F.sum("stores").over(inside), "last": F.max("clock").over(inside)})
    return found.join(blocks, "block").select(
        "chunk", (F.coalesce("own", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("base"),
        F.greatest("last", "until").alias("clock_in"))


def carry_effects(effects: DataFrame, checks: list[Check], chunks: int,
                  block: int | None = None) -> DataFrame:
    """The seed of every (chunk, check, key), from the effects of all earlier chunks."""
    block = block or BLOCK
    keyed = effects.where(F.col("check").isNotNull()).drop("stores", "clock")
    if any(check.name == UNIQUENESS for check in checks):
        keyed = keyed.join(store_totals(effects, block), "chunk", "left")
    # The state of an earlier run is chunk -1, so places count from there.
    level = keyed.withColumn("at", F.col("chunk") + 1).drop("chunk")
    return _scanned(level, checks, chunks + 1, block).withColumn("chunk", F.col("at") - 1).drop("at", "before")
