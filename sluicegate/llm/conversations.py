"""Conversation structure repair: the cheapest edits by a Viterbi search whose survivors coalesce.

Roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant by
turns, ending with the assistant. A row may be kept, given another role, deleted, or have rows without
text put before it. The search has four states (nothing yet, after system, after user, after
assistant) and keeps one survivor for each: its cost and its path through a tree of back pointers.
Nodes count the references to them. As soon as all survivors share an ancestor, the edits up to it
are final and leave the tree, so the memory follows the unresolved end of a conversation and not its
length. A survivor that costs more than another and the detour to its state can never win and is
given up, so paths do not stay open for nothing. Survivors of equal cost are compared by their complete unresolved edits; their order is kept
as a rank from row to row, which equals that comparison, since edits of two survivors differ before
either ends: each holds one edit of every row, with insertions before it.

A conversation is not one task's. Rows without their text are range-partitioned by conversation and
turn and sorted. A part of a conversation that goes on in another task is summed up as a table of
four by four costs and ranks, for each state it may start in; those tables, at most two for a task,
are combined in order and give every part its first and last state. Then all parts emit their edits.

Defined results: a missing text or role is one space; rows of a missing ``conv_id`` are one
conversation; missing turns come first; rows of one turn are ordered by role and the SHA-256 of their
text; equal rows stand next to each other; a role without characters has the initial of one space;
a conversation of any length and texts of any length are read whole; an empty table gives no
rows; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..plans.scratch import Scratch

# Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ["blank", "duplicate", "truncated"]
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_SIGN = "[^\\x20\\x09-\\x0D]"
_FINISHED = "[.!?][\\x20\\x09-\\x0D]*\\z"
KEY = ["conv_id", "turn", "role", "digest"]
_NAME, _EDIT, _TEXT = range(3)  # kinds of rows on the way to a conversation


def _next_role(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _ways(initial: str, gone: bool, cut: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of all sensible ways to treat a row."""
    ways = []
    for before in STATES:
        ways.append((before, before, DELETE, "D"))
        if gone:
            continue
        state = before
        for inserted in range(3):  # a third insertion returns to a state that was there before
            cost, edits = INSERT * inserted + TRUNCATED * cut, "I" * inserted
            right = _next_role(state)
            if initial == "ua"[right == ASSISTANT]:
                ways.append((before, right, cost, edits + "K"))
            if initial == "s" and state == START:
                ways.append((before, SYSTEM, cost, edits + "K"))
            ways.append((before, right, cost + REROLE, edits + "R"))
            state = right
    return ways


_WAYS = {(initial, gone, cut): _ways(initial, gone, cut)
         for initial in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)}
#: Rows that must be put at the end, by state.
_ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def ways_of(initial: str, fault: str | None) -> list[tuple[int, int, int, str]]:
    return _WAYS[initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"),
                 fault == "truncated"]


#: What it costs at most to go on from the first state as from the second: rows put in between, a
#: system row deleted that only the start of a conversation may keep, rows put at the end.
_DETOUR = {(START, SYSTEM): 0, (START, USER): 5, (START, ASSISTANT): 0,
           (SYSTEM, START): 10, (SYSTEM, USER): 5, (SYSTEM, ASSISTANT): 10,
           (USER, START): 7, (USER, SYSTEM): 5, (USER, ASSISTANT): 5,
           (ASSISTANT, START): 2, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 5}


def _hopeless(cost: int, state: int, best: list) -> bool:
    """Whether another survivor will end up cheaper whatever follows, so that this one cannot win."""
    return any(best[other] is not None and best[other][0] + detour < cost
               for (other, at), detour in _DETOUR.items() if at == state)


def advance(costs: list, ranks: list, ways: list) -> tuple[list, list, list]:
    """One row further: costs, ranks, and (state before, edits) of the new survivors."""
    best: list = [None] * 4
    for before, after, cost, edits in ways:
        if costs[before] is not None:
            offer = (costs[before] + cost, ranks[before], edits, before)
            if best[after] is None or offer < best[after]:
                best[after] = offer
    best = [offer and not _hopeless(offer[0], after, best) and offer or None
            for after, offer in enumerate(best)]
    return *_survive(best), [offer and (offer[3], offer[2]) for offer in best]


def _survive(best: list) -> tuple[list, list]:
    """Costs and ranks of offers (cost, rank before, edits or rank since then, state before)."""
    order = sorted(offer[1:3] for offer in best if offer)
    return ([offer and offer[0] for offer in best],
            [offer and order.index(offer[1:3]) for offer in best])


def best_end(costs: list, ranks: list) -> int:
    """The state to end a conversation in."""
    return min((costs[s] + INSERT * len(_ENDINGS[s]), ranks[s], s)
               for s in STATES if costs[s] is not None)[2]


class _Node:
    """A row's edits on the way of a survivor; ``uses`` counts the nodes and survivors that need it."""

    __slots__ = ("before", "row", "edits", "uses", "kids")

    def __init__(self, before: _Node | None, row, edits: str):
        self.before, self.row, self.edits, self.uses, self.kids = before, row, edits, 1, []
        if before is not None:
            before.uses += 1
            before.kids.append(self)


class Survivors:
    """The search over one part of a conversation."""

    def __init__(self, start: int = START):
        self.root = _Node(None, None, "")
        self.at: list = [None] * 4
        self.costs: list = [None] * 4
        self.ranks: list = [None] * 4
        self.at[start], self.costs[start], self.ranks[start] = self.root, 0, 0

    def add(self, row, initial: str, fault: str | None) -> list[tuple]:
        """Take one more row; returns (row, edits) of all rows whose edits are now final.

        The newest row is never among them, since rows may have to follow it.
        """
        self.costs, self.ranks, came = advance(self.costs, self.ranks, ways_of(initial, fault))
        older, self.at = self.at, [way and _Node(self.at[way[0]], row, way[1]) for way in came]
        for node in older:
            self._release(node)
        final = []
        while len(self.root.kids) == 1 and self.root.kids[0].kids:
            self.root = self.root.kids[0]
            self.root.before = None
            final.append((self.root.row, self.root.edits))
        return final

    def _release(self, node: _Node | None) -> None:
        while node is not None:
            node.uses -= 1
            if node.uses:
                return
            if node.before is not None:
                node.before.kids.remove(node)
            node = node.before

    def end(self, state: int | None = None) -> list[tuple]:
        """The edits not yet final of the survivor in ``state``.

        Without a state the conversation ends here, in its best state, with what must follow.
        """
        last = state is None
        state = best_end(self.costs, self.ranks) if last else state
        left, node = [], self.at[state]
        while node is not self.root:
            left.append((node.row, node.edits))
            node = node.before
        left.reverse()
        if last and left:
            left[-1] = (left[-1][0], left[-1][1] + _ENDINGS[state])
        return left

    def held(self) -> int:
        """Number of nodes in the tree."""
        seen, todo = 0, [self.root]
        while todo:
            node = todo.pop()
            seen += 1
            todo += node.kids
        return seen


def plain_turns(turns: DataFrame) -> DataFrame:
    """The four columns; a missing role or text is one space."""
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))


def with_digest(turns: DataFrame) -> DataFrame:
    return plain_turns(turns).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


@dataclass(frozen=True)
class _Shapes:
    """Arrow schemas of the steps; ids and turns keep the types of the table."""

    placed: pa.Schema
    summary: pa.Schema
    bounds: pa.Schema
    edits: pa.Schema
    report: pa.Schema
    repaired: pa.Schema

    @classmethod
    def of(cls, turns: DataFrame) -> _Shapes:
        key = list(to_arrow_schema(with_digest(turns).select(*KEY).schema))
        place = [("part", pa.int32()), ("place", pa.int64())]
        conv = key[0]
        return cls(
            pa.schema([*key, ("blank", pa.bool_()), ("cut", pa.bool_()), *place]),
            pa.schema([conv, place[0], ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]),
            pa.schema([conv, place[0], ("first_state", pa.int32()), ("last_state", pa.int32())]),
            pa.schema([*key, *place, ("fault", pa.string()), ("edits", pa.string())]),
            pa.schema([conv, *[(name, pa.int64()) for name in COUNTS], ("audit", pa.string()),
                       ("repaired_sha256", pa.string())]),
            pa.schema([conv, ("position", pa.int64()), key[2], ("text", pa.string()),
                       ("edit", pa.string())]))


def _in_order(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_first() for name in names]


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _placed_rows(turns: DataFrame, shapes: _Shapes, scratch: Scratch) -> DataFrame:
    """All rows without their text, in order by ``part`` and ``place``, with their first fault."""
    schema = shapes.placed

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()),
                 pa.array(range(place, place + n), pa.int64())], schema=schema)
            place += n

    narrow = with_digest(turns).select(*KEY, (~F.col("text").rlike(_SIGN)).alias("blank"),
                                       (~F.col("text").rlike(_FINISHED)).alias("cut"))
    placed = scratch.keep("placed", narrow.repartitionByRange(*_in_order(*KEY)).sortWithinPartitions(
        *_in_order(*KEY)).mapInArrow(number, from_arrow_schema(schema)))
    same = ["conv_id", "role", "digest"]
    repeated = placed.groupBy(*same).agg(
        F.count("*").alias("copies"), F.min(F.struct("part", "place")).alias("first")).where("copies > 1")
    found = placed.alias("p").join(repeated.alias("r"), _same("p", "r", same), "left")
    fault = (F.when(F.col("blank"), "blank")
             .when(F.struct("part", "place") > F.col("first"), "duplicate")
             .when(F.col("cut"), "truncated"))
    return scratch.keep("rows", found.select(
        *[f"p.{name}" for name in KEY], "part", "place", fault.alias("fault")))


def _sum_up(shapes: _Shapes):
    """For each part of a conversation costs and ranks by first state and last state."""
    def table(key: tuple, tables: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "conv_id": key[0], "part": key[1], "costs": [c for costs, _ in tables for c in costs],
            "ranks": [r for _, ranks in tables for r in ranks]}], schema=shapes.summary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tables = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["conv_id"], row["part"])
                if key != current:
                    if current is not None:
                        yield table(current, tables)
                    current = key
                    tables = [([0 if s == t else None for t in STATES],) * 2 for s in STATES]
                ways = ways_of(row["role"][:1], row["fault"])
                tables = [advance(costs, ranks, ways)[:2] for costs, ranks in tables]
        if current is not None:
            yield table(current, tables)

    return run


def _combine(shapes: _Shapes):
    """First and last state of each part, from the parts of a conversation in order."""
    def bounds(conv, parts: list, came: list, state: int) -> pa.RecordBatch:
        out = []
        for at in range(len(parts) - 1, -1, -1):
            # The last part chooses its own end, with the rows that must follow.
            out.append({"conv_id": conv, "part": parts[at], "first_state": came[at][state],
                        "last_state": None if at == len(parts) - 1 else state})
            state = came[at][state]
        return pa.RecordBatch.from_pylist(out, schema=shapes.bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, costs, ranks, came, parts = None, [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if not parts or row["conv_id"] != current:
                    if parts:
                        yield bounds(current, parts, came, best_end(costs, ranks))
                    current, came, parts = row["conv_id"], [], []
                    costs, ranks = [0, None, None, None], [0, None, None, None]
                offers = [[(costs[s] + row["costs"][4 * s + t], ranks[s], row["ranks"][4 * s + t], s)
                           for s in STATES
                           if costs[s] is not None and row["costs"][4 * s + t] is not None]
                          for t in STATES]
                best = [min(some) if some else None for some in offers]
                costs, ranks = _survive(best)
                came.append([offer and offer[3] for offer in best])
                parts.append(row["part"])
        if parts:
            yield bounds(current, parts, came, best_end(costs, ranks))

    return run


def _emit(shapes: _Shapes):
    """The edits of every row, emitted as soon as they are final."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, search, last_state = None, None, None

        def table(final: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"edits": edits} for row, edits in final],
                                              schema=shapes.edits)

        for batch in batches:
            final: list[tuple] = []
            for row in batch.to_pylist():
                key = (row["conv_id"], row["part"])
                if key != current:
                    final += search.end(last_state) if search else []
                    current, last_state = key, row["last_state"]
                    search = Survivors(row["first_state"] or START)
                final += search.add(row, row["role"][:1], row["fault"])
            yield table(final)
        if search:
            yield table(search.end(last_state))

    return run


def find_edits(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The cheapest edits of every row: ``conv_id``, ``turn``, ``role``, ``digest`` of its text, its
    ``fault``, and ``edits``: I for each row put before it, then K, R or D; the last row of a
    conversation may have I after it. ``part`` and ``place`` give the order of all rows.
    """
    shapes = _Shapes.of(turns)
    rows = _placed_rows(turns, shapes, scratch)
    # A border between parts cuts one conversation at most, so there are fewer of these than parts.
    cut = rows.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    summed = (rows.alias("p").join(cut.alias("c"), _same("p", "c", ["conv_id"]), "left_semi")
              .repartition("part").sortWithinPartitions("part", "place")
              .mapInArrow(_sum_up(shapes), from_arrow_schema(shapes.summary)))
    bounds = scratch.keep("bounds", summed.repartition("conv_id").sortWithinPartitions("conv_id", "part")
                          .mapInArrow(_combine(shapes), from_arrow_schema(shapes.bounds)))
    return (rows.alias("p").join(bounds.alias("b"), _same("p", "b", ["conv_id", "part"]), "left")
            .select("p.*", "first_state", "last_state")
            .repartition("part").sortWithinPartitions("part", "place")
            .mapInArrow(_emit(shapes), from_arrow_schema(shapes.edits)))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Writer:
    """The repaired rows that edits give: (edit, role, text)."""

    def __init__(self):
        self.state = START

    def write(self, role: str, text: str, edits: str) -> Iterator[tuple[str, str, str]]:
        for edit in edits:
            if edit == "D":
                continue
            starts = edit == "K" and role[:1] == "s"
            self.state = SYSTEM if starts else _next_role(self.state)
            name = "assistant" if self.state == ASSISTANT else "user"
            yield edit, role if edit == "K" else name, "" if edit == "I" else text


class _Report:
    """What is told of one conversation, row by row; only its audit grows with it."""

    def __init__(self, conv):
        self.conv, self.faults = conv, dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.distinct = 0
        self.lowest = self.highest = self.initial = None
        self.writer, self.audit = _Writer(), []
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turn, role: str, text: str, fault: str | None, edits: str) -> None:
        if turn is not None and turn != self.highest:
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest, self.distinct = turn, self.distinct + 1
        initial = role[:1] or " "
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.audit.append(edits)
        self.cost += (REROLE * edits.count("R") + DELETE * edits.count("D")
                      + INSERT * edits.count("I"))
        if fault == "truncated" and "D" not in edits:
            self.cost += TRUNCATED
        for _, name, written in self.writer.write(role, text, edits):
            self.hash.update(f"{chr(10) if self.any else ''}{name}:{written}".encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.distinct
        return {"conv_id": self.conv, "gaps": gaps, **self.faults, "illegal": self.illegal,
                "cost": self.cost, "audit": "".join(self.audit),
                "repaired_sha256": self.hash.hexdigest()}


def _paired(batch: pa.RecordBatch, waiting: deque) -> Iterator[tuple[dict, str | None, str | None]]:
    """(row, its fault, its edits); rows that only name a conversation have no edits."""
    for row in batch.to_pylist():
        if row["kind"] == _EDIT:
            waiting.append((row["fault"], row["edits"]))
        elif row["kind"] == _TEXT:
            yield row, *waiting.popleft()
        else:
            yield row, None, None


def _tell(shapes: _Shapes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, waiting = None, deque()
        for batch in batches:
            out = []
            for row, fault, edits in _paired(batch, waiting):
                if report is None or row["conv_id"] != report.conv:
                    if report is not None:
                        out.append(report.row())
                    report = _Report(row["conv_id"])
                if edits is not None:
                    report.add(row["turn"], row["role"], row["text"], fault, edits)
            yield pa.RecordBatch.from_pylist(out, schema=shapes.report)
        if report is not None:
            yield pa.RecordBatch.from_pylist([report.row()], schema=shapes.report)

    return run


def _rewrite(shapes: _Shapes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer, position, waiting = None, None, 0, deque()
        for batch in batches:
            out = []
            for row, _, edits in _paired(batch, waiting):
                if writer is None or row["conv_id"] != conv:
                    conv, writer, position = row["conv_id"], _Writer(), 0
                for edit, role, text in writer.write(row["role"], row["text"], edits or ""):
                    out.append({"conv_id": conv, "position": position, "role": role, "text": text,
                                "edit": edit})
                    position += 1
            yield pa.RecordBatch.from_pylist(out, schema=shapes.repaired)

    return run


def _edits_and_texts(turns: DataFrame, scratch: Scratch, known: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order: equal rows' edits, then their texts.

    Texts travel once. A conversation's rows pass one task, which holds only a row of them.
    """
    edits = find_edits(turns, scratch).withColumns({
        "kind": F.lit(_EDIT), "text": F.lit(None).cast("string")})
    texts = with_digest(turns).withColumn("kind", F.lit(_TEXT))
    ids = known.select("conv_id").distinct().withColumn("kind", F.lit(_NAME))
    rows = (edits.unionByName(texts, allowMissingColumns=True)
            .unionByName(ids, allowMissingColumns=True))
    return rows.repartition("conv_id").sortWithinPartitions(*_in_order(*KEY, "kind", "part", "place"))


def report_repairs(turns: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, cost, the edits in order and a hash of what they give.

    ``known`` may name conversations that have no rows left.
    """
    shapes = _Shapes.of(turns)
    return _edits_and_texts(turns, scratch, turns if known is None else known).mapInArrow(
        _tell(shapes), from_arrow_schema(shapes.report))


def repair_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position``, ``role``, ``text``, ``edit``."""
    shapes = _Shapes.of(turns)
    return _edits_and_texts(turns, scratch, turns).mapInArrow(
        _rewrite(shapes), from_arrow_schema(shapes.repaired))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of conversation and turn, one in twenty of each kind."""
    name = F.concat(*[part for column in ("conv_id", "turn") for part in (
        F.coalesce(F.col(column).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    kind = F.crc32(name.cast("binary")) % 20
    rows = plain_turns(conversations).withColumn("kind", kind).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after the damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report_repairs(damage(conversations), Scratch(spark, "conversations"), conversations)
