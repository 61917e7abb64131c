"""Packing of token sequences: non-negative least squares over length combinations.

Every document is tokenised once. Its whole windows are sequences of their own; what is left
over, 0 to ``window - 1`` ids, is packed with others:

1. The leftovers are counted by length class (a class is ``step`` lengths, counted as its
   longest). The histogram has at most ``window / step`` rows.
2. All combinations of up to three classes that fill a window are enumerated, and
   non-negative least squares finds how often to use each so that the histogram is met.
3. The counts are rounded down to what the histogram holds. Documents take the places of the
   combinations by their rank in their class.
4. The documents left are packed greedily: laid end to end and cut at window borders, the
   last part at powers of two, so they need no padding at all.

Padding is therefore at most three times ``step - 1`` ids in a window. The driver sees the
histogram and the list of combinations only; ranks and running sums are taken in blocks, so a
length that a third of all documents share is spread over all tasks.

Defined results: a missing text is empty; an empty text is the end id alone; equal rows are
packed one by one; an empty table gives no pieces; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Scratch
from .texts import map_texts
from .tokens import encoder, public_file

WINDOW = 2_048
STEP = 8
_TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


@dataclass(frozen=True)
class Combination:
    """``count`` sequences, each with one leftover of every class in ``classes``."""

    classes: tuple[int, ...]
    count: int


def combinations(units: int) -> np.ndarray:
    """All multisets of one to three positive classes with the sum ``units``, as a matrix of
    class by combination."""
    one = [(units,)]
    two = [(a, units - a) for a in range(1, units // 2 + 1)]
    three = [(a, b, units - a - b) for a in range(1, units // 3 + 1)
             for b in range(a, (units - a) // 2 + 1)]
    matrix = np.zeros((units, len(one) + len(two) + len(three)))
    for at, parts in enumerate(one + two + three):
        for part in parts:
            matrix[part - 1, at] += 1
    return matrix


def solve_counts(matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set: minimise |matrix x - wanted|, x >= 0."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], bool)
    if not wanted.any():
        return x
    tolerance = 1e-9 * float(np.abs(matrix.T @ wanted).max())
    for _ in range(3 * matrix.shape[0]):
        slope = matrix.T @ (wanted - matrix @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            found = np.linalg.lstsq(matrix[:, columns], wanted, rcond=None)[0]
            if (found > 0).all():
                x[:] = 0
                x[columns] = found
                break
            # Go towards the free solution until the first count reaches zero.
            falling = found <= 0
            old = x[columns]
            share = (old[falling] / np.maximum(old[falling] - found[falling], 1e-300)).min()
            x[columns] = old + share * (found - old)
            active[columns[x[columns] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan_combinations(histogram: np.ndarray) -> list[Combination]:
    """Combinations and whole counts that use no class more often than it occurs.

    ``histogram[c - 1]`` is the number of leftovers of class ``c``.
    """
    matrix = combinations(len(histogram))
    counts = np.floor(solve_counts(matrix, histogram.astype(float)) + 1e-6)
    left = histogram.astype(np.int64)
    plan = []
    for at in np.argsort(-counts, kind="stable"):
        uses = matrix[:, at].astype(np.int64)
        needed = uses > 0
        # The largest count first; a count that the classes do not hold any more is cut.
        count = min(int(counts[at]), int((left[needed] // uses[needed]).min()))
        if count > 0:
            left -= count * uses
            classes = tuple(int(c) + 1 for c in np.flatnonzero(needed) for _ in range(uses[c]))
            plan.append(Combination(classes, count))
    return plan


def tail_cuts(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences after the last whole window: powers of two."""
    at, cuts = total // window * window, []
    while at < total:
        length = 1 << ((total - at).bit_length() - 1)
        cuts.append((at, length))
        at += length
    return cuts


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id``, ``n`` and ``ids``, the ids as little-endian 16- or 32-bit numbers."""
    get, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            ids = [data + end for data in get().encode(batch.column("text").to_pylist())]
            small = [_shrink(data) for data in ids]
            return {"doc_id": batch.column("doc_id"), "n": [len(data) // 4 for data in ids],
                    "ids": small}

        return step

    return map_texts(docs, work, _TOKENS)


def _shrink(data: bytes) -> bytes:
    ids = np.frombuffer(data, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else data


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW,
         step: int = STEP) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and place there."""
    if window % step or window // step < 2:
        raise ValueError("the window must hold at least two whole steps")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep("tokens", tokenise(docs, tokenizer, end_id)
                          .withColumn("row", F.monotonically_increasing_id()))
    scratch.free_shuffles()
    left = F.col("n") % window
    sizes = tokens.select("row", "n", F.ceil(left / step).cast("int").alias("cls"))
    counted = sizes.groupBy("cls").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {window}"))
                                       .alias("whole")).collect()
    histogram = np.zeros(window // step, np.int64)
    for row in counted:
        if row["cls"]:
            histogram[row["cls"] - 1] = row["k"]
    whole = sum(row["whole"] for row in counted)
    plan = plan_combinations(histogram)
    placed = scratch.keep("placed", _place(sizes, plan, window, step, whole))
    planned = whole + sum(c.count for c in plan)
    total = placed.agg(F.sum(F.when(F.col("stream") >= 0, F.col("n") % window))).first()[0] or 0
    return (tokens.join(placed.drop("n"), "row")
            .mapInArrow(_cutter(window, planned, total), from_arrow_schema(_PIECES)))


def _blocks(spark: SparkSession) -> Column:
    """A number that spreads the rows of any group over as many blocks as there are tasks."""
    return F.pmod(F.xxhash64("row"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _running(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before, in the order (``block``, ``row``) inside ``keys``.

    Sums inside a block and sums of whole blocks are taken apart, so no task sees a whole key.
    """
    inside = Window.partitionBy(*keys, "block").orderBy("row").rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys, "block").agg(F.sum(value).alias("_sum"))
              .select(*keys, "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
                      .alias("_before")))
    return (df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [*keys, "block"])
            .withColumn(out, F.col(out) + F.col("_before")).drop("_before"))


def _place(sizes: DataFrame, plan: list[Combination], window: int, step: int,
           whole: int) -> DataFrame:
    """Per document: first sequence of its whole windows, then either sequence and offset of
    the leftover, or its place in the greedy stream (-1 if it has none)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = whole
    for combination in plan:
        for slot, cls in enumerate(combination.classes):
            first = taken.get(cls, 0)
            slots.setdefault(cls, []).append((first, combination.count, base, slot))
            taken[cls] = first + combination.count
        base += combination.count
    rows = [(cls, first, first + count, base, slot)
            for cls, places in slots.items() for first, count, base, slot in places]
    spark = sizes.sparkSession
    # At most three rows per combination, and no more combinations than classes are used.
    table = F.broadcast(spark.createDataFrame(
        rows, "cls int, lo long, hi long, first_sequence long, slot int"))
    ranked = _running(sizes.withColumn("block", _blocks(spark)), ["cls"], F.lit(1), "rank")
    ranked = _take_slots(ranked, table)
    ranked = _running(ranked, [], F.expr(f"n div {window}"), "first_whole")
    free = F.when((F.col("cls") > 0) & F.col("sequence").isNull(), F.col("n") % window).otherwise(0)
    ranked = _running(ranked, [], free, "before")
    inside = Window.partitionBy("sequence").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    chosen = (ranked.where(F.col("sequence").isNotNull())
              .withColumn("offset", F.coalesce(F.sum(F.col("n") % window).over(inside), F.lit(0)))
              .withColumn("stream", F.lit(-1).cast("long")))
    others = (ranked.where(F.col("sequence").isNull())
              .withColumn("offset", F.lit(None).cast("long"))
              .withColumn("stream", F.when(F.col("cls") > 0, F.col("before")).otherwise(-1)))
    columns = ["row", "n", "first_whole", "sequence", "offset", "stream"]
    return chosen.select(columns).unionByName(others.select(columns))


def _take_slots(ranked: DataFrame, table: DataFrame) -> DataFrame:
    matched = ranked.join(
        table.withColumnRenamed("cls", "_cls"),
        (F.col("cls") == F.col("_cls")) & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi")), "left")
    return (matched.withColumn("sequence", F.col("first_sequence") + F.col("rank") - F.col("lo"))
            .drop("_cls", "lo", "hi", "first_sequence"))


def _cutter(window: int, stream_base: int, total: int):
    """Cut the ids of each document into its pieces."""
    tail = tail_cuts(total, window)
    tail_start = total // window * window
    whole_streams = total // window

    def stream_pieces(place: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of a leftover laid at ``place`` of the stream."""
        end = place + length
        while place < min(end, tail_start):
            stop = min(end, (place // window + 1) * window)
            yield stop - place, stream_base + place // window, place % window
            place = stop
        for at, (first, size) in enumerate(tail):
            if first <= place < min(end, first + size):
                stop = min(end, first + size)
                yield stop - place, stream_base + whole_streams + at, place - first
                place = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.select(["doc_id", "n", "ids", "first_whole", "sequence", "offset",
                                     "stream"]).to_pylist():
                n, data = row["n"], row["ids"]
                wide = data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype(
                    "<u4").tobytes()
                parts = [(window, row["first_whole"] + i, 0) for i in range(n // window)]
                if row["sequence"] is not None:
                    parts.append((n % window, row["sequence"], row["offset"]))
                elif row["stream"] >= 0:
                    parts.extend(stream_pieces(row["stream"], n % window))
                start = 0
                for length, sequence, offset in parts:
                    crc = zlib.crc32(wide[4 * start:4 * (start + length)])
                    out.append((row["doc_id"], start, length, crc, n, sequence, offset))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in
                 zip(zip(*out) if out else [[]] * len(_PIECES), _PIECES)], schema=_PIECES)

    return run


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2,048 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_file("byte_bpe_50k.json"), end_id=1)
