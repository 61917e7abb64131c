"""Exact duplicates by two-pass Bloom filtering.

The filter is a table of 64-bit cells, about one per four documents, so it has no size limit
and no task or driver ever holds it whole. Pass one sets four bits of one cell per document and
notes the bits that more than one document set. Pass two tests the documents against those
repeated bits: one whose four bits are not all repeated has a hash that occurs once, and it
passes straight through. Only the rest are shuffled by their hash and compared exactly, by the
SHA-256 of the whole text.

Cells are combined inside each task before anything moves; a hash that a third of the rows
share is one cell row per task. The exact comparison is salted by ``doc_id`` in two levels.

Defined results: a missing text equals an empty one; texts are compared byte by byte; of equal
texts the largest ``doc_id`` stays, rows without one lose against any other; repeated rows with
the same ``doc_id`` and text are all marked alike; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Scratch

DOCS_PER_CELL = 4
_BLOCK_BITS = 10  # cells that one group merges
_CELLS = pa.schema([("block", pa.int64()), ("cell", pa.int64()),
                    ("once", pa.int64()), ("twice", pa.int64())])
_REPEATED = pa.schema([("cell", pa.int64()), ("twice", pa.int64())])


def text_sha256(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def fingerprints(docs: DataFrame, cells: int) -> DataFrame:
    """``doc_id``, SHA-256 of the text, its filter cell and the bits it sets there."""
    head = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")
    tail = F.conv(F.substring("text_sha256", 49, 15), 16, 10).cast("long")
    bits = F.lit(0).cast("long")
    for at in range(4):
        place = F.pmod(F.shiftright(tail, 6 * at), F.lit(64)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return (docs.select("doc_id", text_sha256().alias("text_sha256"))
            .withColumn("cell", F.pmod(head, F.lit(cells).cast("long")))
            .withColumn("bits", bits))


def combine(cell: np.ndarray, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge rows of equal cells: bits set at all, and bits set by more than one document.

    Neighbours are merged in pairs, so a cell with many rows takes few rounds.
    """
    while len(cell) > 1:
        order = np.argsort(cell, kind="stable")
        cell, once, twice = cell[order], once[order], twice[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        if len(starts) == len(cell):
            break
        rank = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
        left = np.flatnonzero(rank % 2 == 0)
        pair = np.minimum(left + 1, len(cell) - 1)
        paired = (pair > left) & (cell[pair] == cell[left])
        other = np.where(paired, once[pair], 0)
        twos = twice[left] | np.where(paired, twice[pair], 0) | (once[left] & other)
        cell, once, twice = cell[left], once[left] | other, twos
    return cell, once, twice


def _local_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass one inside a task: one row per touched cell and batch."""
    for batch in batches:
        cell, once = (batch.column(c).to_numpy() for c in ("cell", "bits"))
        if len(cell):
            cell, once, twice = combine(cell, once, np.zeros_like(once))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (cell >> _BLOCK_BITS, cell, once, twice)], schema=_CELLS)


_GONE = ("gone doc_id", "gone text_sha256")


def _merge_block(rows: pa.Table) -> pa.Table:
    """Merge the cells of one block; only cells with repeated bits are kept."""
    cell, once, twice = (rows.column(c).to_numpy() for c in ("cell", "once", "twice"))
    cell, _, twice = combine(cell, once, twice)
    some = twice != 0
    return pa.table([pa.array(cell[some]), pa.array(twice[some])], schema=_REPEATED)


def repeated_bits(prints: DataFrame) -> DataFrame:
    """The filter of pass two: cells with the bits that more than one document set."""
    local = prints.select("cell", "bits").mapInArrow(_local_filter, from_arrow_schema(_CELLS))
    return local.groupBy("block").applyInArrow(_merge_block, from_arrow_schema(_REPEATED))


def mark_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    cells = max(1, docs.count() // DOCS_PER_CELL)
    prints = scratch.keep("prints", fingerprints(docs, cells))
    repeated = scratch.keep("repeated", repeated_bits(prints))
    tested = prints.join(repeated, "cell", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("twice")) == F.col("bits"),
                            F.lit(False)))
    tested = scratch.keep("tested", tested.select("doc_id", "text_sha256", "maybe"))
    unique = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    possible = tested.where("maybe").select("doc_id", "text_sha256")
    return unique.unionByName(_compare(possible))


def _compare(possible: DataFrame) -> DataFrame:
    """Exact groups of the possibly repeated rows, with the hot hashes salted."""
    salts = int(possible.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = possible.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    parts = salted.groupBy("text_sha256", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    whole = parts.groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    answers = parts.select("text_sha256", "salt").join(whole, "text_sha256")
    return salted.join(answers, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents themselves, one of each group of equal texts.

    A row goes if its id and text are those of a copy that is not kept, so rows of one id and different
    texts are judged apart; of rows that repeat both id and text, and of copies without an id, all stay.
    """
    gone = mark_duplicates(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias(_GONE[0]), F.col("text_sha256").alias(_GONE[1])).distinct()
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return docs.join(gone, (F.col("doc_id") == F.col(_GONE[0])) & (own == F.col(_GONE[1])), "left_anti")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark the exact copies among all documents."""
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
