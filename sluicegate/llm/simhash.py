"""Document fingerprints: SimHash, and a search in permuted block tables.

The terms of a text are its words and its pairs of neighbouring words, weighted by their length in
bytes, since long terms are rare ones. Every occurrence votes with its weight on each of 256 bits,
for the bit if it is set in the term's hash and against it if not. Texts that share terms share bits: the
likeness of two fingerprints, the share of equal bits, is about one half for unrelated texts.

``find_near`` returns all fingerprints within a Hamming radius. The bits are cut into blocks; of two
fingerprints within the radius at least ``blocks - radius`` blocks are equal. There is a table for
every such choice of blocks, sorted and joined by them, so no fingerprint is missed; equal ones are
one entry and every meeting is tested on all bits inside the join.

Neighbours in ``doc_id`` order are found in one shuffle: documents are range-partitioned and sorted, a
task sees all neighbours but its last row's, and one first and one last row per task are joined later.

Defined results: a missing text is empty; a text without words has the fingerprint zero; missing ids
come first, equal ids by the MD5 of the text; a table of one row is its own neighbour; repeated
rows have a row each; columns besides ``doc_id`` and ``text`` are ignored; an empty table gives no
rows. Texts are read whole and voted on in blocks of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Scratch
from .texts import CACHE_WORDS, map_texts, slices

BITS = 256
RADIUS = 7
BLOCKS = 8
VOTE_ROWS = 4_096
_HASH_BYTES = BITS // 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
_PAIRS = pa.schema([
    ("part", pa.int32()), ("role", pa.string()), ("doc_id", pa.int64()), ("text", pa.binary()),
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
          "near_next"]


class Simhash:
    """Fingerprints of texts as arrays of bytes; remembers the hashes of words."""

    def __init__(self):
        self._hashes: dict[bytes, bytes] = {}

    def _hash(self, word: bytes) -> bytes:
        known = self._hashes.get(word)
        if known is None:
            if len(self._hashes) >= CACHE_WORDS:
                self._hashes.clear()
            known = self._hashes[word] = hashlib.sha256(word).digest()
        return known

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(_HASH_BYTES, np.uint8)
        votes = np.zeros(BITS, np.int64)
        for start in range(0, len(words), VOTE_ROWS):
            some = words[start:start + VOTE_ROWS + 1]  # the last one only ends a pair
            hashes = np.frombuffer(b"".join(map(self._hash, some)), np.uint8).reshape(-1, _HASH_BYTES)
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            # A pair hashes to its first word's bits against the other half of its second word's.
            pairs = hashes[:-1] ^ np.roll(hashes[1:], _HASH_BYTES // 2, axis=1)
            votes += _votes(hashes[:VOTE_ROWS], sizes[:VOTE_ROWS])
            votes += _votes(pairs, sizes[1:] + sizes[:-1])
        return np.packbits(votes > 0)


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per bit the weights of the hashes that have it, less those of the others."""
    total = int(weights.sum())
    if total >= 1 << 23:  # too large for exact sums in single precision
        return 2 * (weights @ np.unpackbits(hashes, axis=1).astype(np.int64)) - total
    return 2 * (weights.astype(np.float32) @ np.unpackbits(hashes, axis=1).astype(np.float32)
                ).astype(np.int64) - total


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.unpackbits(a ^ b).sum()) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` (hexadecimal) of every document."""
    def work():
        simhash = Simhash()

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            return {"doc_id": batch.column("doc_id"), "n_chars": [len(t.decode()) for t in texts],
                    "fingerprint": [simhash.of(t).tobytes().hex() for t in texts]}

        return step

    return map_texts(docs, work, _PRINTS)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


class _Row:
    """A document with its fingerprint."""

    def __init__(self, doc_id: int | None, text: bytes, simhash: Simhash):
        self.doc_id, self.raw = doc_id, text
        self.bits = simhash.of(text)

    def against(self, after: _Row, simhash: Simhash) -> tuple:
        text = self.raw.decode()
        other = edited(text, after.raw.decode()).encode()
        bits = simhash.of(other)
        return (self.doc_id, None, len(text), hashlib.sha256(other).hexdigest(),
                self.bits.tobytes().hex(), bits.tobytes().hex(), likeness(self.bits, bits),
                likeness(self.bits, after.bits))

    def alone(self) -> tuple:
        return (self.doc_id, self.raw, *[None] * 6)


def _batch(part: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(_PAIRS) - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(rows), pa.int32())]
        + [pa.array(values, field.type) for values, field in zip(columns, list(_PAIRS)[1:])],
        schema=_PAIRS)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row against the next one; the first and the last row also as they are."""
    part, simhash, before = TaskContext.get().partitionId(), Simhash(), None
    for piece in slices(batches):
        out = []
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            row = _Row(doc_id, text, simhash)
            out.append(("first", *row.alone()) if before is None
                       else ("done", *before.against(row, simhash)))
            before = row
        yield _batch(part, out)
    if before is not None:
        yield _batch(part, [("last", *before.alone())])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    simhash = Simhash()
    for piece in slices(batches):
        yield _batch(-1, [
            ("done", *_Row(doc_id, text, simhash).against(_Row(None, after, simhash), simhash))
            for doc_id, text, after in zip(*[piece.column(c).to_pylist()
                                             for c in ("doc_id", "text", "after")])])


def fingerprint_edits(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every document against its half-edited text and against the next document."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.md5("text").asc()]
    ordered = texts.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = scratch.keep("rows", ordered.mapInArrow(_in_order, from_arrow_schema(_PAIRS)))
    # One first and one last row per task; the task after the last one is the first.
    ends = rows.where("role <> 'done'").select("part", "role", "doc_id", "text")
    firsts = ends.where("role = 'first'")
    order = Window.orderBy("part")
    following = firsts.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    borders = (ends.where("role = 'last'").join(following, "part")
               .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
               .select("doc_id", "text", "after"))
    across = borders.mapInArrow(_across, from_arrow_schema(_PAIRS))
    return rows.where("role = 'done'").select(*RESULT).unionByName(across.select(*RESULT))


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fingerprint`` under every choice of blocks that must be equal, as table and block bits."""
    digits = BITS // 4
    cuts = [digits * i // blocks for i in range(blocks + 1)]
    keys = [F.struct(F.lit(number).alias("table"), F.concat(
        *[F.substring("fingerprint", cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in chosen]).alias("block"))
        for number, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return prints.select("*", F.explode(F.array(*keys)).alias("at")).select("*", "at.*").drop("at")


def _words(name: str) -> list:
    """The fingerprint as 64-bit integers."""
    return [F.conv(F.substring(name, at + 1, 8), 16, 10).cast("long")
            for at in range(0, BITS // 4, 8)]


def find_near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS,
              blocks: int = BLOCKS) -> DataFrame:
    """``fingerprint``, ``other``, ``distance``: for each distinct fingerprint of ``queries`` all distinct
    ones of ``prints`` within ``radius`` bits, itself included if it is there.

    More blocks than ``radius + 1`` make longer keys and more tables.
    """
    if not radius < blocks <= BITS // 4:
        raise ValueError("radius < blocks <= 64 must hold")
    wanted = _tables(queries.select("fingerprint").distinct(), radius, blocks)
    stored = _tables(prints.select("fingerprint").distinct(), radius, blocks).withColumnRenamed(
        "fingerprint", "other")
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_words("fingerprint"), _words("other"))),
                F.lit(0))
    met = wanted.alias("q").join(stored.alias("s"), (F.col("q.table") == F.col("s.table"))
                                 & (F.col("q.block") == F.col("s.block")) & (apart <= radius))
    return met.select("fingerprint", "other", apart.alias("distance")).distinct()


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and next documents; for ids divisible by 100 also
    ``n_within``, the number of other documents within 7 bits."""
    scratch = Scratch(spark, "simhash")
    judged = scratch.keep("judged", fingerprint_edits(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch))
    sizes = judged.groupBy("fingerprint").agg(F.count("*").alias("size"))
    near = find_near(sizes, judged.where(F.col("doc_id") % 100 == 0))
    within = near.join(sizes.withColumnRenamed("fingerprint", "other"), "other").groupBy(
        "fingerprint").agg((F.sum("size") - 1).alias("n_within"))
    return judged.join(within, "fingerprint", "left").select(*RESULT, F.when(
        F.col("doc_id") % 100 == 0, F.col("n_within")).alias("n_within"))
