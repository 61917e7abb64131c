"""Benchmark decontamination with one Aho-Corasick automaton.

The test items are normalised to words, cut into windows of ``width`` consecutive words (a
shorter item is one window), and put into one automaton over word numbers. Every document is
normalised once and its words run through the automaton once; word places map back to places
in the original text.

The items travel to the tasks as text, at most ``BLOCK_BYTES`` at once. The size of the item
table is taken first: a larger table is dealt into blocks by a hash of the item, each block has
its own automaton, and the documents pass through one after the other.

Defined results: a missing text has no words; an item without words has no window; equal items
with different ids all count; items without an id count together as one item that adds no name,
their windows like all others; repeated documents are judged row by row; an empty table of items
leaves all documents clean; an empty table of documents gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .texts import filter_texts, map_texts

WIDTH = 10
BLOCK_BYTES = 1 << 20
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32
                   if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_MORE = pa.schema([_HITS.field("doc_id"), pa.field("text", pa.binary()), _HITS.field("spans"),
                   _HITS.field("items")])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                     ("n_items", pa.int64()), ("items_sha256", pa.string()),
                     ("contaminated", pa.bool_())])
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()),
                      ("first_word", pa.int64()), ("n_words", pa.int64()),
                      ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())])


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters, A-Z as a-z."""
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Windows of test items; finds every place where one stands in a list of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        import ahocorasick

        self._numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            words = [self._numbers.setdefault(word, len(self._numbers) + 1)
                     for word in words_of(text)]
            for at in range(max(1, len(words) - width + 1) if words else 0):
                windows.setdefault(tuple(words[at:at + width]), set()).add(item)
        self._machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, found in windows.items():
            self._machine.add_word(window, (len(window), frozenset(found)))
        self.empty = not windows
        if windows:
            self._machine.make_automaton()

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[str | None]]]:
        """(first word, word after the last, items) of every window that occurs."""
        if self.empty or not words:
            return
        get = self._numbers.get
        for last, (n, items) in self._machine.iter(tuple([get(word, 0) for word in words])):
            yield last - n + 1, last + 1, items


_AUTOMATA: dict[tuple, Automaton] = {}


def _automaton(items: list[tuple[str | None, bytes]], width: int) -> Automaton:
    """One automaton per worker process; it is built where it is used."""
    key = (width, hashlib.sha256(repr(items).encode()).digest())
    if key not in _AUTOMATA:
        if len(_AUTOMATA) >= 4:
            _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(items, width)
    return _AUTOMATA[key]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items with words in blocks of about ``block_bytes``; the size is checked first."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"),
                        F.col("text").cast("binary").alias("text")).where(
        F.col("text").isNotNull())
    size = rows.agg(F.sum(F.length("text") + F.coalesce(F.length("item_id"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted(((row["item_id"], bytes(row["text"])) for row in own.collect()),
                     key=lambda item: (item[0] or "", item[0] is not None, item[1]))


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of places that lie in at least one span."""
    total, reach = 0, -1
    for start, end in sorted(spans):
        if end > reach:
            total += end - max(start, reach)
            reach = end
    return total


def _scan(docs: DataFrame, items: list, width: int, last: bool) -> DataFrame:
    """Add the hits of one block of items to those in ``spans`` and ``items``."""
    schema = _HITS if last else _MORE

    def work():
        automaton = _automaton(items, width)

        def step(batch: pa.RecordBatch) -> dict:
            counts, spans, found = [], batch.column("spans").to_pylist(), []
            for text, places, before in zip(batch.column("text").to_pylist(), spans,
                                            batch.column("items").to_pylist()):
                words, names = words_of(text), set(before)
                for start, end, some in automaton.find(words):
                    places += (start, end)
                    names |= some
                counts.append(len(words))
                found.append(list(names))
            columns = {"doc_id": batch.column("doc_id"), "n_words": counts, "spans": spans,
                       "items": found, "text": batch.column("text")}
            return {name: columns[name] for name in schema.names}

        return step

    return map_texts(docs, work, schema, "spans", "items")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [covered(list(zip(s[::2], s[1::2]))) for s in batch.column("spans").to_pylist()]
        items = [set(some) for some in batch.column("items").to_pylist()]
        names = [",".join(sorted(x - {None})) for x in items]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]),
            pa.array(np.array(hit, np.int64) > 0)], schema=_RESULT)


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, the words inside windows of test items, and those items."""
    scanned = docs.select("doc_id", "text", F.array().cast("array<int>").alias("spans"),
                          F.array().cast("array<string>").alias("items"))
    blocks = list(item_blocks(items, block_bytes))
    for at, block in enumerate(blocks):
        scanned = _scan(scanned, block, width, at + 1 == len(blocks))
    return scanned.mapInArrow(_judge, from_arrow_schema(_RESULT))


def find_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per window and item found: word place, and characters in the original text."""
    def scan(block: list) -> DataFrame:
        def work():
            automaton = _automaton(block, width)

            def step(batch: pa.RecordBatch) -> dict:
                out: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(),
                                     batch.column("text").to_pylist()):
                    found = list(automaton.find(words_of(text)))
                    places = [m.span() for m in _WORD.finditer(text)] if found else []
                    for start, end, names in found:
                        a, b = places[start][0], places[end - 1][1]
                        first = len(text[:a].decode("utf-8", "replace"))
                        matched = text[a:b].decode("utf-8", "replace")
                        out += [(doc, name, start, end - start, first, first + len(matched),
                                 matched) for name in sorted(names, key=lambda x: x or "")]
                return dict(zip(_MATCHES.names, zip(*out))) if out else None

            return step

        return map_texts(docs, work, _MATCHES)

    found = [scan(block) for block in item_blocks(items, block_bytes)]
    matches = found[0]
    for other in found[1:]:
        matches = matches.unionByName(other)
    return matches


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of a test item, with all their columns."""
    for block in item_blocks(items, block_bytes):
        docs = filter_texts(docs, lambda block=block: _is_clean(block, width))
    return docs


def _is_clean(items: list, width: int):
    automaton = _automaton(items, width)
    return lambda texts: [next(automaton.find(words_of(text)), None) is None for text in texts]


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat windows of the test items."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                              spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
