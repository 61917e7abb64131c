"""Texts as byte batches inside tasks, and hashes of words and word sequences.

All operators read documents through :func:`map_texts`. It hands whole texts to a plain
function in slices of bounded bytes, so the memory of a task does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

SLICE_BYTES = 4 << 20
SLICE_ROWS = 1_000
CACHE_WORDS = 400_000

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def documents_only(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the text as bytes (a missing text is empty), and further columns."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       *more)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of text; one text is never cut."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0)
        start, held = 0, 0
        for at, size in enumerate(sizes.to_pylist()):
            if at > start and (held + size > SLICE_BYTES or at - start >= SLICE_ROWS):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(docs: DataFrame, work: Callable[[], Callable], schema: pa.Schema,
              *more: str) -> DataFrame:
    """Apply a function to slices of (``doc_id``, ``text`` bytes, further columns).

    ``work()`` runs once per task and returns a function from a record batch to a dict of
    columns; it may return None for nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for piece in slices(batches):
            columns = step(piece)
            if columns is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return documents_only(docs, *more).mapInArrow(run, from_arrow_schema(schema))


def filter_texts(docs: DataFrame, work: Callable[[], Callable]) -> DataFrame:
    """Keep the rows whose text passes; all columns stay as they are and nothing is shuffled.

    ``work()`` runs once per task and returns a function from a list of texts as bytes to a
    list of booleans; a missing text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = work()
        for piece in slices(batches):
            texts = pc.fill_null(piece.column("text").cast(pa.binary()), b"").to_pylist()
            yield piece.filter(pa.array(passes(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class WordHashes(dict):
    """64-bit hashes of words as 8 bytes each, remembered up to ``CACHE_WORDS`` words."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh64_intdigest(word, self.seed).to_bytes(8, "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits (a fixed bijection of 64-bit numbers)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Rolling:
    """Hashes of all runs of consecutive numbers, from prefix sums of a polynomial."""

    def __init__(self):
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers))
            self._powers = _geometric(_STEP, size)
            self._inverse = _geometric(_STEP_INVERSE, size)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._powers[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair, whatever stands around it."""
        return mix((sums[ends] - sums[starts]) * self._inverse[starts])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * self._inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _geometric(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)
