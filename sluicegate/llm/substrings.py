"""Repeated passages by a compacted De Bruijn graph of words.

An edge of the graph is a window of ``width`` consecutive words, its nodes are the window
without its last and without its first word. The graph is never built edge by edge:

1. The minimiser of a window is the smallest hash of ``INNER`` words inside it. Equal windows
   have equal minimisers, so each document is cut into runs of windows with one minimiser. Such
   a run is a path of the graph. A minimiser that occurs in one run only has no repeated
   edge, and its run is dropped.
2. Runs with equal words are one path; its first place is its source. If a minimiser has a
   single path, the path does not branch, and all its edges repeat together: one row stands for
   all of them. Only the paths of branching minimisers are taken apart into edges, and those
   only at their sources, so the copies of a passage are never expanded.
3. An edge or path whose source lies earlier is a repeated piece. Pieces that continue each
   other in the document and in the source alike are joined to long spans by their coordinates.

Windows are compared by 128 bits of hash (window or path, and minimiser). Counts and smallest
places are combined before they are shuffled; joins with a hot passage can be split.

Defined results: a missing text has no words; documents shorter than the window lose nothing;
rows that share a ``doc_id`` are versions of one document and compare by place only; rows
without a ``doc_id`` lose nothing and are no source; an empty table gives no rows; further
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .texts import Rolling, WordHashes, map_texts, sliding_min

WIDTH = 20
INNER = 8
_RUNS = pa.schema([("minimiser", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()),
                   ("start", pa.int32()), ("n", pa.int32()), ("loops", pa.bool_())])
_EDGES = pa.schema([("minimiser", pa.int64()), ("edge", pa.int64()), ("doc_id", pa.int64()),
                    ("start", pa.int32()), ("first_start", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("kept_sha256", pa.string())])


class _Windows:
    """Hashes of the windows of a text and their minimisers."""

    def __init__(self, width: int):
        self.width, self.hashes, self.rolling = width, WordHashes(), Rolling()

    def of(self, text: bytes):
        """(prefix sums, inner hashes, minimiser of every window), or None for a short text."""
        words = text.split()
        if len(words) < self.width:
            return None
        sums = self.rolling.prefix(self.hashes.of(words))
        inner = self.rolling.windows(sums, INNER)
        return sums, inner, sliding_min(inner, self.width - INNER + 1)

    def runs(self, text: bytes):
        """(minimiser, content, start, number of windows, loops) of the runs of a text.

        A run loops if its minimiser occurs more than once in it: it may repeat an edge itself.
        """
        found = self.of(text)
        if found is None:
            return None
        sums, inner, least = found
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate(([0], cut))
        end = np.append(cut, len(least))
        minimiser = least[start]
        content = self.rolling.spans(sums, start, end + self.width - 1)
        # Of the runs with a minimiser that the text holds twice, any may loop.
        order = np.sort(inner)
        twice = order[1:][order[1:] == order[:-1]]
        loops = np.isin(minimiser, twice) if len(twice) else np.zeros(len(start), bool)
        return minimiser, content, start, end - start, loops


def window_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Runs of windows with one minimiser, over all documents."""
    def work():
        windows = _Windows(width)

        def step(batch: pa.RecordBatch) -> dict | None:
            parts, ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(),
                                 batch.column("text").to_pylist()):
                runs = windows.runs(text) if doc is not None else None
                if runs is not None:
                    parts.append(runs)
                    ids.append(np.full(len(runs[0]), doc, np.int64))
            if not parts:
                return None
            columns = [np.concatenate(column) for column in zip(*parts)]
            return {"minimiser": columns[0].astype(np.int64),
                    "content": columns[1].astype(np.int64), "doc_id": np.concatenate(ids),
                    "start": columns[2].astype(np.int32), "n": columns[3].astype(np.int32),
                    "loops": columns[4]}

        return step

    return map_texts(docs, work, _RUNS)


def _expand(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The edges of paths at their sources, with the edge's first place in the document.

    A document's paths come as one list.
    """
    lists = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("paths"))

    def work():
        windows = _Windows(width)

        def step(batch: pa.RecordBatch) -> dict | None:
            out: list[tuple] = []
            for doc, text, paths in zip(batch.column("doc_id").to_pylist(),
                                        batch.column("text").to_pylist(),
                                        batch.column("paths").to_pylist()):
                found = windows.of(text)
                if found is None:
                    continue
                sums, _, least = found
                start = np.array([path["start"] for path in paths], np.int64)
                size = np.array([path["n"] for path in paths], np.int64)
                at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                at = np.unique(at[at < len(least)])
                edge = windows.rolling.spans(sums, at, at + width)
                _, first, which = np.unique(edge, return_index=True, return_inverse=True)
                out.append((least[at].astype(np.int64), edge.astype(np.int64),
                            np.full(len(at), doc, np.int64), at.astype(np.int32),
                            at[first][which].astype(np.int32)))
            if not out:
                return None
            return dict(zip(_EDGES.names, [np.concatenate(c) for c in zip(*out)]))

        return step

    return map_texts(docs.select("doc_id", "text").join(lists, "doc_id"), work, _EDGES, "paths")


def repeated_pieces(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """Paths and edges that have an earlier source: places in the document and in the source."""
    runs = scratch.keep("runs", window_runs(docs, width))
    repeated = (runs.groupBy("minimiser").agg(F.count("*").alias("k"), F.max("loops").alias("loop"))
                .where("k > 1 or loop").select("minimiser"))
    runs = scratch.keep("repeated-runs", runs.join(repeated, "minimiser"))
    scratch.drop("runs")
    scratch.free_shuffles()

    paths = scratch.keep("paths", runs.groupBy("minimiser", "content").agg(
        F.min(F.struct("doc_id", "start")).alias("source"), F.max("n").alias("n"),
        F.max("loops").alias("loops")))
    copies = runs.select("minimiser", "content", "doc_id", "start", "n").join(
        paths.select("minimiser", "content", "source"), ["minimiser", "content"]).where(
        (F.col("doc_id") != F.col("source.doc_id")) | (F.col("start") != F.col("source.start")))
    copies = scratch.keep("copies", copies.select("doc_id", "start", "n", "source"))
    scratch.drop("repeated-runs")

    branching = (paths.groupBy("minimiser")
                 .agg(F.count("*").alias("k"), F.max("loops").alias("loop"))
                 .where("k > 1 or loop").select("minimiser"))
    places = paths.join(branching, "minimiser").select(
        F.col("source.doc_id").alias("doc_id"), F.col("source.start").alias("start"), "n")
    edges = scratch.keep("edges", _expand(docs, places, width))
    scratch.drop("paths")
    scratch.free_shuffles()
    # An edge that its own document has earlier is settled; one row per document is compared.
    own = edges.where("first_start < start").select(
        "doc_id", "start", F.struct("doc_id", F.col("first_start").alias("start")).alias("source"))
    edges = edges.where("first_start = start")
    first = edges.groupBy("minimiser", "edge").agg(
        F.min(F.struct("doc_id", "start")).alias("source"), F.count("*").alias("k")).where("k > 1")
    later = edges.join(first, ["minimiser", "edge"]).where(
        (F.col("doc_id") != F.col("source.doc_id")) | (F.col("start") != F.col("source.start"))
    ).select("doc_id", "start", "source")
    return copies.unionByName(later.unionByName(own).select(
        "doc_id", "start", F.lit(1).alias("n"), "source"))


def repeated_spans(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """Long repeated spans: ``first_word`` and ``n_words`` with the place they were seen first."""
    pieces = repeated_pieces(docs, scratch, width).withColumn(
        "shift", F.col("source.start") - F.col("start"))
    line = Window.partitionBy("doc_id", "source.doc_id", "shift").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(
        line.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("span", F.sum("new").over(line))
    return numbered.groupBy("doc_id", F.col("source.doc_id").alias("source_doc"), "shift",
                            "span").agg(
        F.min("start").alias("first_word"), F.max(F.col("start") + F.col("n")).alias("_end")).select(
        "doc_id", "first_word", (F.col("_end") - F.col("first_word") + width - 1).alias("n_words"),
        "source_doc", (F.col("first_word") + F.col("shift")).alias("source_word"))


def _cut() -> Callable[[pa.RecordBatch], dict]:
    def step(batch: pa.RecordBatch) -> dict:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = text.split()
            keep = np.ones(len(words), bool)
            for span in spans or ():
                keep[span["first_word"]:span["first_word"] + span["n_words"]] = False
            kept = [words[at] for at in np.flatnonzero(keep).tolist()] if spans else words
            out.append((len(words), len(words) - len(kept),
                        hashlib.sha256(b" ".join(kept)).hexdigest()))
        return dict(zip(_KEPT.names, [batch.column("doc_id"), *zip(*out)]))

    return step


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document the number of words, of words removed, and a digest of those kept."""
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = scratch.keep("spans", repeated_spans(docs, scratch, width))
    scratch.drop("copies", "edges")
    scratch.free_shuffles()
    lists = spans.groupBy("doc_id").agg(
        F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    texts = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    return map_texts(texts, _cut, _KEPT, "spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of all documents that repeat earlier windows of 20 words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
