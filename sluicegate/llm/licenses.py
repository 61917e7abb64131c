"""Licence scan: exact base phrases, and a fuzzy search for short notices.

A text is normalised to words joined by single spaces. The base phrases are looked up there
exactly. The notices below may be misspelt: each one with ``k`` allowed edits is split into
``k + 1`` pieces, and by the pigeonhole principle any occurrence with at most ``k`` edits holds
one piece unchanged. One automaton over all pieces finds those seeds in a single pass; only
around them the regex library's bounded-error matching verifies the edits and gives the span.

Defined results: a missing text is empty and has no labels; equal rows are judged alike; an
empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import words_of
from .texts import map_texts

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices in normalised form, their labels, and the edits allowed.
NOTICES = [
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 1),
    ("licensed under the apache license", "apache", 3),
    ("licensed under the mit license", "mit", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc", 2),
    ("released into the public domain", "public-domain", 3),
    ("spdx license identifier", "spdx", 2),
]
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                     ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()),
                     ("score", pa.float64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("notice", pa.string()),
                    ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()),
                    ("matched", pa.string())])


@dataclass(frozen=True)
class Found:
    """A notice at characters ``start`` to ``end`` of the normalised text."""

    notice: int
    start: int
    end: int
    edits: int


def split_phrase(phrase: str, parts: int) -> list[tuple[int, str]]:
    """(place, piece) of ``parts`` nearly equal pieces."""
    cuts = [len(phrase) * at // parts for at in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Searcher:
    """Seeds and patterns of a list of notices (phrase, label, allowed edits)."""

    def __init__(self, notices: list[tuple[str, str, int]]):
        import ahocorasick

        self.notices = notices
        self.patterns = [regex.compile(
            f"(?e)(?<![^ ])(?:{regex.escape(phrase)}){{e<={edits}}}(?![^ ])")
            for phrase, _, edits in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (phrase, _, edits) in enumerate(notices):
            for place, piece in split_phrase(phrase, edits + 1):
                seeds.setdefault(piece, []).append((at, place))
        self.machine = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def find(self, text: str) -> list[Found]:
        """Verified occurrences in a normalised text, by place."""
        areas: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.machine.iter(text):
            seed = last - size + 1
            for at, place in uses:
                phrase, _, edits = self.notices[at]
                start = max(0, seed - place - edits - 1)
                end = min(len(text), seed - place + len(phrase) + edits + 1)
                own = areas.setdefault(at, [])
                if own and start <= own[-1][1]:
                    own[-1] = [min(start, own[-1][0]), max(end, own[-1][1])]
                else:
                    own.append([start, end])
        found = set()
        for at, own in areas.items():
            for start, end in own:
                # Up to whole words, so that the borders of the area are borders of words.
                start = text.rfind(" ", 0, start) + 1
                space = text.find(" ", end)
                end = len(text) if space < 0 else space
                for match in self.patterns[at].finditer(text[start:end]):
                    found.add(Found(at, start + match.start(), start + match.end(),
                                    sum(match.fuzzy_counts)))
        return sorted(found, key=lambda f: (f.start, f.end, f.notice))


class _SpaceCount:
    """Number of spaces before rising places; every part of the text is counted once."""

    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, 0

    def before(self, place: int) -> int:
        self.n += self.text.count(" ", self.at, place)
        self.at = place
        return self.n


def base_places(joined: str) -> Iterator[tuple[int, str]]:
    """(word, label) of every place of a base phrase in words joined by spaces."""
    padded = f" {joined} "
    for phrase, label in BASE.items():
        wanted = f" {phrase} "
        spaces, at = _SpaceCount(padded), padded.find(wanted)
        while at >= 0:
            yield spaces.before(at), label
            at = padded.find(wanted, at + 1)


def _normalised(text: bytes) -> tuple[int, str]:
    words = words_of(text)
    return len(words), b" ".join(words).decode("utf-8", "replace")


def scan_licences(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """Per document: base phrases, labels with the fuzzy ones, and the best match's score.

    The score is the share of a notice's characters that needed no edit, 1 for a base phrase.
    """
    def work():
        searcher = Searcher(notices)

        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column("text").to_pylist():
                n, joined = _normalised(text)
                base = sorted(base_places(joined))
                found = searcher.find(joined)
                labels = {label for _, label in base}
                shares = [1.0] if base else [0.0]
                shares += [1 - f.edits / len(notices[f.notice][0]) for f in found]
                out.append((n, len(base), base[0][0] if base else None,
                            base[-1][0] if base else None, ",".join(sorted(labels)),
                            ",".join(sorted(labels | {notices[f.notice][1] for f in found})),
                            max(shares)))
            return dict(zip(_RESULT.names, [batch.column("doc_id"), *zip(*out)]))

        return step

    return map_texts(docs, work, _RESULT)


def find_notices(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES) -> DataFrame:
    """One row per verified notice with its words, edits and normalised text."""
    def work():
        searcher = Searcher(notices)

        def step(batch: pa.RecordBatch) -> dict | None:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(),
                                 batch.column("text").to_pylist()):
                joined = _normalised(text)[1]
                spaces = _SpaceCount(joined)
                for f in searcher.find(joined):
                    matched = joined[f.start:f.end]
                    out.append((doc, notices[f.notice][1], notices[f.notice][0],
                                spaces.before(f.start), matched.count(" ") + 1, f.edits,
                                matched))
            return dict(zip(_SPANS.names, zip(*out))) if out else None

        return step

    return map_texts(docs, work, _SPANS)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
