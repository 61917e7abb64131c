"""Toxicity: noisy-channel deobfuscation under a character language model, then scoring.

1. Characters of all documents are counted in threes (Spark adds up the counts of all tasks).
   The table has at most ``SYMBOLS**3`` entries and makes the language model.
2. Words that look disguised are restored: digits and signs for letters, separators inside a
   word, letters drawn out, and letters set apart by spaces. The possible readings of each
   character form a lattice; Viterbi decoding finds the reading that the channel and the
   language model together make likeliest. Of letters set apart by spaces, every gap may be a
   word border: all words on a reading at most ``MARGIN`` dearer than the best are scored.
   Of a token with signs inside, the parts between the signs are words as well.
3. The restored text is scored: a logistic regression over the words and word beginnings that
   toxic rows of a bounded labelled sample have far more often than others. Only those count,
   each once, so long clean texts gather no score.

Every whole text is read twice and nothing but counts and the training sample moves. The
language model (1 MiB) and at most ``MAX_FEATURES`` weights are broadcast.

Defined results: a missing text is empty; an empty text gets the score of the intercept alone;
without usable labelled rows every text gets that score; equal rows are scored alike; an empty table
gives no rows; further columns are left out.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .quality import Ftrl, logistic, fold, train
from .texts import documents_only, map_texts, slices

MAX_TRAINING_ROWS = 6_000
THRESHOLD = 0.3
LEAST_ROWS = 4        # toxic training rows that a feature needs
LEAST_EXCESS = 5.0    # and by how many standard deviations it must exceed the share
MAX_FEATURES = 20_000
BASE = -4.0           # log odds of a text without any telling feature
LONGEST_WORD = 64   # longer tokens are not words; they are decoded in the parts between signs
BEAM = 48
MARGIN = 12.0       # in nats; about two word borders that the language model has not seen
# The alphabet of the language model; other characters are one more symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
# Letters that a digit or sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
              "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
              "€": "e", "£": "l"}
# Signs that may be put between the letters of a word.
SEPARATORS = ".-_*~'`^,:;/\\=#"
SYMBOLS = 64
_OTHER = len(LETTERS)
_SYMBOL = {letter: at for at, letter in enumerate(LETTERS)}
_SUBSTITUTION, _SEPARATION, _REPETITION, _PLAIN_SIGN = 0.5, 0.3, 0.4, 6.0
MAX_SINGLE_BYTES = 6  # a character with an accent and a mark after it
_COUNTS = pa.schema([("code", pa.int32()), ("n", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_DRAWN_OUT = re.compile(r"(\w)\1\1")
_LONG_DRAWN_OUT = re.compile(r"(\w)\1{3,}")
_PLAIN_SIGNS = re.compile("(?:(?![" + re.escape("".join(LOOKALIKES)) + r"])[\W_])+")
_ALL_SIGNS = re.compile(r"[\W_]+")
# White space beyond that of bytes.split(): separators of ASCII, and Unicode's as UTF-8.
_SEPARATOR_CODES = bytes(32 if 28 <= c <= 31 else c for c in range(256))
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]"
                         b"|\xe2\x81\x9f|\xe3\x80\x80")
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¿¡…“”„‘’–—"
_LEADING = SEPARATORS + "\"?%&([{<>)]}"
_TRAILING = SEPARATORS + "\"?%&!$([{<>)]}"


def _symbol_table() -> np.ndarray:
    table = np.full(0x250, _OTHER, np.int32)
    for letter, at in _SYMBOL.items():
        table[ord(letter)] = at
    return table


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the task's texts; runs of other characters count as one border."""
    table, total = _symbol_table(), np.zeros(SYMBOLS ** 3, np.int64)
    for piece in slices(batches):
        text = b"\n".join(piece.column("text").to_pylist()).decode("utf-8", "replace").lower()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        symbols = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], _OTHER)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != _OTHER) | (symbols[:-1] != _OTHER)
        symbols = symbols[keep]
        codes = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
        total += np.bincount(codes, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])],
                                     schema=_COUNTS)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents, a table of a fixed size."""
    rows = (documents_only(docs).mapInArrow(_count_characters, from_arrow_schema(_COUNTS))
            .groupBy("code").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    for row in rows:
        counts[row["code"]] = row["n"]
    return counts


def language_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two), mixed with the bigram so that unseen triples have a cost."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two = three.sum(axis=0) + 0.5
    back = two / two.sum(axis=1, keepdims=True)
    weight = 5.0
    smooth = (three + weight * back[None]) / (three.sum(axis=2, keepdims=True) + weight)
    return (-np.log(smooth)).astype(np.float32)


class Decoder:
    """Viterbi decoding of a disguised word."""

    def __init__(self, costs: np.ndarray):
        self._table, self._costs = costs, costs.tolist()

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Per character its readings (a letter, or nothing) with the channel's costs."""
        columns = []
        for at, char in enumerate(word):
            readings = []
            if char in _SYMBOL:
                readings.append((char, 0.0))
            for letter in LOOKALIKES.get(char, ""):
                readings.append((letter, _SUBSTITUTION))
            if char in SEPARATORS or char == " ":
                readings.append(("", _SEPARATION))
            if at and char == word[at - 1]:
                readings.append(("", _REPETITION))
            columns.append(readings or [("", _PLAIN_SIGN)])
        return columns

    def restore(self, word: str) -> str:
        """The likeliest reading of a lower-case word."""
        paths = {(_OTHER, _OTHER): (0.0, "")}
        for readings in self.lattice(word):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (first, second), (cost, text) in paths.items():
                row = self._costs[first][second]
                for letter, price in readings:
                    if letter:
                        third = _SYMBOL[letter]
                        state, total = (second, third), cost + price + row[third]
                        reading = text + letter
                    else:
                        state, total, reading = (first, second), cost + price, text
                    known = step.get(state)
                    if known is None or (total, reading) < known:
                        step[state] = (total, reading)
            if len(step) > BEAM:
                step = dict(sorted(step.items(), key=lambda item: item[1])[:BEAM])
            paths = step
        # The end of the word counts, too.
        return min((cost + self._costs[a][b][_OTHER], text)
                   for (a, b), (cost, text) in paths.items())[1]

    def letters(self, run: str) -> str:
        """The likeliest letters of a run in which every gap may be a word border."""
        costs = self._costs
        paths = {(_OTHER, _OTHER): (0.0, None)}
        for readings in self.lattice(run):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (first, second), (cost, path) in paths.items():
                froms = [(first, second, cost)]
                if second != _OTHER:
                    froms.append((second, _OTHER, cost + costs[first][second][_OTHER]))
                for a, b, start in froms:
                    row = costs[a][b]
                    for letter, price in readings:
                        if letter:
                            third = _SYMBOL[letter]
                            state, total = (b, third), start + price + row[third]
                        else:
                            state, total = (a, b), start + price
                        known = step.get(state)
                        if known is None or total < known[0]:
                            step[state] = total, (path, letter) if letter else path
            if len(step) > BEAM:
                step = dict(sorted(step.items(), key=lambda item: item[1][0])[:BEAM])
            paths = step
        path = min((cost + costs[a][b][_OTHER], at, path)
                   for at, ((a, b), (cost, path)) in enumerate(paths.items()))[2]
        found = []
        while path is not None:
            path, letter = path
            found.append(letter)
        return "".join(reversed(found))

    def pieces(self, text: str) -> set[str]:
        """Words of a text without spaces, on readings at most ``MARGIN`` dearer than the best."""
        n, table = len(text), self._table
        if n < 2:
            return {text} if text else set()
        at = np.array([_SYMBOL.get(char, _OTHER) for char in text], np.int32)
        before = np.concatenate(([_OTHER], at[:-1]))
        # Costs of a word's first and second letter, of later ones, and of an end after them.
        first = table[before, _OTHER, at].astype(float)
        second = np.append(table[_OTHER, at[:-1], at[1:]], 0.0).astype(float)
        later = np.concatenate(([0.0, 0.0], table[at[:-2], at[1:-1], at[2:]])).astype(float)
        lone = table[_OTHER, at, _OTHER].astype(float)
        end = np.concatenate(([np.inf, np.inf], table[at[:-1], at[1:], _OTHER])).astype(float)
        fi, se, la, lo, en = (x.tolist() for x in (first, second, later, lone, end))
        # Cheapest ways to a border at each place, and from there to the end.
        ahead, inside = [0.0] * (n + 1), math.inf
        for q in range(1, n + 1):
            if q > 1:
                inside = min(inside + la[q - 1], ahead[q - 2] + fi[q - 2] + se[q - 2])
            ahead[q] = min(ahead[q - 1] + fi[q - 1] + lo[q - 1], inside + en[q])
        rest, within = [0.0] * (n + 1), [math.inf] * (n + 2)
        within[n] = en[n]
        for p in range(n - 1, -1, -1):
            rest[p] = fi[p] + min(lo[p] + rest[p + 1], se[p] + within[p + 2])
            within[p] = min(en[p] + rest[p], la[p] + within[p + 1])
        limit = ahead[n] + MARGIN
        sums, to_end = np.concatenate(([0.0], np.cumsum(later))), end + np.array(rest)
        found = set()
        for p in range(n - 1):
            if ahead[p] + rest[p] > limit:
                continue
            stop = min(n, p + LONGEST_WORD)
            cost = (ahead[p] + fi[p] + se[p] + to_end[p + 2:stop + 1]
                    + sums[p + 2:stop + 1] - sums[p + 2])
            found.update(text[p:p + 2 + q] for q in np.flatnonzero(cost <= limit).tolist())
            if ahead[p] + fi[p] + se[p] + sums[stop] - sums[p + 2] + within[stop] <= limit:
                found.add(text[p:stop])  # how a longer word begins
        return found

    def words_in(self, run: str) -> set[str]:
        """Words of a run of single characters, as they stand and restored."""
        if not any(char.isalpha() for char in run):
            return set()
        found = self.pieces(run)
        if not run.isalpha() or _DRAWN_OUT.search(run):
            found |= self.pieces(self.letters(run))
        return found


def looks_disguised(word: str) -> bool:
    """Letters mixed with signs or digits, or a letter drawn out."""
    return (len(word) <= LONGEST_WORD and any(c.isalpha() for c in word)
            and (not word.isalpha() or _DRAWN_OUT.search(word) is not None))


def clean(raw: str) -> str:
    return raw.strip(_SIGNS)


def readings(raw: str, decoder: Decoder) -> list[str]:
    """A lower-case token as a word, and restored if it looks disguised."""
    found = [clean(raw)]
    # Signs at the edge may be letters, too; marks at the end rather end a sentence.
    whole = raw.lstrip(_LEADING).rstrip(_TRAILING)
    for form in (found[0], whole) if whole != found[0] else (whole,):
        form = _LONG_DRAWN_OUT.sub(r"\1\1\1", form)
        if looks_disguised(form):
            found.append(decoder.restore(form))
    return [form for form in found if form]


def parts_of(raw: str) -> set[str]:
    """What stands between the signs of a token; signs that may be letters also count as such."""
    if _ALL_SIGNS.search(raw) is None:
        return set()
    return {part for pattern in (_PLAIN_SIGNS, _ALL_SIGNS)
            for part in pattern.split(raw) if part and part != raw}


def words_of(text: bytes) -> list[bytes]:
    """The tokens of a text between white space of any kind."""
    text = text.translate(_SEPARATOR_CODES)
    return (text if text.isascii() else _WIDE_SPACE.sub(b" ", text)).split()


def features_of(word: str) -> tuple[str, ...]:
    """A word, and how it begins."""
    return "=" + word, word[:4], word[:5], word[:6]


class Words(dict):
    """What a raw word adds to a text, remembered; disguised words are restored first."""

    LIMIT = 500_000

    def __init__(self, costs: np.ndarray, known: dict[str, int] | None = None):
        super().__init__()
        self._decoder, self._known = Decoder(costs), known

    def names(self, raw: bytes) -> set[str]:
        if raw.isalpha() and len(raw) <= LONGEST_WORD:
            word = raw.decode().lower()
            if _DRAWN_OUT.search(word) is None:
                return set(features_of(word))
        word = unicodedata.normalize("NFC", raw.decode("utf-8", "replace").lower())
        forms = set(readings(word, self._decoder))
        for part in parts_of(word):
            forms.update(readings(part, self._decoder))
        # Letters may be set apart by signs, too, and be more than one word.
        letters = [part.encode() for part in _ALL_SIGNS.split(word) if part]
        for run in spaced_runs(letters) if len(letters) > 2 else ():
            forms |= self._decoder.words_in(run.decode())
        return {name for form in forms for name in features_of(form)}

    def __missing__(self, raw: bytes) -> bytes:
        known = self._known
        value = b"".join(known[name].to_bytes(4, "little")
                         for name in self.names(raw) if name in known)
        if len(self) >= self.LIMIT:
            self.clear()
        self[raw] = value
        return value

    def tokens(self, text: bytes) -> list[bytes]:
        words = words_of(text)
        found = list(words)
        for run in spaced_runs(words, 2 if text.isascii() else MAX_SINGLE_BYTES):
            letters = run.decode("utf-8", "replace").lower()
            if len(letters) <= LONGEST_WORD:
                found.append(run)
            found += [word.encode() for word in sorted(self._decoder.words_in(letters))]
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Numbers of the known features in a text, each once."""
        found = b"".join(map(self.__getitem__, self.tokens(text)))
        return np.unique(np.frombuffer(found, np.uint32))


class Singles(dict):
    """The character of a word that has only one besides marks at its end; else nothing."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> bytes:
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
        if len(text) > 1:
            text = text.rstrip(_TRAILING + "!…“”’»")
        value = text.encode() if len(text) == 1 else b""
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value


_SINGLES = Singles()


def spaced_runs(words: list[bytes], longest: int = MAX_SINGLE_BYTES) -> list[bytes]:
    """Words of one character, at least three in a row, put together."""
    n = len(words)
    if n < 3:
        return []
    runs = []
    for a, b in _runs(np.fromiter(map(len, words), np.int32, n) <= longest):
        letters = [_SINGLES[word] for word in words[a:b]]
        if any(letters):
            runs += [b"".join(letters[c:d]) for c, d in _runs(np.array(list(map(bool, letters))))]
    return runs


def _runs(short: np.ndarray) -> list[tuple[int, int]]:
    """Places of at least three in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], short.astype(np.int8), [0]))))
    at = np.flatnonzero(edges[1::2] - edges[::2] >= 3)
    return list(zip(edges[::2][at].tolist(), edges[1::2][at].tolist()))


def telling_features(rows: list[set[str]], labels: list[int]) -> list[str]:
    """Features that toxic rows have far more often than the share of toxic rows explains."""
    toxic, other = Counter(), Counter()
    for names, label in zip(rows, labels):
        (toxic if label else other).update(names)
    share = min(0.5, max(1, sum(labels)) / len(labels))
    kept = []
    for name, t in toxic.items():
        n = t + other[name]
        excess = (t - n * share) / math.sqrt(n * share * (1 - share))
        if t >= LEAST_ROWS and excess >= LEAST_EXCESS and 2 * t > n:
            kept.append((-excess, name))
    return [name for _, name in sorted(kept)[:MAX_FEATURES]]


def fit_toxicity(costs: np.ndarray, updates: int = 60_000):
    """A fitting function for :func:`quality.train`; few rows are gone over more often."""
    def fit(texts: list[bytes], labels: list[int]) -> bytes:
        words, memory = Words(costs), {}
        rows = []
        for text in texts:
            names: set[str] = set()
            for raw in set(words.tokens(text)):
                if raw not in memory:
                    memory[raw] = words.names(raw)
                names |= memory[raw]
            rows.append(names)
        known = {name: at for at, name in enumerate(telling_features(rows, labels))}
        model = Ftrl(size=len(known), alpha=1.0, l1=0.0, l2=0.02, offset=BASE)
        order = np.random.default_rng(7)
        numbers = [np.array(sorted(known[x] for x in names if x in known), np.int64)
                   for names in rows]
        for _ in range(max(4, min(100, updates // len(rows)))):
            for at in order.permutation(len(rows)):
                model.learn(numbers[at], np.ones(len(numbers[at])), labels[at])
        # A telling feature never speaks for a clean text.
        weights = np.maximum(model.weights()[:-1], 0).tolist()
        return json.dumps(dict(zip(known, weights))).encode()

    return fit


class Scorer:
    def __init__(self, costs: np.ndarray, model: bytes):
        found = json.loads(model)
        self.weights = np.array(list(found.values()), np.float64)
        self.words = Words(costs, {name: at for at, name in enumerate(found)})

    def score(self, text: bytes) -> float:
        return logistic(float(self.weights[self.words.of(text)].sum()) + BASE)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` and score of every whole text, learned from the rows outside fold 2 of 4."""
    costs = language_costs(character_counts(docs))
    model = train(docs, labels, "toxic", fold(4) != 2, fit_toxicity(costs), MAX_TRAINING_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast((costs, model or b"{}"))

    def work():
        scorer = Scorer(*shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"),
                    "score": [scorer.score(text) for text in batch.column("text").to_pylist()]}

        return step

    return map_texts(docs, work, _SCORES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity; one labelled row in four is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
