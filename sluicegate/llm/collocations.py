"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation and line ends. Every word starts one record: itself and
up to three words after it in the piece. A record of four words is an edge between two nodes of
three words that overlap; a shorter record stands at the end of a piece. Equal records are added up
in their task first. So one record a word travels, and all shorter counts follow from it: a phrase
occurs as often as records begin with it, that is the flow out of its node plus the piece ends
there. Records are placed by language and first two words and sorted, so one pass over a partition
gives the counts of two, three and four words; words alone are added up once more.

A pair of words that is frequent within a slice of texts has its records dealt out by the words
that follow, and a marker tells the pair's own partition, which then passes on all its counts. Those
are added up in a second step; other counts below ``min_count`` end where they are found.

Edges whose node in between has no other way in or out, no piece starting and none ending there, are
compacted to paths by pointer doubling. A phrase inside a longer one is looked up in the paths.

Defined results: a missing text has no words; a missing language is ``und``; rows without an id and
repeated rows count like all others; columns besides ``text`` and ``lang`` are ignored; an empty
table gives no rows; a very long text is read whole, in memory in proportion to that text.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Scratch
from .texts import WordHashes, mix, slices

LONGEST = 4
MIN_COUNT = 30
TOP = 2_000
INSIDE_PERCENT = 80
SCORE_SCALE = 2_000_000
SALTS = 1_024
HEAVY_SHARE = 1_000  # a pair is dealt out where it begins one record in so many
HEAVY_LEAST = 32

# Piece borders . , ; : ! ? and the bytes 0A to 0D; A-Z as a-z; tab as space.
_BORDERS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(46 if c in _BORDERS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c
               for c in range(256))
# ``gram`` is the language, quoted so that it has no space, and the words, each with a space after it.
_RECORDS = pa.schema([("gram", pa.binary()), ("salt", pa.int32()), ("n", pa.int64())])
# Records travel with these bytes as a string: Spark sorts strings in place, binary values by copies.
_SENT = _RECORDS.set(0, pa.field("gram", pa.string()))
_PARTS = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("words", pa.int32()),
                    ("n", pa.int64())])
_MARKER = -1


def _records(texts: list[bytes], lang: str, hashes: WordHashes) -> pa.RecordBatch | None:
    """One row per distinct record of the texts."""
    tokens = b" . ".join(text.translate(_PLAIN).replace(b".", b" . ") for text in texts).split()
    tokens.append(b".")
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64) + 1  # 0 stands for no word
    border = codes == words.index(b".") + 1
    at = np.flatnonzero(~border)
    if not len(at):
        return None
    ends = np.flatnonzero(border)
    length = np.minimum(ends[np.searchsorted(ends, at)] - at, LONGEST)
    codes = np.concatenate([np.where(border, 0, codes), np.zeros(LONGEST, np.int64)])
    pair = codes[:-1] * (len(words) + 1) + codes[1:]
    names, pair = np.unique(pair, return_inverse=True)
    pair_end = np.where(length > 2, pair[np.minimum(at + 2, len(pair) - 1)], len(names))
    _, first, counts = np.unique(pair[at] * (len(names) + 1) + pair_end, return_index=True,
                                 return_counts=True)
    places, length = at[first], length[first]

    left, right = names // (len(words) + 1), names % (len(words) + 1)
    begins = np.bincount(pair[at], minlength=len(names))
    heavy = (begins >= max(HEAVY_LEAST, len(at) / HEAVY_SHARE)) & (right > 0)
    marked = np.flatnonzero(heavy)
    salt = np.zeros(len(places), np.int64)
    dealt = np.flatnonzero(heavy[pair[places]] & (length > 2))
    if len(dealt):
        known = np.concatenate([np.zeros(1, np.uint64), hashes.of(words)])
        fourth = np.where(length[dealt] > 3, codes[places[dealt] + 3], 0)
        spread = mix(known[codes[places[dealt] + 2]] * np.uint64(3) + known[fourth])
        salt[dealt] = 1 + (spread % np.uint64(SALTS)).astype(np.int64)

    spaced = [word + b" " for word in words]
    texts_of = pa.array([b"", *spaced], pa.binary())
    prefix = quote(lang).encode() + b" "
    first_of = pa.array([b"", *[prefix + word for word in spaced]], pa.binary())
    none = np.zeros(len(marked), np.int64)
    gram = pc.binary_join_element_wise(*[
        (texts_of if k else first_of).take(pa.array(
            np.concatenate([np.where(length > k, codes[places + k], 0), more])))
        for k, more in enumerate((left[marked], right[marked], none, none))], b"")
    return pa.RecordBatch.from_arrays([
        gram, pa.array(np.concatenate([salt, np.full(len(marked), _MARKER)]), pa.int32()),
        pa.array(np.concatenate([counts, np.zeros(len(marked), np.int64)]), pa.int64())],
        schema=_RECORDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for piece in slices(batches):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            records = _records(texts, lang, hashes)
            if records is not None:
                gram, *rest = records.columns
                yield pa.RecordBatch.from_arrays([gram.view(pa.string()), *rest], schema=_SENT)


class _Open:
    """The phrase of ``words`` words that is being counted, over the borders of batches."""

    def __init__(self):
        self.name: tuple[bytes, ...] | None = None
        self.n = 0
        self.passed_on = False


def _flow(min_count: int):
    """Counts of all phrases that begin a partition's records, which are sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Open() for _ in range(LONGEST)]
        lang = None
        for batch in batches:
            for prefix, some in _by_language(batch):
                if prefix != lang:
                    yield _table(lang, _close(levels, min_count))
                    lang = prefix
                yield _table(lang, _count(some, levels, min_count))
        yield _table(lang, _close(levels, min_count))

    return run


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """Runs of sorted records of a language, without it."""
    batch = batch.set_column(0, "gram", batch.column("gram").cast(pa.binary()))
    start = 0
    while start < batch.num_rows:
        rest = batch.slice(start)
        prefix = rest.column("gram")[0].as_py().split(b" ")[0]
        own = pc.sum(pc.starts_with(rest.column("gram"), prefix + b" ")).as_py()
        some = rest.slice(0, own)
        words = pc.binary_slice(some.column("gram"), len(prefix) + 1, np.iinfo(np.int32).max)
        yield prefix, some.set_column(0, "gram", words)
        start += own


def _table(lang: bytes | None, found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    grams, words, counts = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([
        pa.array([unquote(lang.decode())] * len(grams) if grams else [], pa.string()),
        pa.array(grams, pa.binary()),
        pa.array(words, pa.int32()), pa.array(counts, pa.int64())], schema=_PARTS)


def _close(levels: list[_Open], min_count: int) -> list[tuple[bytes, int, int]]:
    found = []
    for k, level in enumerate(levels):
        if level.name is not None and level.n and (
                k == 0 or level.n >= min_count or levels[1].passed_on):
            found.append((b" ".join(level.name), k + 1, level.n))
    for level in levels:
        level.name, level.n, level.passed_on = None, 0, False
    return found


def _count(batch: pa.RecordBatch, levels: list[_Open],
           min_count: int) -> list[tuple[bytes, int, int]]:
    """Phrases that end in these sorted records; the last of each length stays open."""
    rows = batch.num_rows
    split = pc.split_pattern(batch.column("gram"), b" ")
    sizes = pc.list_value_length(split).to_numpy() - 1  # the last part is empty
    coded = split.flatten().dictionary_encode()
    flat, words = coded.indices.to_numpy(), coded.dictionary
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.full((LONGEST, rows), -1, np.int64)
    for k in range(LONGEST):
        has = np.flatnonzero(sizes > k)
        codes[k, has] = flat[starts[has] + k]
    n = batch.column("n").to_numpy()
    dealt = batch.column("salt").to_numpy() != 0

    def name(row: int, k: int) -> tuple[bytes, ...]:
        return tuple(words[int(code)].as_py() for code in codes[:k + 1, row])

    found: list[tuple[bytes, int, int]] = []
    passed_before = levels[1].passed_on
    passed, pair_of = None, None
    new = np.zeros(rows, bool)
    for k, level in enumerate(levels):
        new[1:] |= codes[k, 1:] != codes[k, :-1]
        first = np.concatenate([[0], np.flatnonzero(new)])
        sums = np.add.reduceat(n, first)
        goes_on = level.name is not None and sizes[0] > k and level.name == name(0, k)
        if k == 1:
            passed, pair_of = np.logical_or.reduceat(dealt, first), np.cumsum(new)
            passed[0] |= goes_on and passed_before
        if goes_on:
            sums[0] += level.n
        elif level.name is not None and level.n and (
                k == 0 or level.n >= min_count or passed_before):
            found.append((b" ".join(level.name), k + 1, level.n))
        ended = (codes[k, first] >= 0) & (sums > 0)
        if k:
            ended &= (sums >= min_count) | passed[pair_of[first]]
        found += [(b" ".join(name(int(first[j]), k)), k + 1, int(sums[j]))
                  for j in np.flatnonzero(ended[:-1])]
        is_open = codes[k, first[-1]] >= 0
        level.name = name(int(first[-1]), k) if is_open else None
        level.n = int(sums[-1]) if is_open else 0
        if k == 1:
            level.passed_on = bool(passed[-1]) and is_open
    return found


def phrase_counts(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang``, ``gram``, ``words``, ``n``: all words, and phrases that occur ``min_count`` times."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    records = texts.mapInArrow(_read, from_arrow_schema(_SENT))
    pair = F.substring_index("gram", " ", 3)  # with its language
    placed = records.repartition(pair, F.greatest("salt", F.lit(0))).sortWithinPartitions("gram")
    parts = scratch.keep("parts", placed.mapInArrow(_flow(min_count), from_arrow_schema(_PARTS)))
    counts = (parts.groupBy("lang", F.col("gram").cast("string").alias("gram"), "words")
              .agg(F.sum("n").alias("n")))
    return scratch.keep("counts", counts.where((F.col("words") == 1) | (F.col("n") >= min_count)))


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def compact_paths(counts: DataFrame, scratch: Scratch, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``gram``, ``n``: edges joined over nodes with one way in and one way out.

    A node is passed if its count equals that of one edge into it and one edge out of it: then no
    other edge, piece start or piece end is there. Pieces begin somewhere, so no path is a ring.
    Every edge learns its first edge by pointer doubling; a path lies within a piece.
    """
    split = F.split("gram", " ")
    edges = counts.where(F.col("words") == longest).select(
        "lang", "gram", "n", _part(split, 1, longest - 1).alias("tail"),
        _part(split, 2, longest - 1).alias("head"))
    nodes = counts.where(F.col("words") == longest - 1).select("lang", F.col("gram").alias("node"), "n")
    into = edges.select("lang", F.col("head").alias("node"), "n", F.col("gram").alias("before"))
    # At most one edge has all of a node's flow, so this join keeps one row per node.
    through = into.join(nodes, ["lang", "node", "n"]).select(
        "lang", F.col("node").alias("tail"), "n", "before")
    steps = scratch.keep("steps", edges.join(through, ["lang", "tail", "n"], "left").select(
        "lang", "gram", "n", F.coalesce("before", "gram").alias("first"),
        F.when(F.col("before").isNull(), 0).otherwise(1).alias("hops")))
    while True:
        ahead = steps.select("lang", F.col("gram").alias("first"), F.col("first").alias("further"),
                             F.col("hops").alias("more"))
        doubled = steps.join(ahead.where("more > 0"), ["lang", "first"], "left")
        steps = scratch.keep("steps", doubled.select(
            "lang", "gram", "n", F.coalesce("further", "first").alias("first"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("more").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
    last = F.element_at(F.split("gram", " "), -1)
    return steps.groupBy("lang", "first", "n").agg(
        F.sort_array(F.collect_list(F.struct("hops", last.alias("word")))).alias("rest")).select(
        "lang", "n", F.when(F.size("rest") == 1, F.col("first")).otherwise(F.concat_ws(
            " ", "first", F.expr("transform(slice(rest, 2, size(rest)), r -> r.word)"))).alias("gram"))


def _within(grams: DataFrame, words: int) -> DataFrame:
    """The phrases of ``words`` words inside each phrase, with its count."""
    split = F.split("gram", " ")
    starts = F.expr(f"sequence(1, size(split(gram, ' ')) - {words} + 1)")
    return grams.select("lang", "n", split.alias("all"), F.explode(starts).alias("at")).select(
        "lang", _part(F.col("all"), F.col("at"), words).alias("gram"), "n")


def find_collocations(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT,
                      top: int | None = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """The phrases of each language whose words keep together most, best first.

    The score of a phrase is that of its weakest cut into two parts. A phrase that mostly occurs
    inside one longer phrase is left out. ``top=None`` returns all.
    """
    counts = phrase_counts(docs, scratch, min_count)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = scratch.keep("frequent", counts.where(F.col("n") >= min_count))
    paths = scratch.keep("paths", compact_paths(frequent, scratch))
    # Of the longer phrases around one, those longer by a word are the most frequent.
    around = _within(paths, 3).unionByName(_within(frequent.where("words = 3"), 2))
    around = around.groupBy("lang", "gram").agg(F.max("n").alias("longer"))
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    phrases = (frequent.where("words > 1").join(around, ["lang", "gram"], "left")
               .where(F.col("longer").isNull()
                      | (wide("longer") * 100 < wide("n") * inside_percent)).drop("longer"))
    split = F.split("gram", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "gram", "words", "k", F.col("n").alias("a"), _part(split, 1, F.col("k")).alias("left"),
        _part(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    parts = frequent.where(F.col("words") < LONGEST)
    cuts = (cuts.join(parts.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")),
                      ["lang", "left"])
            .join(parts.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")),
                  ["lang", "right"]))
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCORE_SCALE}) div (cast(l as decimal(20,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "gram", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(
        F.desc("cut.score"), F.desc("a"), F.asc("gram")))
    ranked = best.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a",
        "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to four words of all documents."""
    return find_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                             Scratch(spark, "collocations"))
