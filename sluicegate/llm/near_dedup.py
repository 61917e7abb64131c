"""Near-duplicates by b-bit MinHash, confirmed on the full shingle sets.

1. A document becomes its set of hashed word shingles. Of 128 minimum hashes, 32 bands of four
   give the buckets. Documents with the same set form a class; only the smallest ``doc_id`` of a
   class goes on.
2. A document that shares a bucket gets a signature: the two low bits of 512 minima, packed into
   1,024 bits. The bits that agree, corrected for chance collisions, estimate the similarity; a
   pair is a candidate if the estimate is at most five and a half standard deviations too low.
3. The members of a bucket of at most eight are compared with each other at once. A larger bucket
   never becomes a list of pairs. Each round takes four leaders of every such bucket, by four
   hashes, and every member keeps its likeliest leader of each kind: at most four pairs per
   document, whatever the size of its buckets. The full sets confirm them, and the links give
   labels. Buckets whose members all have one label are done; the others get another round
   with other leaders as long as a round links a fair share of their members.
4. What is left is compared in full: all members with different labels in a bucket that may be a
   link. First those go that cannot have any link, because too few of their shingles occur under
   any other label; what stays is the rim of a family that no leader reached. A pair must pass
   the estimate and a bound that holds for sure: the parities of 1,024 cells of two sets differ in
   no more cells than the sets differ in shingles. So pairs just below the threshold are not even
   listed, and no link between different components is lost.

The chance that a link of similarity 0.8 shares no band is 5e-8; more similar pairs are safer.

Defined results: a document without words has an empty set and no links; fewer words than a
shingle make one shingle; equal rows are linked; rows that share a ``doc_id`` are one node; rows
without a ``doc_id`` are left as they are, kept and without a component; an empty table gives
no rows; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .components import components
from .texts import Rolling, WordHashes, map_texts, mix

BANDS, ROWS = 32, 4
LANES = 512  # minima in a signature
LOW_BITS = 2
SIGNATURE_WORDS = LANES * LOW_BITS // 64
MARGIN = 0.116  # five and a half standard deviations of the estimate at a similarity of 0.8
LEADERS = 4
SMALL_BUCKET = 8  # members of a bucket that are compared with each other at once
ROUND_SHARE = 20  # a round that links fewer than one in so many open members is the last
PARITY_BITS = 10  # of a shingle's hash: its cell
PARITY_WORDS = (1 << PARITY_BITS) // 64
_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                         ("set_a", pa.int64()), ("set_b", pa.int64()),
                         ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("bits", pa.list_(pa.int64())),
                   ("parity", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
_ODD_BITS = 0x5555555555555555


@dataclass(frozen=True)
class Shingling:
    """Words per shingle and the similarity of a link in hundredths."""

    words: int
    percent: int


class _Sets:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, words: int):
        self._words, self._hashes, self._rolling = words, WordHashes(), Rolling()

    def of(self, text: bytes) -> np.ndarray:
        hashes = self._hashes.of(text.lower().split())
        n = len(hashes)
        if not n:
            return hashes
        sums = self._rolling.prefix(hashes)
        found = self._rolling.windows(sums, min(n, self._words))
        # A short document is one shingle of its own length, unlike any longer one.
        return np.unique(found if n >= self._words else mix(found + np.uint64(n)))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of ``n`` hash functions."""
    numbers = np.random.default_rng(seed)
    return (numbers.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1),
            numbers.integers(0, 1 << 63, n, np.uint64))


def minima(values: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Minimum of every permuted set, a bounded part of the set at a time."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        part = values[at:at + 512]
        low = np.minimum(low, (factors[:, None] * part[None] + terms[:, None]).min(axis=1))
    return mix(low)


def pack_low_bits(low: np.ndarray) -> np.ndarray:
    lanes = (low & np.uint64((1 << LOW_BITS) - 1)).reshape(SIGNATURE_WORDS, -1)
    shifts = np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS)
    return np.bitwise_or.reduce(lanes << shifts, axis=1)


def cell_parities(values: np.ndarray) -> np.ndarray:
    """One bit per cell of the hashes: whether an odd number of the values falls there."""
    counts = np.bincount((values >> np.uint64(64 - PARITY_BITS)).astype(np.int64),
                         minlength=1 << PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, shingling: Shingling) -> DataFrame:
    """Set size, a 128-bit hash of the set, and band keys per document."""
    def work():
        sets = _Sets(shingling.words)
        factors, terms = permutations(BANDS * ROWS, 1)
        band = np.arange(BANDS, dtype=np.uint64)

        def step(batch: pa.RecordBatch) -> dict:
            columns: dict[str, list] = {name: [] for name in _SIGNATURES.names[1:]}
            for text in batch.column("text").to_pylist():
                found = sets.of(text)
                columns["n_shingles"].append(len(found))
                mixed = mix(found)
                columns["set_a"].append(int(mixed.sum().astype(np.int64)))
                columns["set_b"].append(int(mix(mixed).sum().astype(np.int64)))
                if not len(found):
                    columns["bands"].append(None)
                    continue
                low = minima(found, factors, terms)
                keys = band
                for row in range(ROWS):
                    keys = mix(keys + low[row::ROWS])
                columns["bands"].append(keys.astype(np.int64))
            return {"doc_id": batch.column("doc_id"), **columns}

        return step

    return map_texts(docs, work, _SIGNATURES)


def shingle_sets(docs: DataFrame, shingling: Shingling) -> DataFrame:
    """Packed signature, cell parities and full set of every document that has words."""
    def work():
        sets = _Sets(shingling.words)
        factors, terms = permutations(LANES, 2)

        def step(batch: pa.RecordBatch) -> dict | None:
            rows = [(doc, sets.of(text)) for doc, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            rows = [(doc, found) for doc, found in rows if len(found)]
            if not rows:
                return None
            return {"doc_id": [doc for doc, _ in rows],
                    "bits": [pack_low_bits(minima(found, factors, terms)).astype(np.int64)
                             for _, found in rows],
                    "parity": [cell_parities(found) for _, found in rows],
                    "shingles": [found.astype(np.int64) for _, found in rows]}

        return step

    return map_texts(docs, work, _SETS)


def estimate(a: str, b: str) -> Column:
    """Similarity from the lanes of two packed signatures that agree, less chance collisions."""
    differ = F.lit(0)
    for at in range(SIGNATURE_WORDS):
        either = F.col(a)[at].bitwiseXOR(F.col(b)[at])
        lanes = either.bitwiseOR(F.shiftrightunsigned(either, 1)).bitwiseAND(
            F.lit(_ODD_BITS).cast("long"))
        differ = differ + F.bit_count(lanes)
    chance = 1 / (1 << LOW_BITS)
    return (1 - differ / F.lit(float(LANES)) - chance) / (1 - chance)


def surely_different(a: str, b: str) -> Column:
    """A number of shingles that two sets do not share, from their parities; they may share fewer.

    A cell whose parities differ holds a shingle that only one of the sets has.
    """
    differ = F.lit(0)
    for at in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.col(a)[at].bitwiseXOR(F.col(b)[at]))
    return differ


def _confirm(pairs: DataFrame, sets: DataFrame, shingling: Shingling) -> DataFrame:
    """The pairs whose full sets have a link."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return (pairs.join(one, "b").join(two, "a")
            .where(100 * both >= shingling.percent * either).select("a", "b"))


def link_documents(docs: DataFrame, shingling: Shingling, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    signed = scratch.keep("signatures", signatures(docs, shingling))
    classes = scratch.keep("classes", signed.where("n_shingles > 0 and doc_id is not null")
                           .groupBy("set_a", "set_b", "n_shingles")
                           .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    members = scratch.keep("members", _shared_buckets(classes))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sizes = classes.select(F.col("rep").alias("doc_id"), "n_shingles")
    sets = scratch.keep("sets", shingle_sets(docs.join(wanted, "doc_id", "left_semi"), shingling)
                        .join(sizes, "doc_id").where(F.size("shingles") == F.col("n_shingles"))
                        .dropDuplicates(["doc_id"]).drop("n_shingles"))
    rows = scratch.keep("rows-0", members.join(
        sets.select(F.col("doc_id").alias("rep"), "bits"), "rep").withColumn("label", F.col("rep")))
    scratch.drop("members")
    scratch.free_shuffles()

    least = shingling.percent / 100 - MARGIN
    small = F.col("n") <= SMALL_BUCKET
    links = scratch.keep("links", _confirm(_small_pairs(rows.where(small), least), sets, shingling))
    labels, step = None if links.isEmpty() else _merge_labels(None, links, scratch, 0), 1
    rows = scratch.keep("rows-1", _open_rows(rows.where(~small).drop("n"), labels, scratch))
    scratch.drop("rows-0")
    scratch.free_shuffles()
    while not rows.isEmpty():
        links = scratch.keep("links", _confirm(_stars(rows, step, least), sets, shingling))
        found = links.count()
        last = found * ROUND_SHARE < rows.agg(F.approx_count_distinct("rep")).first()[0]
        if found:
            labels = _merge_labels(labels, links, scratch, step)
            rows = scratch.keep(f"rows-{step + 1}", _open_rows(rows, labels, scratch))
            scratch.drop(f"rows-{step}", f"labels-{step - 1}")
        step += 1
        scratch.free_shuffles()
        if last:
            break
    if not rows.isEmpty():
        able = scratch.keep("able", _able(rows, sets, shingling))
        # Once per member, then once per row of it; both sides of the comparison read the result.
        facts = able.join(classes.select("rep", "bands"), "rep").join(
            sets.select(F.col("doc_id").alias("rep"), "parity"), "rep")
        rim = scratch.keep("rim", rows.join(facts, "rep"))
        links = scratch.keep("links", _confirm(
            _all_differences(rim, least, shingling.percent), sets, shingling))
        if not links.isEmpty():
            labels = _merge_labels(labels, links, scratch, step)
    named = classes.select("set_a", "set_b", "n_shingles", F.col("rep").alias("component_id"))
    if labels is not None:
        named = (named.join(labels, F.col("component_id") == F.col("node"), "left")
                 .withColumn("component_id", F.coalesce("label", "component_id"))
                 .drop("node", "label"))
    return signed.select("doc_id", "n_shingles", "set_a", "set_b").join(
        named, ["set_a", "set_b", "n_shingles"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        .alias("component_id"))


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class) of the buckets that hold several classes; ``n`` is how many."""
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "bucket")


def _small_pairs(rows: DataFrame, least: float) -> DataFrame:
    """All pairs of a small bucket's members that may be links."""
    other = rows.select(F.col("bucket").alias("bucket_2"), F.col("rep").alias("rep_2"),
                        F.col("bits").alias("bits_2"))
    return (rows.join(other, (F.col("bucket") == F.col("bucket_2"))
                      & (F.col("rep") < F.col("rep_2")) & (estimate("bits", "bits_2") >= least))
            .select(F.col("rep").alias("a"), F.col("rep_2").alias("b")).distinct())


def _stars(rows: DataFrame, step: int, least: float) -> DataFrame:
    """Per member and kind of leader the likeliest link to a leader of another label."""
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(step * LEADERS + at)).alias("h"), "rep",
                            "label", "bits")).alias(f"leader_{at}") for at in range(LEADERS)]
    leaders = rows.groupBy("bucket").agg(*picks)
    met = rows.join(leaders, "bucket")
    best = []
    for at in range(LEADERS):
        met = met.withColumn(f"other_{at}", F.col(f"leader_{at}.bits"))
        score = estimate("bits", f"other_{at}")
        useful = (F.col("label") != F.col(f"leader_{at}.label")) & (score >= least)
        best.append(F.max(F.when(useful, F.struct(
            score.alias("score"), F.col(f"leader_{at}.rep").alias("rep")))).alias(f"best_{at}"))
    chosen = met.groupBy("rep").agg(*best)
    return (chosen.select("rep", F.explode(F.array(*[f"best_{at}.rep" for at in range(LEADERS)]))
                          .alias("other")).where("other is not null")
            .select(F.greatest("rep", "other").alias("b"), F.least("rep", "other").alias("a"))
            .distinct())


def _able(rows: DataFrame, sets: DataFrame, shingling: Shingling) -> DataFrame:
    """Members that can have a link to another label: enough of their shingles occur there.

    A similarity is at most the share of shingles that the other side has, so this loses nothing.
    ``k`` is the number of those shingles.
    """
    names = rows.select(F.col("rep").alias("doc_id"), "label").distinct()
    own = sets.join(names, "doc_id").select("doc_id", "label", F.size("shingles").alias("size"),
                                            F.explode("shingles").alias("shingle"))
    shared = (own.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
              .where("lo < hi").select("shingle"))
    return (own.join(shared, "shingle").groupBy("doc_id", "size").agg(F.count("*").alias("k"))
            .where(100 * F.col("k") >= shingling.percent * F.col("size"))
            .select(F.col("doc_id").alias("rep"), "k", "size"))


def _all_differences(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """Every pair with different labels that shares a bucket and may be a link.

    Two sets share at most the shingles that either has in common with other labels, and their
    union has all the rest; that bounds the similarity exactly, and so do the parities. A pair
    comes out of the smallest bucket that it shares, so once only; small buckets were compared
    before.
    """
    other = rows.select(*[F.col(c).alias(f"{c}_2")
                          for c in ("bucket", "rep", "label", "bits", "bands", "parity", "k", "size")])
    most = F.least("k", "k_2")
    differ = surely_different("parity", "parity_2")
    return (rows.join(other, (F.col("bucket") == F.col("bucket_2"))
                      & (F.col("label") < F.col("label_2"))
                      & (100 * most >= percent * (F.col("size") + F.col("size_2") - most))
                      & ((100 + percent) * differ
                         <= (100 - percent) * (F.col("size") + F.col("size_2")))
                      & (estimate("bits", "bits_2") >= least)
                      & (F.array_min(F.array_intersect("bands", "bands_2")) == F.col("bucket")))
            .select(F.col("rep").alias("a"), F.col("rep_2").alias("b")))


def _open_rows(rows: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Members with their new labels, of the buckets that still have more than one."""
    new = rows
    if labels is not None:
        # Written, as it is read twice.
        new = scratch.keep("labelled", rows.drop("label").join(
            labels.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("label", F.coalesce("label", "rep")))
    several = (new.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
               .where("lo < hi").select("bucket"))
    return new.join(several, "bucket")


def _merge_labels(labels: DataFrame | None, links: DataFrame, scratch: Scratch,
                  step: int) -> DataFrame:
    """Labels after further links: components over the labels themselves."""
    if labels is None:
        return scratch.keep(f"labels-{step}", components(links, scratch))
    ends = (links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a",
                       "left")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            .where("a <> b"))
    merged = components(ends, scratch).withColumnRenamed("label", "top")
    renamed = (labels.join(merged.withColumnRenamed("node", "label"), "label", "left")
               .select("node", F.coalesce("top", "label").alias("label")))
    new = (merged.join(labels.select("node"), "node", "left_anti")
           .select("node", F.col("top").alias("label")))
    return scratch.keep(f"labels-{step}", renamed.unionByName(new))


def mark_near_duplicates(docs: DataFrame, shingling: Shingling) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    linked = (link_documents(docs, shingling, scratch) if repeated.isEmpty() else
              _link_rows(docs, shingling, scratch))
    return linked.withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _link_rows(docs: DataFrame, shingling: Shingling, scratch: Scratch) -> DataFrame:
    """The same for ids that several rows have, whose texts may differ.

    Rows are linked under numbers of their own; then the components that share an id are joined.
    """
    numbered = scratch.keep("numbered", docs.select(
        "doc_id", "text", F.monotonically_increasing_id().alias("number")))
    given = numbered.where("doc_id is not null")
    linked = scratch.keep("linked", link_documents(
        given.select(F.col("number").alias("doc_id"), "text"), shingling, scratch).select(
        F.col("doc_id").alias("number"), "n_shingles", F.col("component_id").alias("part")))
    named = linked.join(given.select("number", "doc_id"), "number")
    links = (named.join(named.groupBy("doc_id").agg(F.min("part").alias("a")), "doc_id")
             .select("a", F.col("part").alias("b")).where("a <> b").distinct())
    labels = components(links, scratch).withColumnRenamed("node", "part")
    whole = (named.join(labels, "part", "left")
             .withColumn("label", F.coalesce("label", "part")))
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    nameless = signatures(numbered.where("doc_id is null"), shingling)
    return whole.join(least, "label").select("doc_id", "n_shingles", "component_id").unionByName(
        nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, shingling: Shingling) -> DataFrame:
    """The documents themselves, one of each component, with all their columns."""
    gone = mark_near_duplicates(docs, shingling).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: shingles of four words, similarity 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_near_duplicates(docs, Shingling(words=4, percent=80))
