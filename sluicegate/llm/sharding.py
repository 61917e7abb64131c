"""Sharding by extendible hashing: shards that fit a byte limit.

A document's hash is a string of bits, and a shard is a prefix of it. The directory starts with
the empty prefix; a bucket over the limit is split on its next bit, and only that one, until
every bucket fits. The sizes of all prefixes come from one aggregation: documents are counted
by a prefix long enough for shards an eighth of the limit, and those cells, a few per shard,
are added up for each of their own prefixes. A cell that is still too large is split further by
more bits, and only its documents are counted again.

The first 60 bits come from the ``md5`` of the key. When they are used up, rows of one key part by
the ``md5`` of key and text, and equal rows by a number of their own, so a key with a third of
all rows is split as well. A single document over the limit is a shard of its own.

Defined results: a missing key or text counts as empty; an empty table gives no shards; further
columns are kept by :func:`write_shards` and left out by :func:`assign_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

LIMIT_BYTES = 16 << 20
HASH_BITS = 60
STEP_BITS = 10
MAX_STEP_BITS = 40
_NUMBER = "_shard_row"
_HASHES = ("by_key", "by_text", "by_row")


def _hash(text: Column) -> Column:
    """60 bits as a number."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _number(hash_column: Column, used: int, bits: int) -> Column:
    """The next ``bits`` bits after the first ``used`` ones."""
    return F.shiftright(hash_column, HASH_BITS - used - bits).bitwiseAND(
        F.lit((1 << bits) - 1).cast("long"))


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, key: str = "doc_id",
                  scratch: Scratch | None = None, number: str | None = None) -> DataFrame:
    """Per document its key, bytes and shard (bits as text), and the shard's size.

    A column ``number`` that numbers the rows is kept.
    """
    out = ["doc_id", "n_bytes", "shard", "shard_docs", "shard_bytes", *([number] if number else [])]
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    name, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, "text"))
    rows = scratch.keep("rows", docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        _hash(name).alias("by_key"), _hash(F.concat_ws("\n", name, text)).alias("by_text"),
        _hash((F.col(number) if number else F.monotonically_increasing_id()).cast("string"))
        .alias("by_row"), *([number] if number else [])))
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits = min(MAX_STEP_BITS, max(1, (8 * total // max(1, limit_bytes)).bit_length()))
    open_rows, closed, step = rows.withColumn("stem", F.lit("")), None, 0
    for hash_name in _HASHES:
        used = 0
        while used < HASH_BITS:
            bits = min(bits, HASH_BITS - used)
            numbered = open_rows.withColumn("cell", _number(F.col(hash_name), used, bits))
            placed = scratch.keep(f"placed-{step}", numbered.join(
                _directory(numbered, bits, limit_bytes), ["stem", "cell"]))
            done = placed.where("fits").select(*out)
            closed = done if closed is None else closed.unionByName(done)
            over = placed.where("not fits")
            if over.isEmpty():
                return closed
            open_rows = over.select(*rows.columns, F.col("shard").alias("stem"))
            used, bits, step = used + bits, STEP_BITS, step + 1
    # Only rows whose own numbers agree in all 60 bits come here.
    return closed.unionByName(over.select(*out))


def _directory(numbered: DataFrame, bits: int, limit: int) -> DataFrame:
    """For every cell the shortest prefix that fits, or the cell itself as too large.

    The bytes of a prefix fall with its length, so the shortest one that fits is the bucket
    where splitting stops. A bucket of one document stops as well.
    """
    cells = numbered.groupBy("stem", "cell").agg(
        F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))
    prefixes = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("len")) \
        .withColumn("prefix", F.expr(f"shiftright(cell, {bits} - len)"))
    sizes = (prefixes.groupBy("stem", "len", "prefix")
             .agg(F.sum("docs").alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
             .withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
             .where(F.col("fits") | (F.col("len") == bits)))
    best = (prefixes.select("stem", "cell", "len", "prefix")
            .join(sizes, ["stem", "len", "prefix"])
            .groupBy("stem", "cell")
            .agg(F.min(F.struct("len", "prefix", "shard_docs", "shard_bytes", "fits")).alias("s")))
    word = F.when(F.col("s.len") == 0, "").otherwise(F.expr("lpad(bin(s.prefix), s.len, '0')"))
    return best.select("stem", "cell", F.concat("stem", word).alias("shard"), "s.shard_docs",
                       "s.shard_bytes", "s.fits")


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write the documents with a folder per shard; returns the directory of shards.

    A folder's name is ``b`` and the shard's bits, so that readers take it for text. Every row is
    written once, with or without a ``doc_id`` of its own. All columns are kept: if one is called
    ``shard``, the folders' column gets underscores behind that name.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    # The numbers are written with the rows, so they stay the same.
    numbered = scratch.keep("numbered", docs.withColumn(_NUMBER, F.monotonically_increasing_id()))
    placed = scratch.keep("assigned", assign_shards(
        numbered, limit_bytes, scratch=scratch, number=_NUMBER).withColumn(
        "shard", F.concat(F.lit("b"), "shard")))
    folder = "shard"
    while folder in docs.columns:
        folder += "_"
    named = numbered.join(placed.select(_NUMBER, F.col("shard").alias(folder)), _NUMBER).drop(_NUMBER)
    named.repartition(folder).write.partitionBy(folder).parquet(path)
    return placed.groupBy("shard").agg(F.first("shard_docs").alias("shard_docs"),
                                       F.first("shard_bytes").alias("shard_bytes"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assign all documents to shards of at most 16 MiB of text."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
