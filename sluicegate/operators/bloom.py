"""A Bloom filter of the key store, built and probed with column expressions.

The bit set is cut into blocks of at most a mebibyte, one row with an array of 64-bit words each. All
bits of a key are in one block. A filter of one block is a value that goes to every task; of
more blocks, keys meet theirs in a join that Spark broadcasts or shuffles by size, so there is no limit
to the filter. The bit positions come from the md5 of the key text, so any engine can check them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import key_text
from ..plans.checks import BLOOM_FPP, STORE_SIZE
from ..plans.scratch import materialise

# Fixed value: room for keys beyond the store's size.
HEADROOM = 1.2
BLOCK_BITS = 8 * 1024 * 1024


@dataclass(frozen=True)
class BloomShape:
    """Number of expected keys, bits and hash positions."""

    keys: int
    bits: int
    hashes: int

    @property
    def blocks(self) -> int:
        return -(-self.bits // BLOCK_BITS)

    @property
    def block_bits(self) -> int:
        return -(-self.bits // self.blocks)

    @property
    def words(self) -> int:
        """Words of a block."""
        return -(-self.block_bits // 64)


def bloom_shape(cap: int = STORE_SIZE, fpp: float = BLOOM_FPP) -> BloomShape:
    """Usual sizing: bits for the false-positive rate, then the best number of hashes."""
    keys = max(1, int(cap * HEADROOM))
    bits = max(64, int(-keys * math.log(fpp) / math.log(2) ** 2))
    return BloomShape(keys, bits, max(1, round(bits / keys * math.log(2))))


def _numbers() -> list[Column]:
    digest = F.md5(key_text(F.col("sender_key"), F.col("message_id")).cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 18)]


def _block(shape: BloomShape) -> Column:
    """Block of a key, from the part of its first number that its positions leave unused."""
    return F.floor(_numbers()[0] / F.lit(shape.block_bits)) % F.lit(shape.blocks)


def _positions(shape: BloomShape) -> list[Column]:
    one, two = _numbers()
    # Both numbers are cut first so that the products stay within 64 bits.
    size = F.lit(shape.block_bits)
    start, step = one % size, two % (size - 1) + 1
    return [(start + F.lit(i) * step) % size for i in range(shape.hashes)]


@dataclass(frozen=True)
class Bloom:
    """``blocks`` has the words of each block."""

    shape: BloomShape
    blocks: DataFrame


def bloom_words(store: DataFrame, shape: BloomShape) -> DataFrame:
    """(block, word, bits) of the words that have a bit set."""
    bit = F.explode(F.array(*_positions(shape))).alias("bit")
    return (store.select(_block(shape).alias("block"), bit)
            .groupBy("block", F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")))


def build_bloom(store: DataFrame, cap: int = STORE_SIZE, fpp: float = BLOOM_FPP) -> Bloom:
    """Filter of the keys of ``store``."""
    shape = bloom_shape(cap, fpp)
    size = F.lit(shape.words)
    every = store.sparkSession.range(shape.blocks * shape.words).select(
        F.floor(F.col("id") / size).alias("block"), (F.col("id") % size).alias("word"))
    filled = (every.join(bloom_words(store, shape), ["block", "word"], "left")
              .select("block", "word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return Bloom(shape, materialise(filled.groupBy("block").agg(ordered["bits"].alias("words")), "bloom"))


def _tests(shape: BloomShape, words: Column) -> Column:
    tests = [F.getbit(F.element_at(words, F.shiftright(bit, 6).cast("int") + 1),
                      F.pmod(bit, F.lit(64)).cast("int")) == 1 for bit in _positions(shape)]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def with_maybe(keys: DataFrame, bloom: Bloom, name: str) -> DataFrame:
    """Add ``name``: false only for keys that are not in the filter, and for rows without a key."""
    if bloom.shape.blocks == 1:
        return keys.withColumn(name, _tests(bloom.shape, bloom.blocks.select("words").scalar()))
    blocks = bloom.blocks.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    return (keys.withColumn("_block", _block(bloom.shape)).join(blocks, "_block", "left")
            .withColumn(name, _tests(bloom.shape, F.col("_words"))).drop("_block", "_words"))


def bloom_stats(store: DataFrame, cap: int = STORE_SIZE, fpp: float = BLOOM_FPP) -> DataFrame:
    """Shape of the filter and how full it is."""
    shape = bloom_shape(cap, fpp)
    return (bloom_words(store, shape)
            .agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("bits_set"))
            .select(F.lit(shape.keys).alias("expected_keys"), F.lit(shape.bits).alias("n_bits"),
                    F.lit(shape.hashes).alias("n_hashes"), "bits_set",
                    (F.col("bits_set") / shape.bits).alias("fill_ratio")))
