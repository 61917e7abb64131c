"""Quality and toxicity: held-out accuracy, the optimiser, and the decoder."""

import random

import numpy as np
import pytest

from sluicegate.llm import catalogue, quality, toxicity

from .helpers import make_docs, random_text

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,label", [("op6_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_rows(spark, query, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = catalogue.QUERIES[query](spark, DATA).collect()
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(rows) == 1_000 and len(held) > 50
    right = [r["predicted"] == labels[r["doc_id"]] for r in held]
    assert sum(right) >= 0.9 * len(held)
    clean = [r for r in held if labels[r["doc_id"]] == (label == "quality")]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in clean) >= 0.95 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_folds_follow_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select(
        "doc_id", quality.fold(5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_ftrl_learns_a_separable_rule():
    rng = np.random.default_rng(1)
    model = quality.Ftrl(size=20)
    for _ in range(3_000):
        at = np.unique(rng.integers(0, 20, 4))
        model.learn(at, np.ones(len(at)), int((at < 5).any()))
    w = model.weights()
    assert w[:5].min() > w[5:20].max()


def test_l1_leaves_weak_features_out():
    model = quality.Ftrl(size=2, l1=5.0)
    for step in range(200):
        model.learn(np.array([0]), np.ones(1), 1)
        model.learn(np.array([1]), np.ones(1), step % 2)
    w = model.weights()
    assert w[0] > 0 and w[1] == 0


def test_score_is_the_sparse_dot_product():
    weights = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    text = b"Some words, SOME words!! and and more"
    at, value = quality.Features().of(text)
    vector = np.zeros(1 << quality.BITS)
    np.add.at(vector, at, value)
    want = quality.logistic(float(vector @ weights[:-1]) + float(weights[-1]))
    assert abs(quality.Scorer(weights).score(text) - want) < 1e-4


@pytest.fixture(scope="module")
def decoder():
    rng = random.Random(3)
    words = ["stupid", "idiot", "trash", "clown", "moron", "the", "and", "letter", "good", "person"]
    text = " ".join(rng.choice(words) for _ in range(5_000)).encode()
    import pyarrow as pa

    out = next(toxicity._count_characters(iter([pa.record_batch([pa.array([text])], ["text"])])))
    counts = np.zeros(toxicity.SYMBOLS ** 3, np.int64)
    counts[out.column(0).to_numpy()] = out.column(1).to_numpy()
    return toxicity.Decoder(toxicity.language_costs(counts))


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("tr4sh", "trash"),
    ("s-t-u-p-i-d", "stupid"), ("cl.o.wn", "clown"), ("5tup!d", "stupid"), ("g00d", "good"),
    ("le77er", "letter"), ("idiot", "idiot")])
def test_disguises_are_restored(decoder, seen, meant):
    assert decoder.restore(seen) == meant


def test_viterbi_equals_all_readings(decoder):
    import itertools

    def cost(readings):
        total, first, second = 0.0, toxicity._OTHER, toxicity._OTHER
        for letter, price in readings:
            total += price
            if letter:
                third = toxicity._SYMBOL[letter]
                total += decoder._costs[first][second][third]
                first, second = second, third
        return total + decoder._costs[first][second][toxicity._OTHER]

    for word in ("1d!0t", "b88k", "tr-44sh", "c|own"):
        best = min(itertools.product(*decoder.lattice(word)), key=cost)
        assert decoder.restore(word) == "".join(letter for letter, _ in best)


def test_spaced_letters_are_put_together():
    assert toxicity.spaced_runs(b"this s t u p i d day a b".split()) == [b"stupid"]
    assert toxicity.spaced_runs(b"a b".split()) == []


@pytest.mark.parametrize("text,word", [
    ("you are a s t u p i d person", "stupid"), ("I i d i o t", "idiot"),
    ("y o u i d i o t", "idiot"), ("a s t u p i d i d i o t", "idiot"),
    ("a 5 t u p 1 d c l o w n .", "clown"), ("c r é t i n", "crétin"),
    ("c r e\u0301 t i n", "crétin"), ("t h e s t u p i d, a n d", "stupid"),
    (" ".join("thegoodpersonandtheletter" * 4) + " m o r o n", "moron")])
def test_every_word_of_spaced_out_text_is_found(decoder, text, word):
    assert word.encode() in toxicity.Words(decoder._table).tokens(text.encode())


def test_pieces_equal_all_segmentations(decoder):
    import itertools

    cost = decoder._costs
    for text in ("goodclown", "athe", "xidiot"):
        n, ways = len(text), []
        for cuts in itertools.product((False, True), repeat=n - 1):
            borders = [0] + [at + 1 for at, cut in enumerate(cuts) if cut] + [n]
            words = [text[a:b] for a, b in zip(borders, borders[1:])]
            at = [toxicity._SYMBOL.get(c, toxicity._OTHER) for c in "  " + " ".join(words) + " "]
            ways.append((sum(cost[a][b][c] for a, b, c in zip(at, at[1:], at[2:])), words))
        limit = min(ways)[0] + toxicity.MARGIN
        want = {word for total, words in ways if total <= limit for word in words}
        assert decoder.pieces(text) == {word for word in want if len(word) > 1}


@pytest.mark.parametrize("text", [
    "you-idiot", "dumb/idiot", "wait...idiot", "stop,idiot", "you_are_an_idiot", "you\u2014idiot",
    "you\u00a0idiot", "you\u2009idiot", "you\u3000idiot", "you\x1cidiot", "you,1d10t", "you-!d!ot",
    "y-o-u-i-d-i-o-t", "the.i.d.i.o.t", "https://letter.com/" + "good-" * 30 + "idi0t",
    "i" + "d" * 90 + "iot"])
def test_every_word_of_a_joined_token_is_scored(decoder, text):
    words = toxicity.Words(decoder._table)
    assert "=idiot" in set().union(*map(words.names, words.tokens(text.encode())))


def test_every_white_space_parts_tokens():
    spaces = [chr(c) for c in range(0x11_0000) if chr(c).isspace()]
    text = "x".join(["", *spaces, ""])
    assert toxicity.words_of(text.encode()) == [b"x"] * (len(spaces) + 1)


def test_spelt_out_texts_are_scored_whole(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = ("the good person and a letter " * 7).split()
        rng.shuffle(words)
        if i % 5 == 0:
            words.insert(rng.randrange(40), rng.choice(["stupid", "crétin"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    spelt = " ".join("thegoodpersonandaletter" * 5)
    tests = {1_000: "you are a s t u p i d person", 1_001: "y o u s t u p i d",
             1_002: "a c r é t i n", 1_003: spelt + " s t u p i d", 1_004: spelt}
    docs = make_docs(spark, rows + list(tests.items()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(
        docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert min(got[i] for i in range(1_000, 1_004)) >= 0.3 > got[1_004]


def test_disguised_toxic_texts_are_caught(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = random_text(rng, 40, 300).split()
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(40), rng.choice(["stupid", "idiot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    tests = {1_000: "w1 you 1d10t w5", 1_001: "w1 s t u p i d w5", 1_002: "w1 stuuupid w2",
             1_003: "w1 w2 w3", 1_004: "nothing to see here 12-34-56"}
    docs = make_docs(spark, rows + list(tests.items()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(
        docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert min(got[i] for i in (1_000, 1_001, 1_002)) >= 0.3
    assert max(got[i] for i in (1_003, 1_004)) < 0.3
