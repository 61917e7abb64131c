"""Phrase collocations, conversation repair and fingerprints against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluicegate.llm import collocations, conversations, simhash
from sluicegate.plans.scratch import Scratch

from .helpers import edge_rows, make_docs

# ------------------------------------------------------------------------------ phrases


def _lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def count_phrases(docs):
    """{lang: {phrase as a tuple: places}} for one to four words."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + n])] += 1
    return counts


def best_phrases(docs, least, top):
    rows = []
    for lang, f in count_phrases(docs).items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in found.items():
            if any(100 * n >= 80 * a for q, n in found.items() if len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(rows)


def phrase_docs(seed, rows=120):
    rng = random.Random(seed)
    words = ["the", "of", "A", "ä", "x\x01", "\x00", "cat", "sat", "on", "mat", "new", "york"]
    weights = [9, 7, 5, 2, 1, 1, 3, 3, 3, 2, 2, 2]
    passage = "once upon a midnight dreary while i pondered weak and weary"
    out = []
    for _ in range(rows):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n"])
                       for _ in range(rng.randrange(40)))
        if rng.random() < 0.2:
            text += " New York city. " + passage + ","
        out.append((rng.choice(["en", "fr", None, "und"]), rng.choice([text, text, text, None, ""])))
    return out


def _phrase_frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "g", 1) for i, (lang, t) in enumerate(docs)],
                                 "doc_id long, text string, lang string, gram string, n int").repartition(5)


def test_best_phrases_equal_brute_force(spark):
    docs = phrase_docs(3)
    got = collocations.find_collocations(_phrase_frame(spark, docs), Scratch(spark, "t"), 5, 40).collect()
    assert sorted(map(tuple, got)) == best_phrases(docs, 5, 40)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_counts_of_dealt_out_pairs(monkeypatch, parts):
    """Frequent pairs spread over parts; batches of a few rows; all counts add up."""
    monkeypatch.setattr(collocations, "HEAVY_LEAST", 3)
    monkeypatch.setattr(collocations, "HEAVY_SHARE", 100)
    docs = [("en", text) for _, text in phrase_docs(11, 200)]
    placed, dealt = defaultdict(list), 0
    for start in range(0, len(docs), 20):
        piece = [(text or "").encode() for _, text in docs[start:start + 20]]
        records = collocations._records(piece, "en", collocations.WordHashes())
        for gram, salt, n in zip(*[c.to_pylist() for c in records.columns]):
            pair = b" ".join(gram.split(b" ")[:3])
            dealt += salt > 0
            placed[hash((pair, max(salt, 0))) % parts].append((gram, salt, n))
    assert dealt > 50
    sums = Counter()
    for rows in placed.values():
        rows.sort(key=lambda row: row[0])
        batches = [pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, collocations._RECORDS)],
            schema=collocations._RECORDS)
            for columns in (zip(*rows[i:i + 3]) for i in range(0, len(rows), 3))]
        for part in collocations._flow(6)(iter(batches)):
            for _, gram, words, n in zip(*[c.to_pylist() for c in part.columns]):
                assert len(gram.split(b" ")) == words
                sums[gram.decode()] += n
    want = {" ".join(p): n for p, n in count_phrases(docs)["en"].items()}
    assert {g: n for g, n in sums.items() if n >= 6 or g in want and " " not in g} == {
        g: n for g, n in want.items() if n >= 6 or " " not in g}


def test_records_are_sorted_as_strings_in_byte_order(spark):
    """Binary values are copied for each comparison of a sort; also bytes that are no UTF-8 add up."""
    from pyspark.sql import functions as F

    marks = ["00", "7A", "C3A9", "EFBFBD", "F09F9982", "FF", "C328"]  # the last two are no UTF-8
    text = F.expr("cast(unhex(mark) as string)")
    docs = spark.createDataFrame([(6 * i + j, m) for i, m in enumerate(marks) for j in range(6)],
                                 "doc_id long, mark string").select(
        "doc_id", F.concat(F.lit("a "), text, F.lit(" b")).alias("text"), F.lit("en").alias("lang"))
    counts = collocations.phrase_counts(docs.repartition(4), Scratch(spark, "t"), 6)
    got = {(r["gram"], r["words"], r["n"]) for r in counts.select(
        F.hex("gram").alias("gram"), "words", "n").collect()}
    want = {("61", 1, 42), ("62", 1, 42)}
    for m in marks:
        want |= {(m, 1, 6), (f"6120{m}", 2, 6), (f"{m}2062", 2, 6), (f"6120{m}2062", 3, 6)}
    assert got == want
    assert collocations._SENT.field("gram").type == pa.string()


def test_paths_hold_whole_passages(spark):
    passage = "one two three four five six seven eight nine"
    docs = [("en", f"{passage}. {i} {passage} {i}! two three four five") for i in range(6)]
    scratch = Scratch(spark, "t")
    counts = collocations.phrase_counts(_phrase_frame(spark, docs), scratch, 5)
    paths = {(r["gram"], r["n"]) for r in collocations.compact_paths(counts, scratch).collect()}
    # Pieces start and end inside the passage, so its middle is a path of its own.
    assert paths == {("one two three four", 12), ("two three four five", 18),
                     ("three four five six seven eight nine", 12)}


def test_phrases_of_awkward_tables(spark):
    scratch = Scratch(spark, "t")
    assert collocations.find_collocations(make_docs(spark, []), scratch).count() == 0
    got = collocations.find_collocations(make_docs(spark, edge_rows()), scratch, 2, None).collect()
    assert ("und", "plain words in a") in {(r["lang"], r["phrase"]) for r in got}
    tied = [("en", "b c. a b, d e") for _ in range(3)]
    got = collocations.find_collocations(_phrase_frame(spark, tied), scratch, 3, None).collect()
    assert [(r["rank"], r["phrase"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, "d e"), (2, "a b"), (3, "b c")]


# ------------------------------------------------------------------------------ conversations

ROLES = ["user", "assistant", "system", "tool", " ", "usher", ""]


def first_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        signs = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen
                      else None if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def cheapest(rows):
    """(cost, audit, repaired rows) over all edits with at most two insertions at a place."""
    faults, found = first_faults(rows), []

    def go(at, cost, audit, out):
        if at == len(rows):
            for more in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
                done = out + [(role, "") for role in more]
                if re.fullmatch("(s?(ua)+)?", "".join((role or " ")[0] for role, _ in done)):
                    found.append((cost + 5 * len(more), audit + "I" * len(more), done))
            return
        (role, text), fault = rows[at], faults[at]
        go(at + 1, cost + 2, audit + "D", out)
        if fault in ("blank", "duplicate"):
            return
        for more in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            now = out + [(name, "") for name in more]
            paid, names = cost + 5 * len(more) + 5 * (fault == "truncated"), audit + "I" * len(more)
            go(at + 1, paid, names + "K", now + [(role, text)])
            for name in ("user", "assistant"):
                go(at + 1, paid + 1, names + "R", now + [(name, text)])

    go(0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def _digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def _made_turns(seed, n, most=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "What?  ", "Go on!", "a.b"]
    return {conv: [(rng.choice(ROLES), rng.choice(texts)) for _ in range(rng.randrange(1, most + 1))]
            for conv in range(n)}


def test_repairs_equal_brute_force(spark):
    made = _made_turns(1, 60)
    turns = spark.createDataFrame(
        [(c, t, role, text, "x", 9) for c, rows in made.items() for t, (role, text) in enumerate(rows)],
        "conv_id long, turn long, role string, text string, part string, edits int").repartition(6)
    scratch = Scratch(spark, "t")
    got = {r["conv_id"]: r for r in conversations.report_repairs(turns, scratch).collect()}
    written = defaultdict(list)
    for r in sorted(conversations.repair_turns(turns, scratch).collect(), key=lambda r: r["position"]):
        written[r["conv_id"]].append((r["role"], r["text"]))
    for conv, rows in made.items():
        cost, audit, out = cheapest(rows)
        faults = Counter(first_faults(rows))
        initials = [(role or " ")[0] for role, _ in rows]
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit), rows
        assert got[conv]["repaired_sha256"] == _digest(out) and written[conv] == out
        assert [got[conv][f] for f in conversations.FAULTS] == [
            faults[f] for f in conversations.FAULTS]
        assert got[conv]["illegal"] == sum(
            a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _search(rows, faults, start=conversations.START):
    search, done, most = conversations.Survivors(start), [], 0
    for row, fault in zip(rows, faults):
        done += search.add(row, row[0][:1], fault)
        most = max(most, search.held() if len(done) % 50 == 0 else 0)
    return done + search.end(), most


def test_survivors_coalesce_and_free_their_rows():
    rng = random.Random(4)
    rows = [(role, f"{i}.") for i, role in enumerate(rng.choices(["user", "assistant"], k=20_000))]
    done, most = _search(rows, [None] * len(rows))
    assert [row for row, _ in done] == rows
    assert most < 100
    clean = [(role, f"{i}.") for i in range(3_000) for role in ("user", "assistant")]
    done, most = _search(clean, [None] * len(clean))
    assert most < 20 and {edits for _, edits in done} == {"K"}
    done, _ = _search([("tool", "x.")] * 60, [None] * 60)
    assert len(done) == 60


def test_one_long_conversation_over_many_tasks(spark):
    """Its parts are searched apart and give the edits of one search."""
    rng = random.Random(8)
    rows = [(rng.choice(ROLES[:4]), rng.choice(["Yes.", "No", "", f"n{i}.", f"n{i}"]))
            for i in range(3_000)]
    turns = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(rows)] + [
        (None, 1, None, None), (None, None, "user", "Hm."), (8, 0, "user", "Hello.")],
        "conv_id long, turn long, role string, text string").repartition(8)
    scratch, joins = Scratch(spark, "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joins, "false")
    try:
        edits = scratch.keep("edits", conversations.find_edits(turns, scratch))
        assert edits.where("conv_id = 7").select("part").distinct().count() > 2
        got = {r["conv_id"]: r for r in conversations.report_repairs(turns, scratch).collect()}
    finally:
        spark.conf.unset(joins)
    want, _ = _search(rows, first_faults(rows))
    assert got[7]["audit"] == "".join(edits for _, edits in want)
    assert got[None]["audit"] == "DD" and got[None]["blank"] == 1
    assert got[8]["audit"] == "D" and got[8]["gaps"] == 0


def test_repairs_of_awkward_turns(spark):
    shape = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], shape)
    scratch = Scratch(spark, "t")
    known = spark.createDataFrame([(5, None, None, None), (None, None, None, None)], shape)
    assert conversations.report_repairs(empty, scratch).count() == 0
    assert conversations.repair_turns(empty, scratch).count() == 0
    for r in conversations.report_repairs(empty, scratch, known).collect():
        assert (r["cost"], r["audit"], r["gaps"]) == (0, "", 0)
        assert r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    turns = spark.createDataFrame(
        [(1, None, "user", "A."), (1, 2, "user", "B."), (1, 2, "user", "B."), (1, 9, None, "C."),
         (2, None, "user", "x" * 3_000_000 + "."), (2, None, "assistant", "ü.")], shape)
    got = {r["conv_id"]: r for r in conversations.report_repairs(turns, scratch).collect()}
    assert (got[1]["gaps"], got[1]["duplicate"], got[1]["audit"]) == (6, 1, "DKDR")
    # Rows of one turn are ordered by role: the assistant's comes first.
    assert got[2]["gaps"] == 0 and got[2]["audit"] == "RR"


# ------------------------------------------------------------------------------ fingerprints


def slow_print(text):
    words = _lower(text).encode().split()
    votes = [0] * 256

    def vote(value, weight):
        for bit in range(256):
            votes[bit] += weight if value >> (255 - bit) & 1 else -weight

    hashes = [int.from_bytes(hashlib.sha256(w).digest(), "big") for w in words]
    for w, h in zip(words, hashes):
        vote(h, len(w))
    for (a, x), (b, y) in itertools.pairwise(zip(words, hashes)):
        vote(x ^ (y >> 128 | (y & (1 << 128) - 1) << 128), len(a) + len(b))
    return f"{int(''.join('01'[v > 0] for v in votes), 2):064x}"


def test_fingerprints_equal_plain_votes(spark, monkeypatch):
    texts = ["", None, "x", "Ä b  b\tC", "the cat sat on the mat " * 40, "word"]
    got = simhash.fingerprints(make_docs(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {
        i: slow_print(t or "") for i, t in enumerate(texts)}
    monkeypatch.setattr(simhash, "VOTE_ROWS", 7)
    assert simhash.Simhash().of(texts[4].encode()).tobytes().hex() == slow_print(texts[4])


@pytest.mark.parametrize("rows", [1, 2, 40])
def test_edits_and_neighbours(spark, rows):
    rng = random.Random(rows)
    docs = [(i * 3 % 101, " ".join(rng.choices(["é", "go", "漢字", "stop", "🙂"], k=rng.randrange(30))))
            for i in range(rows)]
    got = {r["doc_id"]: r for r in simhash.fingerprint_edits(
        make_docs(spark, docs).repartition(3), Scratch(spark, "t")).collect()}
    docs.sort()
    apart = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 256
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        other = text[:len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (
            len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (slow_print(text), slow_print(other))
        assert r["near_edited"] == apart(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == apart(r["fingerprint"], slow_print(after))


def test_edits_of_awkward_rows(spark):
    rows = edge_rows()
    got = simhash.fingerprint_edits(make_docs(spark, rows), Scratch(spark, "t")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)} == {"0" * 64}
    assert simhash.fingerprint_edits(make_docs(spark, []), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("radius, blocks", [(3, 4), (7, 8), (2, 5)])
def test_all_fingerprints_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(256) for _ in range(12)]
    prints = {f"{v:064x}" for v in seeds}
    for seed in seeds:
        for _ in range(25):
            value = seed
            for bit in rng.sample(range(256), rng.randrange(radius + 3)):
                value ^= 1 << bit
            prints.add(f"{value:064x}")
    frame = spark.createDataFrame([(p,) for p in sorted(prints)], "fingerprint string")
    queries = sorted(prints)[::3]
    got = {(r["fingerprint"], r["other"]): r["distance"] for r in simhash.find_near(
        frame, spark.createDataFrame([(p,) for p in queries + queries], "fingerprint string"),
        radius, blocks).collect()}
    apart = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in queries for b in prints}
    assert got == {pair: d for pair, d in apart.items() if d <= radius}
    assert np.all(np.array(list(got.values())) <= radius)
