"""Licence scan, deduplication, substrings and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import regex

from sluicegate.llm import decontaminate, exact_dedup, licenses, near_dedup, sharding, substrings
from sluicegate.llm.decontaminate import words_of

from .helpers import make_docs, random_text


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def licence_texts():
    rng = random.Random(3)
    texts = ["Licensed under CC-BY 4.0. All Rights Reserved.", "cc by cc by", "accc bye",
             "THE GNU GENERAL PUBLIC LICENSE", "all rights reserved" * 2]
    for phrase, _, k in licenses.NOTICES:
        for _ in range(4):
            chars = list(phrase)
            for _ in range(rng.randint(0, k + 1)):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "x", chars[at] + "q", chars[at]])
            texts.append(f"{random_text(rng, 20)} {''.join(chars)} {random_text(rng, 20)}")
    return texts


def test_licences_equal_a_search_of_the_whole_text(spark):
    texts = licence_texts()
    got = {r["doc_id"]: r for r in
           licenses.scan_licences(make_docs(spark, enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        words = [w.decode() for w in words_of(text.encode())]
        joined = " ".join(words)
        base = [(at, label) for phrase, label in licenses.BASE.items()
                for at in range(len(words)) if words[at:at + len(phrase.split())] == phrase.split()]
        fuzzy = {label for phrase, label, k in licenses.NOTICES if regex.search(
            f"(?<![^ ])(?:{regex.escape(phrase)}){{e<={k}}}(?![^ ])", joined)}
        row = got[i]
        assert (row["n_words"], row["n_base"]) == (len(words), len(base))
        assert row["first_word"] == (min(base)[0] if base else None)
        assert row["last_word"] == (max(base)[0] if base else None)
        assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert row["labels"] == ",".join(sorted({label for _, label in base} | fuzzy))
        assert (row["score"] == 1) >= bool(base)


def test_licence_spans_are_within_the_allowed_edits(spark):
    allowed = {phrase: k for phrase, _, k in licenses.NOTICES}
    spans = licenses.find_notices(make_docs(spark, enumerate(licence_texts()))).collect()
    assert len(spans) > 20
    for span in spans:
        assert edits(span["notice"], span["matched"]) <= span["edits"] <= allowed[span["notice"]]


def test_exact_groups(spark):
    rng = random.Random(1)
    rows = [(i, random_text(rng, 3, 6)) for i in range(400)] + [(i, "hot") for i in range(400, 600)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(make_docs(spark, rows)).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    for i, text in rows:
        row = got[i]
        assert row["keep_id"] == max(groups[text]) and row["kept"] == (i == max(groups[text]))
        assert row["group_size"] == len(groups[text])
        assert row["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.drop_duplicates(make_docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(max(g) for g in groups.values())


def test_bloom_cells_keep_every_repeated_hash():
    rng = np.random.default_rng(2)
    cell = rng.integers(0, 50, 3_000)
    bits = np.int64(1) << rng.integers(0, 63, 3_000)
    cells, once, twice = exact_dedup.combine(cell, bits, np.zeros_like(bits))
    for at, c in enumerate(cells):
        own = bits[cell == c]
        want = [b for b in set(own.tolist()) if (own == b).sum() > 1]
        assert once[at] == np.bitwise_or.reduce(own)
        assert twice[at] == np.bitwise_or.reduce(np.array(want or [0], np.int64))
    parts = [exact_dedup.combine(cell[a:a + 700], bits[a:a + 700], np.zeros(len(cell[a:a + 700]),
                                                                          np.int64))
             for a in range(0, 3_000, 700)]
    again = exact_dedup.combine(*map(np.concatenate, zip(*parts)))
    assert all((x == y).all() for x, y in zip(again, (cells, once, twice)))


def test_most_unique_documents_pass_straight_through(spark):
    rng = random.Random(8)
    docs = make_docs(spark, [(i, random_text(rng, 6)) for i in range(2_000)])
    prints = exact_dedup.fingerprints(docs, 500)
    maybe = prints.join(exact_dedup.repeated_bits(prints), "cell", "left").where(
        "coalesce((bits & twice) = bits, false)").count()
    assert maybe < 100


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_rows():
    rng = random.Random(11)
    rows, i = [], 0
    for size in (1, 1, 1, 2, 5, 40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice((30, 90, 200)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
            rows.append((i, " ".join(words)))
            i += 1
    # A chain: neighbours are linked, its ends are not.
    words = [f"c{k}" for k in range(120)]
    for step in range(14):
        rows.append((i, " ".join(words[4 * step:] + [f"d{k}" for k in range(4 * step)])))
        i += 1
    # Texts with the same opening and different rest share buckets, but no link.
    for step in range(25):
        rows.append((i, " ".join(words[:70] + [f"e{step}x{k}" for k in range(30)])))
        i += 1
    rows += [(i, rows[3][1]), (i + 1, rows[3][1].upper()), (i + 2, "a b"), (i + 3, "A  b"),
             (i + 4, "a b c"), (i + 5, ""), (i + 6, None), (i + 7, "a b c d"), (i + 8, "a b c d e")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_near_components_equal_all_pairs(spark, words):
    rows = near_rows()
    want, sizes = brute_components(rows, words, 80)
    got = near_dedup.mark_near_duplicates(
        make_docs(spark, rows), near_dedup.Shingling(words, 80)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_that_only_the_full_comparison_finds(spark):
    """A bucket's leader may link to nobody while two other members link to each other."""
    rng = random.Random(4)
    common = [f"w{k}" for k in range(75)]
    rows = []
    for family in range(12):
        own = [f"f{family}y{k}" for k in range(25)]
        for copy in range(3):
            words = common + own
            words[rng.randrange(75, 100)] = f"z{family}{copy}"
            rows.append((family * 3 + copy, " ".join(words)))
    want, _ = brute_components(rows, 4, 80)
    got = near_dedup.mark_near_duplicates(
        make_docs(spark, rows), near_dedup.Shingling(4, 80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 1


def test_pairs_just_below_the_threshold_are_not_listed(spark, monkeypatch):
    """Copies that are about 0.73 alike, whose edits each occur in several of them."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(160)]
        for at in rng.sample(range(4, 156, 8), 3):
            words[at] = f"v{at}"
        rows.append((i, " ".join(words)))
    want, _ = brute_components(rows, 4, 80)
    listed, confirm = [], near_dedup._confirm

    def count(pairs, *rest):
        listed.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirm", count)
    got = near_dedup.mark_near_duplicates(
        make_docs(spark, rows), near_dedup.Shingling(4, 80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sum(listed) < 6 * len(rows)


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 50, 3_000):
        one = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        two = np.unique(np.append(one[n // 3:], rng.integers(0, 1 << 63, n // 4 + 1, np.uint64)))
        either = near_dedup.cell_parities(one) ^ near_dedup.cell_parities(two)
        differ = sum(int(word).bit_count() for word in either.view(np.uint64).tolist())
        assert differ <= len(np.setxor1d(one, two))


def test_estimate_is_close(spark):
    one = random_text(random.Random(1), 400, 5_000)
    words = one.split()
    for at in range(0, 400, 40):
        words[at] = f"q{at}"
    docs = make_docs(spark, [(1, one), (2, " ".join(words))])
    signed = near_dedup.shingle_sets(docs, near_dedup.Shingling(4, 80))
    a = signed.where("doc_id = 1").selectExpr("bits AS bits_a")
    b = signed.where("doc_id = 2").selectExpr("bits AS bits_b")
    got = a.join(b).select(near_dedup.estimate("bits_a", "bits_b")).first()[0]
    x, y = shingles(one, 4), shingles(" ".join(words), 4)
    assert abs(got - len(x & y) / len(x | y)) < 0.1


def brute_removed(rows, width):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - width + 1):
            window = tuple(words[at:at + width])
            if window in seen:
                gone.update(range(at, at + width))
            seen.setdefault(window, (i, at))
        kept = b" ".join(w for at, w in enumerate(words) if at not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def substring_rows(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(15, 60))] for k in range(5)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                passage = rng.choice(passages)
                a = rng.randint(0, 10)
                words += passage[a:len(passage) - rng.randint(0, 10)]
            elif kind < 0.55:
                words += [f"r{rng.randint(0, 2)}"] * rng.randint(1, 70)
            elif kind < 0.7:
                words += [f"s{k % rng.choice((2, 3, 7))}" for k in range(rng.randint(1, 60))]
            else:
                words += [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words)))
    return rows + [(60 + k, rows[k][1]) for k in range(5)] + [(70, None), (71, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_all_windows(spark, seed):
    rows = substring_rows(seed)
    got = substrings.remove_repeats(make_docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
            for r in got} == brute_removed(rows, 20)


def test_spans_repeat_their_source(spark):
    from sluicegate.plans.scratch import Scratch

    rows = substring_rows(3)
    texts = {i: (t or "").split() for i, t in rows}
    spans = substrings.repeated_spans(make_docs(spark, rows), Scratch(spark, "t")).collect()
    assert any(s["n_words"] > 25 for s in spans)
    for s in spans:
        own = texts[s["doc_id"]][s["first_word"]:s["first_word"] + s["n_words"]]
        assert len(own) == s["n_words"] >= 20
        assert own == texts[s["source_doc"]][s["source_word"]:s["source_word"] + s["n_words"]]
        assert (s["source_doc"], s["source_word"]) < (s["doc_id"], s["first_word"])


def contaminated(rows, items, width=10):
    windows = {}
    for item, text in items:
        words = words_of((text or "").encode())
        for at in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[at:at + width]), set()).add(str(item))
    out = {}
    for i, text in rows:
        words, hit, found = words_of((text or "").encode()), set(), set()
        for window, names in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at:at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found |= names
        out[i] = (len(words), len(hit), len(found),
                  hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def leak_rows():
    rng = random.Random(6)
    items = [(k, random_text(rng, rng.choice((1, 4, 9, 10, 11, 30)), 2_000)) for k in range(40)]
    items += [(50, items[5][1].upper()), (51, None), (52, "..."), (53, "Ünï 漢 x")]
    rows = []
    for i in range(80):
        words = random_text(rng, rng.randint(0, 60), 2_000).split()
        if i % 3 == 0:
            source = rng.choice([t for _, t in items if t]).split()
            a = rng.randint(0, max(0, len(source) - 10))
            at = rng.randint(0, len(words))
            words[at:at] = source[a:]
        rows.append((i, rng.choice((" ", ", ", "\n")).join(words)))
    return rows + [(90, None), (91, "so ünï-漢,X!")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontamination_equals_all_windows(spark, block_bytes):
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(make_docs(spark, rows), table,
                                           block_bytes=block_bytes).collect()
    want = contaminated(rows, items)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    clean = decontaminate.drop_contaminated(make_docs(spark, rows), table,
                                            block_bytes=block_bytes).collect()
    assert sorted(r["doc_id"] for r in clean) == [i for i in sorted(want) if not want[i][4]]


def test_matches_map_back_to_the_text(spark):
    rows, items = leak_rows()
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = dict(rows)
    matches = decontaminate.find_matches(make_docs(spark, rows), table).collect()
    assert matches
    for m in matches:
        text = texts[m["doc_id"]][m["start"]:m["end"]]
        assert text == m["matched"]
        assert len(words_of(text.encode())) == m["n_words"]


def test_shards_fit_and_are_no_smaller_than_needed(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice((0, 10, 200, 900))) for i in range(800)]
    rows += [(7, f"copy {k}") for k in range(100)] + [(8, "equal")] * 100 + [(9, "y" * 5_000)]
    got = sharding.assign_shards(make_docs(spark, rows), 2_000).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    for name, own in shards.items():
        assert {r["shard_docs"] for r in own} == {len(own)}
        size = sum(r["n_bytes"] for r in own)
        assert {r["shard_bytes"] for r in own} == {size} and (size <= 2_000 or len(own) == 1)
    # No shard is a prefix of another; the parent of every shard was over the limit.
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name in names:
        if name:
            inside = [r for s, own in shards.items() if s.startswith(name[:-1]) for r in own]
            assert sum(r["n_bytes"] for r in inside) > 2_000 and len(inside) > 1


def test_shards_are_written_whole(spark):
    from sluicegate.plans.scratch import Scratch

    docs = make_docs(spark, [(i, "word " * (i % 50)) for i in range(200)])
    path = Scratch(spark, "t").path("shards")
    directory = sharding.write_shards(docs, path, 3_000).collect()
    back = spark.read.parquet(path)
    assert back.count() == 200 and back.select("shard").distinct().count() == len(directory)


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_items_without_an_id_count_and_add_no_name(spark, block_bytes):
    docs = make_docs(spark, [(1, "x one two three y"), (2, "one two three four five"), (3, "clean")])
    items = spark.createDataFrame([(None, "one two three"), (None, "two three"), ("b", "four five")],
                                  "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(
        docs, items, block_bytes=block_bytes).collect()}
    # As in the SQL: count(*) takes the missing id as one item, string_agg leaves it out.
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [
        (3, 1, True), (5, 2, True), (0, 0, False)]
    assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["items_sha256"] == hashlib.sha256(b"b").hexdigest()
    kept = decontaminate.drop_contaminated(docs, items, block_bytes=block_bytes).collect()
    assert [r["doc_id"] for r in kept] == [3]
    names = {r["item_id"] for r in decontaminate.find_matches(
        docs, items, block_bytes=block_bytes).collect()}
    assert names == {None, "b"}


def test_every_row_is_written_once_into_its_shard(spark, tmp_path):
    rows = [(7, f"hot text {i % 3} " * 5) for i in range(60)]
    rows += [(None, f"no id {i}") for i in range(10)] + [(i, "plain") for i in range(100, 110)]
    path = str(tmp_path / "shards")
    directory = {r["shard"]: r for r in sharding.write_shards(
        make_docs(spark, rows), path, 400).collect()}
    written = spark.read.parquet(path).collect()
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["text"])) for r in written)
    assert "_shard_row" not in written[0].asDict()
    for shard, entry in directory.items():
        own = [r for r in written if r["shard"] == shard]
        assert len(own) == entry["shard_docs"]
        assert sum(len(r["text"]) for r in own) == entry["shard_bytes"] <= 400
