"""Token ids, packing and token files: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sluicegate.llm import packing, token_files
from sluicegate.llm.tokens import Encoder, encoder, public_file
from sluicegate.plans.scratch import Scratch

from .helpers import make_docs, random_text

FILES = {name: public_file(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ODD = " \n\t\x1f\x85\xa0 ​　'sAé́ß漢🙂1!<|endoftext|>\x00Σς٣"


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_whole_text(name):
    library = Tokenizer.from_file(FILES[name])
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) if rng.random() < 0.8 else
                     rng.choice(["<|endoftext|>", " ", "  ", "'s", "̈"])
                     for _ in range(rng.randint(0, 20))) for _ in range(3_000)]
    texts += [random_text(rng, 200), "a, b. c\nd  e ", " ", ""]
    got = encoder(FILES[name])().encode([text.encode() for text in texts])
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids, repr(text)


def id_list(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def check_pieces(pieces, wanted, window):
    pieces_of, members = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = wanted[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert 0 < p["length"] == len(part) and p["doc_tokens"] == len(wanted[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(part.tobytes())
        pieces_of[p["doc_id"]].append((p["start"], p["length"]))
        members[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, ids in wanted.items():
        at = 0
        for start, length in sorted(pieces_of[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    padding = 0
    for own in members.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(members)


@pytest.mark.parametrize("shape", ["mixed", "equal", "short"])
def test_packing_round_trip(spark, shape):
    rng = random.Random(2)
    sizes = {"mixed": lambda: int(rng.lognormvariate(4.5, 1.3)), "equal": lambda: 260,
             "short": lambda: rng.randint(0, 3)}[shape]
    rows = [(i, random_text(rng, sizes(), 3_000)) for i in range(300)]
    library = Tokenizer.from_file(FILES["byte_bpe_50k.json"])
    wanted = {i: id_list(library, text, 1) for i, text in rows}
    pieces = packing.pack(make_docs(spark, rows), FILES["byte_bpe_50k.json"], 1,
                          window=1_024, step=8).collect()
    padding, sequences = check_pieces(pieces, wanted, 1_024)
    assert padding <= 21 * sequences


def test_non_negative_least_squares():
    matrix = packing.combinations(32)
    assert (np.arange(1, 33) @ matrix == 32).all()
    rng = np.random.default_rng(3)
    true = np.where(rng.random(matrix.shape[1]) < 0.1, rng.integers(1, 50, matrix.shape[1]), 0)
    found = packing.solve_counts(matrix, matrix @ true)
    assert (found >= 0).all() and np.abs(matrix @ found - matrix @ true).max() < 1e-6
    wanted = rng.integers(0, 100, 32).astype(float)
    x = packing.solve_counts(matrix, wanted)
    slope = matrix.T @ (wanted - matrix @ x)
    assert slope.max() < 1e-6 and np.abs(slope[x > 0]).max() < 1e-6  # optimality conditions


def test_plan_uses_no_class_twice():
    histogram = np.random.default_rng(4).integers(0, 60, 64)
    used = np.zeros(64, int)
    for combination in packing.plan_combinations(histogram):
        assert sum(combination.classes) == 64 and combination.count > 0
        for cls in combination.classes:
            used[cls - 1] += combination.count
    assert (used <= histogram).all()
    weight = np.arange(1, 65)
    assert used @ weight > 0.7 * (histogram @ weight)
    assert packing.plan_combinations(np.zeros(8, int)) == []


def test_tail_is_cut_at_powers_of_two():
    for total in (0, 1, 7, 64, 100, 1_000):
        cuts = packing.tail_cuts(total, 64)
        assert sum(n for _, n in cuts) == total % 64
        assert all(n & (n - 1) == 0 for _, n in cuts)


def token_table(spark, count=500):
    rng = random.Random(7)
    rows = [(3 * i, random_text(rng, rng.randint(0, 120), 4_000)) for i in range(count)]
    rng.shuffle(rows)
    path = Scratch(spark, "t").path("token-files")
    files = token_files.write_token_files(make_docs(spark, rows), path,
                                          FILES["word_bpe_49k.json"], 2, files=3,
                                          row_group_bytes=64 << 10, page_bytes=4 << 10)
    return rows, path, files


def test_token_files_round_trip(spark):
    rows, _, files = token_table(spark)
    library = Tokenizer.from_file(FILES["word_bpe_49k.json"])
    got = {r["doc_id"]: r for r in files.digests().collect()}
    lists = {r["doc_id"]: r["ids"] for r in files.rows().collect()}
    at = 0
    for doc, text in sorted(rows):
        ids = id_list(library, text, 2)
        assert lists[doc] == ids.tolist()
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (
            at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    index = sorted(files.index().collect(), key=lambda r: r["first_start"])
    assert sum(r["n_ids"] for r in index) == at
    assert all(a["last_doc"] < b["first_doc"] for a, b in zip(index, index[1:]))


def test_token_files_layout_allows_selective_reads(spark):
    from pyspark.sql import functions as F

    rows, path, files = token_table(spark)
    local = path.removeprefix("file:")
    tables = sorted(__import__("glob").glob(f"{local}/data/*.parquet"))
    assert len(tables) == 3
    meta = pq.ParquetFile(tables[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i)
               for i in range(meta.num_columns)}
    ids = next(column for name, column in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    for name in ("doc_id", "local_start", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings
        assert columns[name].has_offset_index and columns[name].has_column_index
    some = files.rows(F.col("doc_id").between(300, 330))
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(300, 331, 3))
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,300)" in plan
    assert "ids:" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_parts_are_those_of_the_whole_text(name):
    """Runs of letters, digits, signs and line ends side by side, also at the edge of each kind."""
    library = Tokenizer.from_file(FILES[name])
    rng = random.Random(11)
    edges = [chr(c) for c in (*range(33, 127), 0xBF, 0xC0, 0xD6, 0xD7, 0xD8, 0xF6, 0xF7, 0xFF, *range(
        0x12E, 0x133), 0x17E, 0x17F, 0x180, *range(0x38F, 0x3CB), *range(0x3FF, 0x462), 0x301, 0x2019)]
    texts = ["".join(rng.choice(edges) if rng.random() < 0.8 else rng.choice(
        [" ", " ", "\n", "\n\n", "<|endoftext|>", "\x00", "\x00\x00"]) for _ in range(rng.randint(0, 25)))
        for _ in range(6_000)]
    texts += ["\x00", "\x00\x00", "\x00 \x00\x00", "word, \x00 word", "", " ", "\n", "a ", "a\n", " a"]
    got = encoder(FILES[name])().encode([text.encode() for text in texts])
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", FILES)
def test_a_word_is_encoded_once_whatever_stands_around_it(name, monkeypatch):
    work = Encoder(FILES[name])
    seen = []
    for step in ("_word_ids", "_other_ids"):
        monkeypatch.setattr(work, step, lambda parts, step=getattr(work, step): (
            seen.extend(parts), step(parts))[1])
    # Marks after a word, line ends, and spaces after a dash, which keep a text from plain cuts.
    texts = [f"a{sign}threan{sign} b — c threan{sign} d.\nthrean{sign}".encode()
             for sign in (",", ".", ";", "!", "?", ":", ")", "/", "|", "&", "=", "#")]
    work.encode(texts)
    work.encode(texts)
    assert len([part for part in seen if "threan" in part]) <= 2
    assert len(seen) == len(set(seen))


def test_packing_encodes_each_run_of_letters_once(monkeypatch):
    work, seen = Encoder(FILES["byte_bpe_50k.json"]), []
    monkeypatch.setattr(work, "_learn", lambda parts, learn=work._learn: (seen.extend(parts), learn(parts))[1])
    monkeypatch.setattr(packing, "encoder", lambda path: lambda: work)
    steps = []
    monkeypatch.setattr(packing, "map_texts", lambda docs, step, schema: steps.append(step()))
    packing.tokenise(None, FILES["byte_bpe_50k.json"], 1)
    texts = [f"so threan{sign} so".encode() for sign in ",.;:!?)]}"]
    rows = steps[0](pa.RecordBatch.from_pydict({"doc_id": range(9), "text": texts}))
    library = Tokenizer.from_file(FILES["byte_bpe_50k.json"])
    assert [np.frombuffer(ids, "<u2").tolist() for ids in rows["ids"]] == [
        id_list(library, text.decode(), 1).tolist() for text in texts]
    assert seen.count(" threan") == 1 and sum("threan" in part for part in seen) == 1
