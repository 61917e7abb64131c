"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from sluicegate.llm import (decontaminate, exact_dedup, licenses, near_dedup, packing, quality,
                            sharding, substrings, token_files, toxicity)
from sluicegate.llm.tokens import public_file
from sluicegate.plans.scratch import Scratch

from .helpers import by_id, edge_rows, make_docs

BYTE_BPE = public_file("byte_bpe_50k.json")


def _items(spark):
    return spark.createDataFrame([(1, "plain words in a row"), (2, None), (3, "")],
                                 "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (7, None, 1), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "licenses": lambda spark, docs: licenses.scan_licences(docs),
    "exact": lambda spark, docs: exact_dedup.mark_duplicates(docs),
    "near": lambda spark, docs: near_dedup.mark_near_duplicates(
        docs, near_dedup.Shingling(4, 80)),
    "sharding": lambda spark, docs: sharding.assign_shards(docs, 1_000),
    "quality": lambda spark, docs: quality.score_texts(
        docs, quality.train_quality(docs, _labels(spark))),
    "toxicity": lambda spark, docs: toxicity.score_toxicity(docs, _labels(spark)),
    "substrings": lambda spark, docs: substrings.remove_repeats(docs),
    "token_files": lambda spark, docs: token_files.write_token_files(
        docs, Scratch(spark, "t").path("files"), BYTE_BPE, 2).digests(),
    "decontaminate": lambda spark, docs: decontaminate.find_contamination(docs, _items(spark)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_one_result_each(spark, name):
    rows = edge_rows()
    got = by_id(OPERATORS[name](spark, make_docs(spark, rows)).collect())
    assert sum(map(len, got.values())) == len(rows)
    assert len(got[9]) == 2 and len(got[None]) == 2
    empty = {i: got[i][0] for i in (2, 3)}
    if name == "licenses":
        assert empty[2]["n_words"] == 0 and empty[2]["labels"] == ""
        assert empty[2]["first_word"] is None and empty[2]["score"] == 0
    if name == "exact":
        assert (empty[2]["keep_id"], empty[3]["keep_id"]) == (3, 3)
        assert got[1][0]["keep_id"] == 6 and not got[1][0]["kept"] and got[6][0]["kept"]
        assert all(r["group_size"] == 2 and r["kept"] for r in got[9])
        assert {r["keep_id"] for r in got[None]} == {None, 3}
    if name == "near":
        assert got[6][0]["component_id"] == 1 and not got[6][0]["kept"]
        assert [empty[i]["component_id"] for i in (2, 3)] == [2, 3]
        assert all(r["component_id"] is None and r["kept"] for r in got[None])
    if name == "sharding":
        assert all(r["shard_bytes"] <= 1_000 or r["shard_docs"] == 1
                   for some in got.values() for r in some)
    if name in ("quality", "toxicity"):
        assert empty[2]["score"] == empty[3]["score"]
        assert all(0 <= r["score"] <= 1 for some in got.values() for r in some)
    if name == "substrings":
        assert empty[2]["n_words"] == 0 and got[7][0]["n_removed"] == 0
        assert got[5][0]["n_words"] == 30_000
    if name == "token_files":
        assert empty[2]["n_tokens"] == 1
        ordered = sorted((r["start"], r["n_tokens"]) for some in got.values() for r in some)
        assert ordered[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(ordered, ordered[1:]))
    if name == "decontaminate":
        assert got[1][0]["n_hit"] == 5 and got[1][0]["contaminated"]
        assert not empty[2]["contaminated"]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, make_docs(spark, [])).count() == 0


def test_packing_awkward_rows(spark):
    rows = edge_rows()
    pieces = packing.pack(make_docs(spark, rows), BYTE_BPE, 1).collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in rows}
    assert sum(p["length"] for p in pieces if p["doc_id"] == 2) == 1
    assert packing.pack(make_docs(spark, []), BYTE_BPE, 1).count() == 0


def test_filters_keep_all_columns(spark):
    docs = make_docs(spark, edge_rows())
    for kept in (exact_dedup.drop_duplicates(docs),
                 near_dedup.drop_near_duplicates(docs, near_dedup.Shingling(5, 80)),
                 decontaminate.drop_contaminated(docs, _items(spark)),
                 quality.keep_good(docs, quality.train_quality(docs, _labels(spark)))):
        assert sorted(kept.columns) == sorted(docs.columns)
        assert all(row["kept"] == "x" for row in kept.collect())
