"""The pipeline, stage by stage, against brute force on the smallest data."""

import corpus_pipeline
from tokenizers import Tokenizer

from sluicegate.llm import quality
from sluicegate.llm.tokens import public_file

from .helpers import edge_rows, make_docs
from .test_marking import brute_components, contaminated
from .test_tokens import check_pieces, id_list

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    weights = quality.train_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        got = docs.collect()
        if name == "quality":
            scorer = quality.Scorer(weights)
            want = {i for i, t in texts.items() if scorer.score((t or "").encode()) >= 0.3}
        elif name == "exact_dedup":
            last = {}
            for i, text in sorted(texts.items()):
                last[text] = i
            want = set(last.values())
        elif name == "near_dedup":
            of, _ = brute_components(list(texts.items()), 5, 80)
            want = {i for i in texts if of[i] == i}
        elif name == "decontaminate":
            want = {i for i, row in contaminated(list(texts.items()), items).items() if not row[4]}
        else:
            library = Tokenizer.from_file(public_file("byte_bpe_50k.json"))
            check_pieces(got, {i: id_list(library, t, 1) for i, t in texts.items()}, 2_048)
            continue
        assert docs.columns == columns and sorted(r["doc_id"] for r in got) == sorted(want)
        assert 0 < len(want) <= len(texts)
        texts = {r["doc_id"]: r["text"] for r in got}
        docs = spark.createDataFrame(got, docs.schema)


def test_run_gives_the_pieces_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, a long text and clashing columns; then no documents at all."""
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", "nothing of the kind stands there"), ("b", None)],
                                  "item_id string, text string")
    for name, rows in (("rows", edge_rows()), ("none", [])):
        folder = str(tmp_path / name)
        make_docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in got} <= {i for i, _ in rows}
        assert bool(got) == bool(rows)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert sorted(docs.columns) == sorted(make_docs(spark, []).columns)


def test_registered_with_the_other_queries():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names
                                                 if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
