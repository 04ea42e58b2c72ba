import corpus_pipeline

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import brute_near, check_packing, repeated_passages


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, sf)
        assert after.columns == columns
        rows = after.collect()
        if name == "toxicity":
            assert {r.doc_id for r in rows} < before.keys() and all(before[r.doc_id] == r.text for r in rows)
        if name == "line_dedup":
            gone = repeated_passages(before)
            want = {k: [x for i, x in enumerate(t.split("\n")) if i not in gone[k] and x.strip()] for k, t in before.items()}
            assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in rows} == {k: w for k, w in want.items() if w or not gone[k]}
            assert all(r.n_chars == len(r.text) for r in rows if gone[r.doc_id])
        if name == "near_duplicates":
            assert {r.doc_id for r in rows} == {k for k, x in brute_near(before, 80).items() if x[3]}
        docs = spark.createDataFrame(rows, after.schema)
    texts = [r.text for r in docs.collect()]
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(corpus_pipeline.packing(spark, numbered, sf).collect(), dict(enumerate(texts)))
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_rows_without_or_with_equal_ids(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(None, "no id at all", "en", "a", 12), (None, None, None, None, None), (1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, f"{long} more", "en", "a", 9), (3, "", "en", None, 0)], schema)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()), key=repr)
    assert kept == [(1, long), (3, ""), (None, "no id at all"), (None, None)]
    mixed = corpus_pipeline.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    words = sum(len(r.text.split()) for r in rows)
    assert abs(words - (400 + 400 + 401 + 4)) <= 3 and any(r.doc_id is None for r in rows)
    assert sum(r.doc_id == 1 for r in rows) <= 6
    assert all(corpus_pipeline.STAGES[k][1](spark, docs, sf).columns == docs.columns for k in range(2))
    assert corpus_pipeline.packing(spark, docs, sf).count() == 6


CLASHING = ("_n", "_chunks", "_lines", "_severity", "_severity_toxic", "severity", "severity_toxic", "n_chunks_removed", "n_lines_removed", "rest", "own", "again", "group", "nth", "d", "e", "t", "size", "taken", "shard", "_row", "_doc", "piece", "row", "a b", "x.y")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name_and_take_no_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").coalesce(2)
    more = docs.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHING))
    plain, wide = stage(spark, docs, sf), stage(spark, more, sf)
    none = stage(spark, more.limit(0), sf)
    assert none.count() == 0
    rows = wide.collect()
    if name == "packing":
        assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted((r.doc_id, r.piece, r.length) for r in plain.collect())
        return
    assert wide.columns == more.columns == none.columns
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)
    if name != "mixing":  # which blocks are chosen hangs on a hash of the row
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in plain.collect())
