"""Registered text queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from compare import duck, duck_rows, spark_rows

import corpus_pipeline
from claimscope.llm import language, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    names, rows = spark_rows(queries.queries()[name](spark, SF))
    want_names, want, _ = duck_rows(con, queries.oracle_sql()[name])
    assert names == want_names and rows == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
    assert counts[0] == counts[1] > counts[2] > 0
    kept = {(r["doc_id"], r["start"]) for r in docs.collect()}
    ran = {(r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert ran == kept


def test_pipeline_on_awkward_documents(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (2, None, "en", None, None), (3, "", "de", "b", 0), (4, "123", "en", "a", 3), (None, "der Hund im Haus", None, "b", 16), (1, "the cat sat on the mat", "en", "a", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, SF)
        frame.collect()


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.keep_identified(docs).count() == docs.count()
