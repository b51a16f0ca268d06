"""Registered queries against their SQL, and the pipeline against brute force."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from casetriage.llm.queries import ORACLE, QUERIES
from edge import SF_SMALL, documents
from helpers import compare
from test_decontaminate import brute as brute_leak
from test_jaccard import brute as brute_groups


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])


def test_all_are_registered():
    names = E.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == list(QUERIES) and "pipeline" in names
    assert set(ORACLE) <= set(E.oracle_sql())


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    read = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        read.append(({r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in docs.collect()}))
    (all_docs, known), (texts, single), (more, clean), (last, coded) = read
    assert len(known) >= 0.98 * len(all_docs)
    groups = brute_groups(texts, 5, 80, 100)
    assert single == {i for i, (n, c) in groups.items() if n == 0 or c == i}
    assert clean == {i for i, t in more.items() if not brute_leak(t, bench)[3]}
    assert coded == set(last)


def test_pipeline_on_edge_rows(spark, tmp_path):
    docs = documents(spark).selectExpr("doc_id", "text", "lang", "cast(null as string) as source", "n as n_chars", "1 as th", "2 as d", "'x' as set_key")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = sorted(r.doc_id or -1 for r in docs.collect())
    assert ids == [-1, 1, 7, 8, 9, 10]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0
