"""The registered queries on the smallest tables: SQL where there is some, contracts and brute force elsewhere."""

import zlib

import pytest

from tests.compare import assert_same
from tests.conftest import SF
from tests.llm.test_small import brute_components, check_packing
from tickweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_near_duplicates(spark):
    rows = sorted(documents(spark), key=lambda r: r.doc_id)
    want = brute_components([r.text for r in rows], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_jaccard_join(spark, SF).collect()}
    assert got == {rows[i].doc_id: (n, rows[c].doc_id) for i, (n, c) in want.items()}


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in queries.op3_quality_classifier(spark, SF).collect() if r.doc_id in labels and r.held_out]
    assert got and sum(r.predicted == labels[r.doc_id] for r in got) >= 0.8 * len(got)
    langs = {r.doc_id: r.lang for r in documents(spark)}
    found = [r for r in queries.op6_language_id(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    assert sum(r.lang_pred == langs[r.doc_id] for r in found) >= 0.95 * len(found)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    check_packing(rows, 4096)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(rows)
