"""The pipeline and the registered queries on the small tables."""

import pytest

import corpus_pipeline
from riskframe.catalog.registry import ORACLES, QUERIES
from riskframe.llm import decontam, lattice, linerules, ranking, resemblance
from riskframe.llm.queries import rank_labels
from tests.oracle_check import connect, differences


@pytest.mark.parametrize("name", ["op2_chat_format", "op6_line_rules", "op10_decontaminate", "op12_merkle_multiproof", "op13_permuterm_variants"])
def test_query_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == []


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, want, sf)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.collect()}
        have = {r.doc_id: r for r in want.collect()}
        if step is corpus_pipeline.quality_rules:
            assert ids == {r.id for r in linerules.measure(want).where("kept").collect()}
        elif step is corpus_pipeline.quality_classifier:
            model = ranking.fit(docs, rank_labels(spark, sf))
            assert ids == {i for i, r in have.items() if model.scores(__import__("numpy").array([ranking.features(r.text)]))[0] >= ranking.CUT}
        elif step is corpus_pipeline.near_duplicates:
            sets = {i: set(resemblance.shingles_of(r.text).tolist()) for i, r in have.items()}
            alike = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
            # The link is an estimate: certain for 0.85, impossible for 0.65.
            assert all(any(alike(i, j) > 0.65 for j in have if j != i) for i in set(have) - ids)
            assert all(alike(i, j) < 0.85 for i in ids for j in ids if i < j)
        else:
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert ids == set(have) - {r.doc_id for r in decontam.leaks(want, items).collect()}
        want = spark.createDataFrame(out.collect(), docs.schema)
    lat = lattice.Lattice.load(lattice.MODEL)
    final = {r.doc_id: r for r in corpus_pipeline.encoding(spark, want, sf).collect()}
    texts = {r.doc_id: r.text for r in want.collect()}
    assert set(final) == set(texts) and all(lat.decode(r.ids) == texts[i] for i, r in final.items())
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == {i: r.ids for i, r in final.items()}


def test_stages_take_odd_rows(make_docs, spark, sf):
    for _, step in corpus_pipeline.STAGES:
        docs = make_docs([None, "", "x", "x", "word " * 3000], [None, 1, 2, 2, 3])
        step(spark, docs, sf).collect()
        assert step(spark, docs.where("1 = 0"), sf).count() == 0
