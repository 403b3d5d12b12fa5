"""The corpus pipeline: stage by stage against the operators' definitions."""

from helpers import SF, classes_by_definition, edge_docs, left_by_definition

import pytest

import corpus_pipeline
from tillroll.llm import queries, suffix_dedup
from tillroll.llm.common import table, written


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), "test")
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == seen[name].dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = {r.doc_id for r in queries.op5(spark, SF).where("kept").collect()}
    assert ids(seen["quality_classifier"]) == kept
    scored = {r.doc_id for r in queries.op1(spark, SF).where("predicted = 1").collect()}
    after = ids(seen["near_dedup"])
    assert after <= kept and len(after & scored) >= 0.95 * len(kept & scored)
    rows = sorted((r.doc_id, r.text) for r in seen["near_dedup"].collect())
    heads = classes_by_definition([t for _, t in rows])
    assert ids(seen["suffix_dedup"]) == {rows[k][0] for k in set(heads)}
    rows = sorted((r.doc_id, r.text) for r in seen["suffix_dedup"].collect())
    texts = [t for _, t in rows]
    stripped = {r.doc_id: r for r in seen["packing"].collect()}
    assert set(stripped) == {k for k, _ in rows}
    for k, text in rows:
        assert stripped[k].text == left_by_definition(text, texts, suffix_dedup.WORDS_50)
        assert stripped[k].n_chars == len(stripped[k].text)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(stripped)
    assert all(len(r.ids) == 4 * r.length for r in packed)


def test_registered(spark):
    assert queries.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "suffix_dedup", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edge_rows(spark, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns; and no rows at all."""
    columns = corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES:
        docs = edge_docs(spark, empty)
        out = written(stage(spark, docs, SF), "test")
        assert name == "packing" or out.columns == columns
        rows = out.collect()
        assert not (empty and rows)
        if empty:
            continue
        ids = [r.doc_id for r in rows]
        if name == "quality_rules":
            assert ids == [4]
        elif name == "quality_classifier":
            assert set(ids) <= {r.doc_id for r in docs.collect()}
        elif name == "near_dedup":
            assert sorted(map(str, ids)) == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])
        elif name == "suffix_dedup":
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in docs.collect())
            assert {r.text for r in rows if r.doc_id in (1, 2, 5)} == {None, "", "one two three four five six"}
        else:
            assert set(ids) == {r.doc_id for r in docs.collect()}
