"""Every operator and the pipeline over odd rows, and over empty tables."""

import importlib.util

import pytest

from lakeloom.llm.queries import queries

PER_ROW = ["op1_fingerprints", "op2_neardup", "op3_pii", "op4_language_id", "op5_decontamination", "op6_katz", "op7_sharding", "op9_quality"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_rows(spark, odd, name):
    folder, docs, _ = odd
    rows = queries()[name](spark, folder).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in docs)
    if name == "op10_packing":
        assert {r["doc_id"] for r in rows} == {d[0] for d in docs}
    if name == "op8_passages":
        assert {(r["doc_id"], r["other_id"]) for r in rows} >= {(2, 1), (11, 10)}


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline goes with its folder")
def test_pipeline_on_odd_and_empty(spark, odd, empty):
    import corpus_pipeline

    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, odd[0]).collect()}
    assert {1, 8, 13, 14} <= ids and not ids & {2, 3, 4, 5, 6, 7, 9}
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_defined_values(spark, odd):
    folder, docs, _ = odd
    got = {r["doc_id"]: r for r in queries()["op2_neardup"](spark, folder).collect() if r["doc_id"] is not None}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert [(got[i]["n_shingles"], got[i]["kept"]) for i in (5, 6, 7, 8)] == [(0, True), (0, True), (0, True), (1, True)]
    assert got[11]["component_id"] == 10
    nulls = [r for r in queries()["op2_neardup"](spark, folder).collect() if r["doc_id"] is None]
    assert all(r["component_id"] is None and r["kept"] for r in nulls)
    und = {r["doc_id"]: r for r in queries()["op4_language_id"](spark, folder).collect()}
    assert all(und[i]["lang_pred"] == "und" and und[i]["score"] == 0 for i in (5, 6, 7, 9, 18))
    pii = {r["doc_id"]: r for r in queries()["op3_pii"](spark, folder).collect()}
    assert [pii[14][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    lm = {r["doc_id"]: r for r in queries()["op6_katz"](spark, folder).collect()}
    assert lm[5]["n_tokens"] == lm[6]["n_tokens"] == 1 and lm[8]["n_tokens"] == 2
