"""The pipeline as a whole against its stages' rules, on the smallest tables and on empty ones."""

import pytest

import corpus_pipeline as P
from attesta.llm import decontaminate, pii, quality_rules
from attesta.llm.common import table
from test_llm_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages_by_hand(spark):
    got = P.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    scores = {r["doc_id"]: r["score"] for r in quality_rules.score_quality(docs, quality_rules.train(docs, table(spark, SF, "labels"))).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] >= 0.5]
    owner = brute_components(rows, 5, 4, 5)
    rows = [(i, t) for i, t in rows if owner[i][1] == i]
    items = [decontaminate.normalise(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    held = decontaminate.Items(list(enumerate(items)), 0.1)
    kept = {i for i, t in rows if not held.find(decontaminate.normalise(t))}
    assert all(not any(x in decontaminate.normalise(t) for x in items) for i, t in rows if i in kept)
    assert {r["doc_id"] for r in got} == kept
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 1024


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_empty_tables_and_clashing_columns(spark, name, stage):
    docs = table(spark, SF, "documents").limit(0).selectExpr("*", "1 AS id", "'x' AS key")
    out = stage(spark, docs, SF)
    assert out.count() == 0
    if name != P.STAGES[-1][0]:
        assert set(out.columns) == set(docs.columns)


def test_personal_data_goes_and_rows_stay(spark):
    docs = table(spark, SF, "documents").selectExpr("doc_id", "concat(text, ' mail ann@example.com') AS text", "lang", "source", "n_chars")
    out = {r["doc_id"]: r for r in P.personal_data(spark, docs, SF).collect()}
    assert len(out) == docs.count()
    for r in out.values():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
