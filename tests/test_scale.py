"""What queries send through the driver and write between their steps."""

from __future__ import annotations

import pytest
from lodestrata.operators import linkage, ranking
from lodestrata.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gold_removed_topk", "grounded_prompts", "ranking_validity", "retrieval_per_query", "evidence_match", "refusal_guard", "training_record_violations"])
def test_no_table_passes_through_the_driver(spark, small, name):
    """Sizes are guessed before texts are taken apart, so a broadcast of what looks small fills the driver."""
    assert "BroadcastExchange" not in plan(queries.QUERIES[name](spark, small))


def test_only_asked_terms_are_written(spark):
    units = spark.createDataFrame([("d", "a", "net sales rose"), ("d", "b", "the board met"), ("d", "c", "..."), ("e", "x", "net")], "document_id string, chunk_id string, text string")
    terms = spark.createDataFrame([("d", "net"), ("d", "met"), ("d", "unknown")], "document_id string, term string")
    got = ranking.bm25_asked(units, terms, ["document_id"])
    assert {(r.chunk_id, r.term, r.n) for r in got.where("term IS NOT NULL").collect()} == {("a", "net", 1), ("b", "met", 1)}
    assert [(r.document_id, r.df, r.n) for r in got.where("df IS NOT NULL").collect()] == [("d", 1, 6)]


def test_evidence_of_a_crowded_document_is_matched_alike(spark, monkeypatch):
    units = spark.createDataFrame([("d", f"c{i}", i, f"item {i} of {i * 7} million and subtotal {i * 3}") for i in range(12)], "document_id string, chunk_id string, chunk_index int, text string")
    facts = spark.createDataFrame([(i, "d", t) for i, t in enumerate(["item 3 of 21 million", "subtotal 33", "tem 5 of 35 mill", "item 4 of 28 thousand", "million", "..."])], "fact_id long, document_id string, evidence string")
    found = lambda: sorted((r.fact_id, r.chunk_id, round(r.score, 6)) for r in linkage.match_evidence(facts, units).collect())
    direct = found()
    monkeypatch.setattr(linkage, "CROWDED", 2)
    assert direct == found() and {x[0] for x in direct} == {0, 1, 2, 3, 4}
