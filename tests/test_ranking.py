from __future__ import annotations

import math
from collections import Counter

import pytest
from lodestrata.functions import text
from lodestrata.operators import ranking
from pyspark.sql import functions as F


def tokens(spark, s, query=False):
    f = text.query_tokens if query else text.lexical_tokens
    return spark.range(1).select(f(F.lit(s)).alias("t")).first().t


def test_tokens_keep_decimals_and_signs(spark):
    assert tokens(spark, "Revenue of $2.6M, up 5%") == ["revenue", "of", "$", "2.6m", "up", "5", "%"]
    assert tokens(spark, "a..b .c. 1,000.5,") == ["a", "b", "c", "1,000.5"]
    assert tokens(spark, "What is the revenue revenue", True) == ["revenue"]
    assert tokens(spark, "what is the", True) == ["what", "is", "the"]


def test_very_long_number_lists_dont_exhaust_the_stack(spark):
    assert len(tokens(spark, ",".join(["123456"] * 50_000))) == 1
    assert len(tokens(spark, "1. " * 50_000)) == 50_000


UNITS = [("d1", "a", "net sales rose 5 %"), ("d1", "b", "net income fell"), ("d1", "c", "the board met"), ("d2", "a2", "net sales"), ("d1", "e", None), ("d1", "f", "...")]


def brute(units, query, variant):
    toks = {c: t.split() for _, c, t in units}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) if variant == "okapi" else math.log(n + 1) - math.log(d) for w, d in df.items()}
    if variant == "okapi":
        mean = sum(idf.values()) / len(idf)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    scores = {}
    for c, t in toks.items():
        tf = Counter(t)
        scores[c] = sum(idf.get(w, 0) * ((1 if variant == "plus" and w in idf else 0) + tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))) for w in query.split())
    return scores


@pytest.mark.parametrize("variant", ["okapi", "plus"])
def test_bm25_equals_the_formula_and_fills_with_zeros(spark, variant):
    units = spark.createDataFrame(UNITS, "document_id string, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "d1", "net sales sales unknownword"), (2, "d3", "net"), (3, "d1", "!!")], "query_id long, document_id string, query_text string")
    got = {r.chunk_id: (r.rank, r.score) for r in ranking.bm25(units, queries, k=10, variant=variant).collect()}
    want = brute([u for u in UNITS[:3]], "net sales sales unknownword", variant)
    assert set(got) == {"a", "b", "c"}
    order = sorted(want, key=lambda c: (-round(want[c], 9), c))
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1][0])] == order
    assert all(got[c][1] == pytest.approx(want[c]) for c in want)


def test_bm25_over_the_whole_corpus(spark):
    units = spark.createDataFrame(UNITS, "document_id string, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "sales")], "query_id long, query_text string")
    got = [(r.rank, r.chunk_id) for r in ranking.bm25(units, queries, k=3, scope=(), variant="plus").orderBy("rank").collect()]
    assert got[0] == (1, "a2") and len(got) == 3


def test_dense_blocks_equal_one_block(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    one = {tuple(r) for r in ranking.dense(v, q, k=4).select("query_id", "chunk_id", "rank").collect()}
    many = {tuple(r) for r in ranking.dense(v, q, k=4, block_rows=7, query_rows=2).select("query_id", "chunk_id", "rank").collect()}
    assert one == many and one
    assert not [r for r in one if r[1] == 0 and rows[0][1] == [0.0] * 5]


def test_rrf_with_empty_sides_and_ties(spark):
    s = "query_id long, chunk_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], s)
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], s)
    got = [(r.chunk_id, r.rank) for r in ranking.rrf(a, b).orderBy("rank").collect()]
    assert got == [("y", 1), ("x", 2), ("z", 3)]
    assert ranking.rrf(a, b.limit(0)).count() == 2 and ranking.rrf(a.limit(0), b.limit(0)).count() == 0


def test_diversity_caps_rows_of_one_parent(spark):
    rows = [(1, f"r{i}", i, "d", "table_row", ["t"]) for i in range(1, 5)] + [(1, "n", 5, "d", "narrative", ["t"]), (1, "o", 6, "d", "table_row", ["u"])]
    r = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, document_id string, retrieval_unit_kind string, parent_source_element_ids array<string>")
    got = [(x.chunk_id, x.rank) for x in ranking.diversify(r, k=4).orderBy("rank").collect()]
    assert got == [("r1", 1), ("r2", 2), ("n", 3), ("o", 4)]


def test_invalid_rankings_are_named(spark):
    s = "query_id long, chunk_id string, rank int"
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 3), (3, "a", 1), (3, "a", 2)], s)
    assert {x.query_id for x in ranking.invalid_rankings(r).collect()} == {2, 3}


def test_cache_encodes_only_what_is_missing(spark):
    import numpy as np

    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "chunk_id string, text string")
    encode = lambda ts: np.array([[len(t), 1.0] for t in ts])
    first = ranking.encode_missing(texts, None, encode, model="m", revision="1")
    assert {r.chunk_id for r in first.collect()} == {"a", "b"}
    cache = first.where("chunk_id = 'a'")
    assert {r.chunk_id for r in ranking.encode_missing(texts, cache, encode, model="m", revision="1").collect()} == {"b"}
    assert ranking.encode_missing(texts, cache, encode, model="m", revision="2").count() == 2
    for wrong in (np.zeros((1, 2)), np.full((1, 2), np.nan), np.ones((2, 2)), np.ones((1, 3))):
        with pytest.raises(ValueError, match="encoder"):
            ranking.checked_vectors(lambda ts: wrong, ["a"], 2)


def test_scoped_vectors_equal_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    units = [(f"u{i:03}", "hot" if i % 3 else f"d{i % 7}", rnd.normal(size=4).tolist()) for i in range(200)] + [("z", "hot", [0.0] * 4), ("n", None, [1.0] * 4)]
    queries = [(i, "hot" if i % 2 else f"d{i % 7}", rnd.normal(size=4).tolist()) for i in range(60)] + [(99, "none", [1.0] * 4)]
    u = spark.createDataFrame(units, "chunk_id string, document_id string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, document_id string, embedding array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for i, d, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(w)), 9), c) for c, e, w in units if e == d and c != "z")[:3]
        if scored:
            want[i] = [c for _, c in scored]
    got = {}
    for r in ranking.dense(u, q, k=3, scope=["document_id"], block_rows=20, query_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


def test_fillers_without_a_scope(spark, monkeypatch):
    """Queries that met more units than are sent at once still fill their ranking with the first ids."""
    monkeypatch.setattr(ranking, "FILLERS", 3)
    units = spark.createDataFrame([(f"u{i:02}", "common") for i in range(12)] + [(f"v{i:02}", "rare") for i in range(3)], "chunk_id string, text string")
    scores = spark.createDataFrame([(1, f"u{i:02}") for i in range(9)] + [(2, "u01")], "query_id long, chunk_id string")
    got = ranking._first_ids(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), scores, units, 2)
    left = {(r.query_id, r.chunk_id) for r in got.collect()} - {(r.query_id, r.chunk_id) for r in scores.collect()}
    per = {i: sorted(c for q, c in left if q == i)[:2] for i in (1, 2, 3)}
    assert per == {1: ["u09", "u10"], 2: ["u00", "u02"], 3: ["u00", "u01"]}
