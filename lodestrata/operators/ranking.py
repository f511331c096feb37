"""Ranking: BM25, exact cosine, reciprocal-rank fusion, parent diversity.

Every ranker works for all queries at once. scope names the columns within which a query searches,
for example document_id; statistics are grouped by them and retrieval is an equi-join on them.
Rankings are (query_id, chunk_id, rank, score), ranked by score, then chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.text import lexical_tokens, query_tokens
from lodestrata.session import cut, parallelism

K1, B, EPSILON, DELTA = 1.5, 0.75, 0.25, 1.0
#: Ids of units that are sent to each query at once to fill its ranking.
FILLERS = 1_000


def top_k(scored: DataFrame, k: int, digits: int | None = 9) -> DataFrame:
    """The k best rows of each query, ranked. Scores that agree to so many digits are ties."""
    by = F.round("score", digits) if digits is not None else F.col("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by.desc(), F.col("chunk_id").asc()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_postings(units: DataFrame, scope: Sequence[str], text: str = "text") -> DataFrame:
    """The index: (*scope, chunk_id, dl, term, tf) of units (chunk_id, *scope, text), written once.

    Everything a search needs follows from it, so texts are read and cut into words once. Pass it to
    bm25() in place of units to search it again.
    """
    tokens = units.select(*scope, "chunk_id", lexical_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    terms = tokens.select(*scope, "chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return cut(terms.groupBy(*scope, "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def _lengths(postings: DataFrame, scope: Sequence[str]) -> DataFrame:
    return postings.groupBy(*scope, "chunk_id").agg(F.max("dl").alias("dl"))


def bm25_statistics(postings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(*scope, n_units, avg_length, n_terms) of each scope."""
    sizes = _lengths(postings, scope).groupBy(*scope).agg(F.count(F.lit(1)).alias("n_units"), F.avg("dl").alias("avg_length"))
    return sizes.join(postings.groupBy(*scope).agg(F.count_distinct("term").alias("n_terms")), list(scope))


def _idf(postings: DataFrame, scope: Sequence[str], variant: str) -> DataFrame:
    """(*scope, term, idf, avgdl) of every term of a scope."""
    df = postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = _lengths(postings, scope).groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    if not scope:
        one = sizes.first()
        joined = df.withColumn("n", F.lit(one.n if one else 0)).withColumn("avgdl", F.lit(float(one.avgdl or 0) if one else 0.0))
    else:
        joined = df.join(sizes, list(scope))
    if variant == "plus":
        return joined.select(*scope, "term", "avgdl", (F.log(F.col("n") + 1.0) - F.log(F.col("df").cast("double"))).alias("idf"))
    raw = joined.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # frequent terms get a share of the scope's mean, taken over its vocabulary
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean"))
    raw = raw.join(mean, list(scope)) if scope else raw.withColumn("mean", F.lit(float(mean.first()["mean"] or 0)))
    return raw.select(*scope, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _first_ids(queries: DataFrame, scores: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id) of at least the k smallest ids that each query hasn't met, as far as there are.

    A query that met m units finds them among the k + m smallest ids. Up to FILLERS of those are
    sent to it at once; queries that met more have the others joined by place, which sends each no
    more ids than it met.
    """
    met = queries.select("query_id").join(scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left").select("query_id", (F.coalesce("m", F.lit(0)) + k).alias("reach"))
    first = [r.chunk_id for r in units.select("chunk_id").orderBy("chunk_id").limit(FILLERS).collect()]
    listed = F.array(*map(F.lit, first)).cast(f"array<{units_type(units, 'chunk_id')}>")
    near = met.select("query_id", F.explode(F.slice(listed, F.lit(1), F.least("reach", F.lit(FILLERS)).cast("int"))).alias("chunk_id")) if first else met.select("query_id", F.lit(None).cast(units_type(units, "chunk_id")).alias("chunk_id")).limit(0)
    far = met.where(F.col("reach") > FILLERS)
    if len(first) < FILLERS or far.isEmpty():
        return near
    # places in the order of ids, counted over range partitions
    ordered = cut(units.select("chunk_id").repartitionByRange(parallelism(units.sparkSession), "chunk_id").sortWithinPartitions("chunk_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    placed = ordered.select("chunk_id", (F.try_element_at(start, F.col("part")) + F.col("at")).alias("place"))
    beyond = far.select("query_id", F.explode(F.sequence(F.lit(FILLERS).cast("long"), F.col("reach").cast("long") - 1)).alias("place")).join(placed, "place").select("query_id", "chunk_id")
    return near.unionByName(beyond)


def merged(df: DataFrame) -> DataFrame:
    """df, for a join by sorting: before arrays and texts are taken apart its size is guessed far too low, and a broadcast passes through the driver."""
    return df.hint("merge")


def asked_terms(queries: DataFrame, scope: Sequence[str], query_text: str = "query_text", normalize_query: bool = False) -> DataFrame:
    """(query_id, *scope, term, times) of queries (query_id, *scope, query_text)."""
    words = query_tokens(F.col(query_text)) if normalize_query else lexical_tokens(F.col(query_text))
    return queries.select("query_id", *scope, F.explode(words).alias("term")).groupBy("query_id", *scope, "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_asked(units: DataFrame, terms: DataFrame, scope: Sequence[str], text: str = "text") -> DataFrame:
    """What terms (*scope, term) need of units (chunk_id, *scope, text), written once: (*scope, chunk_id, dl, term, df, n).

    Rows with a chunk_id are the occurrences of asked terms, n each, and one of no term for a unit
    without any; the others say how many terms of a scope lie in df of its units each. Scopes that
    no query asks are left out. Terms that no query asks are counted where they are cut from the
    texts and go no further, so this is a small part of bm25_postings().
    """
    scope = list(scope)
    wanted = terms.groupBy(*scope).agg(F.collect_set("term").alias("asked"))
    # one string of words, since arrays of them take several times the room
    tokens = units.select(*scope, "chunk_id", F.array_join(lexical_tokens(F.col(text)), " ").alias("words"))
    held = tokens.join(merged(wanted), scope).withColumn("tokens", F.when(F.col("words") != "", F.split("words", " ")))
    # both parts read the words as they lie by scope, so they are cut and shuffled once; outer explodes,
    # since others are preceded by a filter that would cut the texts again
    known = held.select(*scope, "chunk_id", F.explode_outer(F.array_distinct("tokens")).alias("term")).groupBy(*scope, "term").agg(F.count("chunk_id").alias("df")).where("term IS NOT NULL")
    spread = known.groupBy(*scope, "df").agg(F.count(F.lit(1)).alias("n"))
    hits = held.select(*scope, "chunk_id", "tokens", F.array_intersect("tokens", "asked").alias("hits"))
    hits = hits.select(*scope, "chunk_id", F.size("tokens").alias("dl"), F.explode_outer(F.filter("tokens", lambda t: F.array_contains("hits", t))).alias("term"))
    hits = hits.groupBy(*scope, "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("n"))
    return cut(hits.unionByName(spread, allowMissingColumns=True), release=True)


def _asked_parts(asked: DataFrame, scope: Sequence[str], variant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of bm25_asked(): postings and idf (*scope, term, idf, avgdl) of asked terms, and lengths of all units."""
    scope = list(scope)
    of_units = asked.where("chunk_id IS NOT NULL AND dl > 0")
    postings = of_units.where("term IS NOT NULL").select(*scope, "chunk_id", "dl", "term", F.col("n").alias("tf"))
    lengths = _lengths(of_units, scope)
    sizes = lengths.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    if variant == "plus":
        return postings, df.join(merged(sizes), scope).select(*scope, "term", "avgdl", (F.log(F.col("n") + 1.0) - F.log(F.col("df").cast("double"))).alias("idf")), lengths
    # frequent terms get a share of the scope's mean, taken over its vocabulary
    spread = asked.where("df IS NOT NULL").select(*scope, "df", F.col("n").alias("times")).join(merged(sizes), scope)
    mean = spread.groupBy(*scope, "n", "avgdl").agg((F.sum(F.col("times") * raw) / F.sum("times")).alias("mean"))
    joined = df.join(merged(mean), scope).withColumn("raw", raw)
    return postings, joined.select(*scope, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")), lengths


def bm25(
    units: DataFrame, queries: DataFrame, *, k: int = 5, scope: Sequence[str] = ("document_id",), variant: str = "okapi",
    normalize_query: bool = False, text: str = "text", query_text: str = "query_text", digits: int | None = 9,
) -> DataFrame:
    """The k best units of each query.

    units: (chunk_id, *scope, text), or the postings of them, or what bm25_asked() has of them for
    these queries; queries: (query_id, *scope, query_text). Query terms count as
    often as they occur, unknown ones add nothing, and units without any term stay in the ranking
    with score 0, as far as they are needed to fill k. Units and queries without tokens take no part.
    """
    if variant not in ("okapi", "plus"):
        raise ValueError("variant must be okapi or plus")
    scope = list(scope)
    terms = asked_terms(queries, scope, query_text, normalize_query)
    if "tf" in units.columns or not scope:
        postings = units if "tf" in units.columns else bm25_postings(units, scope, text)
        idf, lengths = _idf(postings, scope, variant), _lengths(postings, scope)
    else:
        postings, idf, lengths = _asked_parts(units if {"dl", "df"} <= set(units.columns) else bm25_asked(units, terms, scope, text), scope, variant)
    # weights of query terms only, found once: the statistics never meet the postings of other terms
    weights = cut(terms.join(merged(idf), [*scope, "term"]), release=True)
    met = weights.join(merged(postings), [*scope, "term"])
    tfn = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = cut(met.groupBy("query_id", *scope, "chunk_id").agg(F.sum(F.col("times") * F.col("idf") * tfn).alias("score")), release=True)
    asked = terms.groupBy("query_id", *scope).agg(F.count(F.lit(1)).alias("n_terms"))
    if variant == "plus":
        # a term adds its idf to every unit of the scope, with or without the term
        base = weights.groupBy("query_id", *scope).agg(F.sum(F.col("times") * F.col("idf") * DELTA).alias("base"))
        asked = asked.join(merged(base), ["query_id", *scope], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    else:
        asked = asked.withColumn("base", F.lit(0.0))
    # only queries with fewer than k units above the base need the others
    enough = scores.where(F.round("score", 9) > 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("above"))
    needy = asked.join(merged(enough), "query_id", "left").where(F.coalesce("above", F.lit(0)) < k).select("query_id", *scope)
    if scope:
        idle = needy.join(merged(lengths.select(*scope, "chunk_id")), scope)
    else:
        idle = _first_ids(needy, scores, lengths.select("chunk_id"), k)
    idle = idle.join(merged(scores.select("query_id", "chunk_id")), ["query_id", "chunk_id"], "left_anti").select("query_id", *scope, "chunk_id", F.lit(0.0).alias("score"))
    whole = scores.unionByName(idle).join(merged(asked.select("query_id", "base")), "query_id")
    return top_k(whole.select("query_id", "chunk_id", (F.col("score") + F.col("base")).alias("score")), k, digits)


def l2_normalized(vector: Column) -> Column:
    """The vector in doubles at length 1; null for null, zero and non-finite vectors."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((norm > 0) & (norm < F.lit(float("inf"))), F.transform(v, lambda x: x / norm))


def dense(units: DataFrame, queries: DataFrame, *, k: int = 5, scope: Sequence[str] = (), block_rows: int = 20_000, query_rows: int = 4_000, digits: int | None = 9) -> DataFrame:
    """The k nearest units of each query by exact cosine.

    units: (chunk_id, *scope, embedding), queries: (query_id, *scope, embedding). Queries and units
    are cut into blocks of bounded size and every pair of blocks that may meet is one matrix
    product, which sends on k rows a query. Within a scope only blocks of that scope meet; small
    scopes share a task, and one that holds many units or queries is cut by hash. Null and zero
    vectors take no part, nor do null scopes.
    """
    scope = list(scope)
    u = units.select("chunk_id", *scope, l2_normalized(F.col("embedding")).alias("u")).where(F.col("u").isNotNull())
    q = queries.select("query_id", *scope, l2_normalized(F.col("embedding")).alias("q")).where(F.col("q").isNotNull())
    n_units, n_queries = units.count(), queries.count()
    blocks = lambda n, rows: F.greatest(F.lit(1), F.ceil(n / rows)).cast("int")
    if scope:
        # scopes that both sides have, the blocks of each, and the task that small ones share
        sizes = u.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).join(q.groupBy(*scope).agg(F.count(F.lit(1)).alias("m")), scope)
        tasks = max(1, -(-n_units // block_rows), -(-n_queries // query_rows))
        plan = sizes.select(*scope, F.xxhash64(*scope).alias("part"), F.pmod(F.xxhash64(*scope), F.lit(tasks)).alias("task"), blocks(F.col("n"), block_rows).alias("us"), blocks(F.col("m"), query_rows).alias("qs"))
        u, q = u.join(plan, scope), q.join(plan, scope)
    else:
        fixed = [F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("task"), blocks(F.lit(n_units), block_rows).alias("us"), blocks(F.lit(n_queries), query_rows).alias("qs")]
        u, q = u.select("*", *fixed), q.select("*", *fixed)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # columns of one frame on both sides need names of their own
    named = lambda *names: [F.col(c).alias(c) for c in names]
    u = u.select("chunk_id", "u", *named("part", "task"), own("chunk_id", "us").alias("ub"), each("qs").alias("qb"))
    q = q.select("query_id", "q", *named("part", "task"), own("query_id", "qs").alias("qb"), each("us").alias("ub"))

    def product(queries_: pd.DataFrame, units_: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": queries_["query_id"][:0], "chunk_id": units_["chunk_id"][:0], "score": np.zeros(0)})]
        held = dict(tuple(units_.groupby("part"))) if len(units_) else {}
        for part, asked in queries_.groupby("part") if len(queries_) else ():
            if part not in held:
                continue
            ids = held[part]["chunk_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            table, ids = np.stack(held[part]["u"].to_numpy()[order]), ids[order]
            kept = min(k, len(ids))
            for start in range(0, len(asked), 256):
                some = asked.iloc[start : start + 256]
                s = np.stack(some["q"].to_numpy()) @ table.T
                best = np.argsort(-np.round(s, digits) if digits is not None else -s, axis=1, kind="stable")[:, :kept]
                found.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), kept), "chunk_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(found[1:] or found, ignore_index=True)

    schema = f"query_id {units_type(queries, 'query_id')}, chunk_id {units_type(units, 'chunk_id')}, score double"
    groups = ["task", "qb", "ub"]
    return top_k(q.groupBy(*groups).cogroup(u.groupBy(*groups)).applyInPandas(product, schema), k, digits)


def units_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def rrf(bm25_ranking: DataFrame, dense_ranking: DataFrame, *, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Fusion of two rankings by the sum of 1 / (rrf_k + rank); component ranks are kept."""
    a = bm25_ranking.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    b = dense_ranking.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", part("bm25_rank") + part("dense_rank"))
    return top_k(fused, k, None)


def diversify(ranking: DataFrame, *, k: int = 5, rows_per_parent: int = 2, kind: str = "retrieval_unit_kind", parent: str = "parent_source_element_ids") -> DataFrame:
    """At most rows_per_parent table rows of one parent in each ranking, re-ranked and cut to k.

    A row's parent are the elements of its parent, else its parent chunk, else itself. Caps of
    different parents don't depend on each other, so a window says what a greedy pass would.
    """
    row = F.col(kind) == "table_row"
    above = F.nullif(F.trim("parent_chunk_id"), F.lit("")) if "parent_chunk_id" in ranking.columns else F.lit(None).cast("string")
    of = F.when(F.size(parent) > 0, F.col(parent)).otherwise(F.array(F.coalesce(above, "chunk_id")))
    turn = F.row_number().over(Window.partitionBy("query_id", "document_id", of, row).orderBy("rank"))
    kept = ranking.withColumn("_turn", turn).where(~row | (F.col("_turn") <= rows_per_parent) | row.isNull()).drop("_turn")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def rerank(ranking: DataFrame) -> DataFrame:
    """Ranks without gaps, in the order there was."""
    return ranking.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def invalid_rankings(ranking: DataFrame) -> DataFrame:
    """Queries whose ranks don't run from 1 without gaps, or that name a chunk twice."""
    seen = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.count_distinct("rank").alias("ranks"), F.count_distinct("chunk_id").alias("chunks"))
    return seen.where((F.col("n") != F.col("last")) | (F.col("first") != 1) | (F.col("n") != F.col("ranks")) | (F.col("n") != F.col("chunks")))


def hybrid(units: DataFrame, queries: DataFrame, unit_vectors: DataFrame, query_vectors: DataFrame, *, scope: Sequence[str] = ("document_id",), k: int = 5, candidates: int = 20, rrf_k: int = 60, variant: str = "plus", normalize_query: bool = True, rows_per_parent: int | None = 2, postings: DataFrame | None = None) -> DataFrame:
    """BM25 and cosine candidates, fused, made diverse and cut to k. With postings the units need no text."""
    depth = max(k, candidates)
    lexical = bm25(units if postings is None else postings, queries, k=depth, scope=scope, variant=variant, normalize_query=normalize_query)
    vectors = units.select("chunk_id", *scope).join(unit_vectors, "chunk_id")
    near = dense(vectors, queries.select("query_id", *scope).join(query_vectors, "query_id"), k=depth, scope=scope)
    fused = rrf(lexical, near, k=depth, rrf_k=rrf_k)
    if rows_per_parent is None:
        return fused.where(F.col("rank") <= k)
    lineage = units.select("chunk_id", "document_id", "retrieval_unit_kind", "parent_source_element_ids", *(["parent_chunk_id"] if "parent_chunk_id" in units.columns else []))
    return diversify(fused.join(lineage, "chunk_id"), k=k, rows_per_parent=rows_per_parent)


def hashed_vectors(texts: DataFrame, key: str, text: str, dimensions: int = 32) -> DataFrame:
    """(key, embedding) without a model: signed counts of tokens by hash; a stand-in for an encoder.

    Texts may also be the postings of bm25_postings(), whose words are cut already. Sums are taken
    before the shuffle. Texts without tokens have no vector.
    """
    cut_already = {"term", "tf"} <= set(texts.columns)
    terms = texts.select(key, F.col("term").alias("t"), F.col("tf").cast("double").alias("n")) if cut_already else texts.select(key, F.explode(lexical_tokens(F.col(text))).alias("t"), F.lit(1.0).alias("n"))
    h = terms.select(key, "n", F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long").alias("h"))
    sign = F.when((F.col("h") / dimensions).cast("long") % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    signed = h.select(key, (F.col("h") % dimensions).cast("int").alias("i"), sign.alias("s"))
    sums = signed.groupBy(key).agg(*[F.sum(F.when(F.col("i") == i, F.col("s")).otherwise(0.0)).alias(f"v{i}") for i in range(dimensions)])
    return sums.select(key, F.array(*[f"v{i}" for i in range(dimensions)]).alias("embedding"))


Encoder = Callable[[list[str]], np.ndarray]


def checked_vectors(encoder: Encoder, texts: list[str], dimension: int | None = None) -> np.ndarray:
    """Unit vectors of texts, one each, as the contract of an encoder wants them.

    A wrong number of vectors, another dimension, zero vectors and what isn't finite raise.
    """
    vectors = np.asarray(encoder(texts), np.float32)
    if vectors.ndim != 2 or len(vectors) != len(texts) or (dimension is not None and vectors.shape[1] != dimension):
        raise ValueError(f"an encoder gave {vectors.shape} for {len(texts)} texts of dimension {dimension}")
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    if not np.isfinite(norms).all() or (norms == 0).any():
        raise ValueError("an encoder gave a vector that is zero or isn't finite")
    return (vectors / norms).astype(np.float32)


def encode_missing(texts: DataFrame, cached: DataFrame | None, encoder: Encoder, *, model: str, revision: str, batch: int = 32, dimension: int | None = None) -> DataFrame:
    """(chunk_id, text_sha256, model, revision, embedding) of the texts that the cache doesn't hold.

    texts: (chunk_id, text). A cached row counts only with the same model, revision and text. The
    encoder runs in the executors' Python; its vectors are checked and brought to length 1.
    """
    wanted = texts.select("chunk_id", "text", F.sha2("text", 256).alias("text_sha256"), F.lit(model).alias("model"), F.lit(revision).alias("revision"))
    if cached is not None:
        wanted = wanted.join(cached.select("chunk_id", "text_sha256", "model", "revision"), ["chunk_id", "text_sha256", "model", "revision"], "left_anti")

    def encoded(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            vectors = [v for i in range(0, len(pdf), batch) for v in checked_vectors(encoder, pdf["text"].iloc[i : i + batch].tolist(), dimension)]
            yield pdf.drop(columns="text").assign(embedding=[v.tolist() for v in vectors])

    return wanted.where(F.col("text").isNotNull()).select("chunk_id", "text_sha256", "model", "revision", "text").mapInPandas(encoded, "chunk_id string, text_sha256 string, model string, revision string, embedding array<float>")
