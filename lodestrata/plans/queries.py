"""Queries that show each operator of the library on the tables of a data folder, whole tables each.

units are searched, examples.question are the questions, supporting_facts the gold evidence.
Deliveries of one key count once, by the latest (operators.windows.latest).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import ids, text
from lodestrata.operators import chunker, constraints, evaluation, export, integrity, linkage, normalize, prompts, ranking, sampling, scoring, tables
from lodestrata.operators.windows import char_windows, latest
from lodestrata.session import cut
from lodestrata.sources.tables import table
from lodestrata.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
DIMENSIONS = 32


# --- inputs --------------------------------------------------------------------------------------


#: Columns of units that say where they come from; texts stay where they are read.
_LINEAGE = ("document_id", "source_element_ids")
#: What the running query has computed already, so that texts are read and cut into words once.
_HELD: ContextVar[dict | None] = ContextVar("held", default=None)


def _units(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return latest(table(spark, folder, "units"), "chunk_id", keep=keep or None)


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    held = _HELD.get()
    if held is None:
        held = {}
    if "postings" not in held:
        held["postings"] = ranking.bm25_postings(_units(spark, folder, "document_id", "text"), ["document_id"])
    return held["postings"]


def _asked_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The questions, written once for the steps of a ranking."""
    held = _HELD.get()
    if held is None:
        held = {}
    if "questions" not in held:
        held["questions"] = cut(_questions(spark, folder), release=True)
    return held["questions"]


def _asked_index(spark: SparkSession, folder: str, normalize_query: bool) -> DataFrame:
    """What rankings by BM25 need of the units; queries that also need vectors take the postings of all terms."""
    held = _HELD.get()
    if held is None:
        held = {}
    if ("asked", normalize_query) not in held:
        terms = ranking.asked_terms(_asked_questions(spark, folder), ["document_id"], normalize_query=normalize_query)
        held["asked", normalize_query] = ranking.bm25_asked(_units(spark, folder, "document_id", "text"), terms, ["document_id"])
    return held["asked", normalize_query]


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "elements").drop("metadata"), "element_id")


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "examples").select(
        "record_no", "dataset", "split", "example_id", F.col("question.document_id").alias("document_id"), F.col("question.text").alias("query_text"),
        F.try_element_at(F.col("question.metadata"), F.lit("source_file")).alias("source_file"), F.col("question.question_type").alias("question_type"),
        F.col("reference_answer.text").alias("answer"), F.col("reference_answer.program").alias("program"), F.col("reference_answer.normalized_program").alias("normalized_program"),
        F.col("reference_answer.explanation").alias("explanation"), F.size("reference_answer.steps").alias("n_steps"), "supporting_facts", "received_at",
    )
    return latest(df, "record_no").withColumnRenamed("record_no", "query_id")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _examples(spark, folder).select("query_id", "document_id", "query_text")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = _examples(spark, folder).select("query_id", "document_id", F.posexplode("supporting_facts").alias("position", "f"))
    return facts.select("query_id", "document_id", "position", F.col("f.source_key").alias("source_key"), F.trim("f.element_id").alias("element_id"))


def _exports(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "rag_export"), "record_no")


def _vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    return ranking.hashed_vectors(df, key, column, DIMENSIONS)


def _bm25(spark: SparkSession, folder: str, k: int = 5, variant: str = "okapi", normalize_query: bool = False) -> DataFrame:
    questions = _asked_questions(spark, folder)
    if "postings" in (_HELD.get() or {}):
        return ranking.bm25(_postings(spark, folder), questions, k=k, variant=variant, normalize_query=normalize_query)
    return ranking.bm25(_asked_index(spark, folder, normalize_query), questions, k=k, variant=variant, normalize_query=normalize_query)


def _dense(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    postings, questions = _postings(spark, folder), _questions(spark, folder)
    u = _units(spark, folder, "document_id").join(_vectors(postings, "chunk_id", "text"), "chunk_id")
    q = questions.select("query_id", "document_id").join(_vectors(questions, "query_id", "query_text"), "query_id")
    return ranking.dense(u, q, k=k, scope=["document_id"])


def _shown(scored: DataFrame, *more: str) -> DataFrame:
    return scored.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), *more)


# --- texts and units -----------------------------------------------------------------------------


def char_windows_(spark: SparkSession, folder: str) -> DataFrame:
    return char_windows(table(spark, folder, "documents")).select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("text_md5"))


def lexical_terms(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "documents").select(F.explode(text.lexical_tokens(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def query_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("query_id", F.array_join(text.query_tokens(F.col("query_text")), " ").alias("tokens"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder, "text").select("chunk_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder, "document_id", "page_start", "chunk_index", "text").where("text IS NOT NULL")
    return u.select("chunk_id", ids.nul_digest(F.col("document_id"), F.col("page_start"), F.col("chunk_index"), F.col("text")).alias("digest"))


def bm25_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = ranking.bm25_statistics(_postings(spark, folder), ["document_id"])
    return stats.select("document_id", "n_units", F.round("avg_length", 6).alias("avg_length"), "n_terms")


# --- ranking -------------------------------------------------------------------------------------


def bm25_okapi_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_bm25(spark, folder))


def bm25_plus_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_bm25(spark, folder, variant="plus", normalize_query=True))


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    unit = table(spark, folder, "embeddings").select("vec_id", F.explode(ranking.l2_normalized(F.col("embedding"))).alias("x"))
    return unit.groupBy("vec_id").agg(F.round(F.sum("x"), 6).alias("total"), F.round(F.max("x"), 6).alias("largest"))


def dense_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100, against all others."""
    v = table(spark, folder, "embeddings")
    units = v.select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = ranking.dense(units, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k=6)
    return _shown(ranking.rerank(found.where("query_id <> chunk_id"))).where("rank <= 5")


def dense_scoped_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_dense(spark, folder))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    near = _dense(spark, folder, 20)  # first, so that both rank by its postings
    return _shown(ranking.rrf(_bm25(spark, folder, 20), near), "bm25_rank", "dense_rank")


def parent_diverse_topk(spark: SparkSession, folder: str) -> DataFrame:
    lineage = _units(spark, folder, "document_id", "retrieval_unit_kind", "parent_source_element_ids", "parent_chunk_id")
    found = ranking.diversify(_bm25(spark, folder, 20).join(lineage, "chunk_id"), k=5, rows_per_parent=1)
    return found.select("query_id", "chunk_id", "rank")


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    units, questions, postings = _units(spark, folder, "document_id", "retrieval_unit_kind", "parent_source_element_ids", "parent_chunk_id"), _questions(spark, folder), _postings(spark, folder)
    found = ranking.hybrid(units, questions, _vectors(postings, "chunk_id", "text"), _vectors(questions, "query_id", "query_text"), postings=postings)
    return _shown(found, "bm25_rank", "dense_rank")


def ranking_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Rankings that have gaps after their gold was taken out and before they are ranked anew."""
    units = _units(spark, folder, *_LINEAGE)
    touching = linkage.lineage(units).join(ranking.merged(_facts(spark, folder).select("query_id", "element_id")), "element_id").select("query_id", "chunk_id")
    return ranking.invalid_rankings(_bm25(spark, folder, 20).join(ranking.merged(touching), ["query_id", "chunk_id"], "left_anti"))


# --- evaluation ----------------------------------------------------------------------------------


def _evaluations(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    evals = evaluation.per_query(found, _facts(spark, folder), linkage.lineage(_units(spark, folder, *_LINEAGE)))
    return evals.join(ranking.merged(_examples(spark, folder).select("query_id", "dataset")), "query_id")


def retrieval_per_query(spark: SparkSession, folder: str) -> DataFrame:
    e = _evaluations(spark, folder, _bm25(spark, folder))
    return e.select("query_id", "first_relevant_rank", "n_gold", *[F.round(c, 6).alias(c) for k in evaluation.K_VALUES for c in (f"hit_{k}", f"recall_{k}")])


def _metrics(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    return evaluation.aggregate(_evaluations(spark, folder, found))


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = _metrics(spark, folder, _bm25(spark, folder))
    return m.select("scope", "n_queries", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("scope", "n_queries")])


def metric_deltas(spark: SparkSession, folder: str) -> DataFrame:
    near = _dense(spark, folder)  # first, so that both rank by its postings
    d = evaluation.deltas(_metrics(spark, folder, _bm25(spark, folder)), _metrics(spark, folder, near))
    return d.select("scope", "metric", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")])


def input_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "source_documents").select("document_id", F.try_element_at(F.col("metadata"), F.lit("dataset")).alias("dataset")).where("dataset IS NOT NULL").distinct()
    units = _units(spark, folder, "document_id").select(F.split("document_id", ":")[0].alias("dataset"))
    return evaluation.input_counts(documents, units, _examples(spark, folder).select("dataset"))


# --- tables --------------------------------------------------------------------------------------


def _order_tables(spark: SparkSession, folder: str, html: bool) -> DataFrame:
    """One unit per order that holds the order's lines as a table under a heading and a sentence; returned lines stand in it twice."""
    o, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    lines = lines.unionByName(lines.where("l_returnflag = 'R'"))
    text_of = [F.col(c).cast("long").cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *text_of), F.lit("</td></tr>")) if html else F.concat(F.lit("| "), F.concat_ws(" | ", *text_of), F.lit(" |"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["row"]), "" if html else "\n")
    head = "<table><thead><tr><th>line</th><th>part</th><th>quantity</th></tr></thead><tbody>" if html else "| line | part | quantity |\n|---|---|---|\n"
    whole = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\n\nPlaced with priority "), F.col("o_orderpriority"), F.lit(".\n\n"), F.lit(head), body, F.lit("</tbody></table>" if html else "\n"))
    key = F.col("o_orderkey").cast("string")
    return o.join(rows, o["o_orderkey"] == rows["l_orderkey"]).select(
        F.concat(F.lit("order:"), key).alias("chunk_id"), key.alias("document_id"), F.lit("0").alias("document_sha256"), F.lit("orders").alias("filename"), F.lit(0).alias("chunk_index"),
        F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array(F.concat(F.lit("order:"), key)).alias("source_element_ids"), whole.alias("text"),
    )


def table_row_units(spark: SparkSession, folder: str) -> DataFrame:
    made = tables.table_row_units(_order_tables(spark, folder, html=True))
    return made.where("retrieval_unit_kind = 'table_row'").select("document_id", "parent_chunk_id", "text")


def pipe_row_units(spark: SparkSession, folder: str) -> DataFrame:
    made = tables.table_row_units(_order_tables(spark, folder, html=False))
    return made.where("retrieval_unit_kind = 'table_row'").select("document_id", "parent_chunk_id", "text")


def narrative_units(spark: SparkSession, folder: str) -> DataFrame:
    made = tables.table_row_units(_order_tables(spark, folder, html=True))
    return made.where("retrieval_unit_kind = 'narrative'").select("document_id", "text")


def row_units_of_units(spark: SparkSession, folder: str) -> DataFrame:
    made = tables.table_row_units(_units(spark, folder))
    return made.select("chunk_id", "document_id", "retrieval_unit_kind", "parent_chunk_id", "token_count")


def parent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder, "text", "parent_chunk_id").withColumn("parent_chunk_id", F.nullif(F.trim("parent_chunk_id"), F.lit("")))
    return tables.parents_of(u, u).select("chunk_id", "parent_chunk_id", F.md5("parent_text").alias("parent_md5"))


def markdown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("markdown"), F.lit(None).cast("array<string>").alias("source_element_ids"))
    return chunker.markdown_units(pages)


# --- links ---------------------------------------------------------------------------------------


def qa_link_status(spark: SparkSession, folder: str) -> DataFrame:
    """Exported questions linked to examples by question and first expected value."""
    asked = _exports(spark, folder).select(F.col("record_no").alias("record_id"), "question", F.try_element_at(F.col("expected_values"), F.lit(1)).alias("answer"))
    known = _examples(spark, folder).select(F.col("query_id").alias("example_id"), F.col("query_text").alias("question"), "answer", F.concat_ws("|", "document_id", "program").alias("signature"))
    return linkage.link_questions(asked, known).select("record_id", "link_status", "linked_id")


def evidence_match(spark: SparkSession, folder: str) -> DataFrame:
    """The unit of its document that holds or covers each gold element's text best."""
    facts = _facts(spark, folder).join(ranking.merged(latest(table(spark, folder, "elements").drop("metadata"), "element_id", keep=["source_text"]).withColumnRenamed("source_text", "evidence")), "element_id")
    facts = facts.select(F.concat_ws("#", "query_id", "element_id").alias("fact_id"), "document_id", "evidence").distinct()
    m = linkage.match_evidence(facts, _units(spark, folder, "document_id", "chunk_index", "text"))
    return m.select("fact_id", "chunk_id", "chunk_index", F.round("score", 6).alias("score"))


def gold_lineage_map(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder).select(F.concat_ws("#", "query_id", "element_id").alias("fact_id"), "document_id", "element_id").distinct()
    return linkage.map_gold(facts, _units(spark, folder, "document_id", "source_element_ids", "text"), _elements(spark, folder), complete=False).select("fact_id", "chunk_id", "via")


def gold_context(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts of gold evidence; facts without an element are left to the integrity checks."""
    known = _elements(spark, folder).select("element_id")
    facts = _facts(spark, folder).join(known, "element_id", "left_semi")
    return linkage.context_of(facts, _elements(spark, folder)).select("query_id", F.md5("context").alias("context_md5"))


def gold_removed_topk(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder, *_LINEAGE)
    return export.without_gold(_bm25(spark, folder, 20), linkage.lineage(units), _facts(spark, folder), 5).select("query_id", "chunk_id", "rank")


def gold_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    return export.contains_all_gold(_bm25(spark, folder), linkage.lineage(_units(spark, folder, *_LINEAGE)), _facts(spark, folder))


# --- samples, splits, integrity ------------------------------------------------------------------


def sample_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    e = _examples(spark, folder).withColumn("key", F.col("query_id").cast("string"))
    return sampling.hash_sample(e, "key", 128, "evidence-sample").select("query_id", "example_id")


def sample_per_split(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "source_documents").select("document_id", F.try_element_at(F.col("metadata"), F.lit("split")).alias("split")).where("split IS NOT NULL").distinct()
    return sampling.hash_sample_per_group(d, "document_id", ["split"], 5)


def split_80_10_10(spark: SparkSession, folder: str) -> DataFrame:
    group = ids.document_group(F.col("source_file"), F.lit(None).cast("string"), F.col("document_id"))
    return _exports(spark, folder).where("document_id IS NOT NULL").select("record_no", group.alias("group_id"), ids.assigned_split(group).alias("split"))


def refusal_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = _exports(spark, folder).select(F.col("record_no").cast("string").alias("example_id"), "dataset", "source_split", "answerable")
    chosen = sampling.refusal_sample(rows.where("NOT answerable"), rows.where("answerable"))
    return chosen.select("example_id", "dataset", "source_split")


def entity_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "source_documents").withColumn("split", F.try_element_at(F.col("metadata"), F.lit("split")))
    return integrity.entity_conflicts(d, "document_id", ["title", "checksum_sha256", "split", "deleted_at"])


def fk_violations(spark: SparkSession, folder: str) -> DataFrame:
    e, d = table(spark, folder, "elements"), table(spark, folder, "source_documents")
    examples = table(spark, folder, "examples").select("record_no", F.col("question.document_id").alias("document_id"), F.explode("supporting_facts.element_id").alias("element_id"))
    return (
        integrity.missing_parents(e, "element_id", "document_id", d, "document_id", "element without document")
        .unionByName(integrity.missing_parents(e, "element_id", "parent_element_id", e, "element_id", "element without parent"))
        .unionByName(integrity.missing_parents(examples, "record_no", "document_id", d, "document_id", "example without document"))
        .unionByName(integrity.missing_parents(examples, "record_no", "element_id", e, "element_id", "fact without element"))
    )


def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    d = _exports(spark, folder).select("document_id", F.lower(F.trim("split")).alias("split"))
    return integrity.split_overlaps(d, "document_id")


def offset_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the texts as delivered that don't fit the texts without blanks around them."""
    d = table(spark, folder, "documents")
    return integrity.offset_violations(char_windows(d), "doc_id", d.select("doc_id", F.trim("text").alias("text")))


def preparation_statistics(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("link_status").isin("exact", "equivalent"), "normalized").otherwise(F.col("link_status"))
    linked = qa_link_status(spark, folder).join(_exports(spark, folder).select(F.col("record_no").alias("record_id"), "dataset"), "record_id")
    return integrity.preparation_statistics(linked.select(F.col("dataset").alias("split"), status.alias("status"), F.lit(False).alias("is_duplicate")))


def export_histograms(spark: SparkSession, folder: str) -> DataFrame:
    e = _exports(spark, folder)
    named = [integrity.histogram(e, f).withColumn("field", F.lit(f)) for f in ("category", "context_mode", "unit_status", "answerable")]
    named.append(integrity.list_histogram(e, "expected_units").withColumn("field", F.lit("expected_units")))
    whole = named[0]
    for h in named[1:]:
        whole = whole.unionByName(h)
    return whole


def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.fingerprint(_units(spark, folder, "document_id", "text"), ["chunk_id", "document_id", "text"])


# --- prompts, scores, export ---------------------------------------------------------------------


def grounded_prompts(spark: SparkSession, folder: str) -> DataFrame:
    p = prompts.grounded_prompts(_questions(spark, folder), _bm25(spark, folder, 3), _units(spark, folder, "text", "page_start", "page_end"))
    return p.select("query_id", F.md5("user").alias("user_md5"), "n_sources")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.citations(_bm25(spark, folder, 3), _units(spark, folder, "page_start", "page_end"))


def _answers(spark: SparkSession, folder: str, sure: bool = False) -> DataFrame:
    """Reference answers in the words a model might use, with what the export expects of them; a sure one cites the right source."""
    e = _exports(spark, folder)
    value = F.try_element_at(F.col("expected_values"), F.lit(1))
    said = F.when(~F.col("answerable") & (F.col("record_no") % 3 != 0), prompts.UNSUPPORTED).otherwise(
        F.concat(F.lit("From 1 + 2 = 3 and the notes, the answer is "), F.coalesce(value, F.lit("unknown")), F.when(F.lit(sure) | (F.col("record_no") % 2 == 0), F.lit(" [Source 1].")).otherwise(F.lit(" [Source 7].")))
    )
    return e.select(
        "record_no", "category", "context_mode", said.alias("answer"), F.coalesce("answerable", F.lit(False)).alias("answerable"), "expected_values", "expected_units",
        F.array().cast("array<string>").alias("expected_phrases"), F.when(F.col("answerable"), F.array(F.lit(1))).alias("required_sources"), F.lit(5).alias("context_count"),
    )


def answer_assessment(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.assess(_answers(spark, folder)).select("record_no", *scoring.CHECKS)


def answer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = scoring.answer_metrics(scoring.assess(_answers(spark, folder)))
    return m.select("scope", "value", *[f"{c}_{x}" for c in scoring.CHECKS for x in ("correct", "count")])


def answer_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of two models' answers by category and context mode, and what the second gains."""
    base, other = (scoring.answer_metrics(scoring.assess(_answers(spark, folder, sure))) for sure in (False, True))
    return scoring.metric_differences(base, other).select("scope", "value", "check_name", *[F.round(c, 6).alias(c) for c in ("base", "other", "delta")])


def refusal_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ranked context of a question gives its answer away."""
    shown = _bm25(spark, folder, 3).join(ranking.merged(_units(spark, folder, "text")), "chunk_id")
    context = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
    joined = context.join(ranking.merged(_examples(spark, folder).select("query_id", "answer")), "query_id").where("answer IS NOT NULL")
    return joined.select("query_id", export.context_contains_answer(F.col("context"), F.col("answer")).alias("given_away"))


def _inferred(spark: SparkSession, folder: str) -> DataFrame:
    e, known = _examples(spark, folder), _elements(spark, folder).select("element_id", "source_text")
    parts = _facts(spark, folder).join(known, "element_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "source_text"))), lambda x: x["source_text"]), "\n").alias("evidence"))
    return export.infer_units(e.select("query_id", "dataset", "split", "document_id", "source_file", "answer", F.col("query_text").alias("question"), "program").join(parts, "query_id", "left"))


def unit_inference(spark: SparkSession, folder: str) -> DataFrame:
    return _inferred(spark, folder).select("query_id", "answer_text", "answer_units", "unit_status")


def oracle_augment(spark: SparkSession, folder: str) -> DataFrame:
    return export.oracle_augment(_bm25(spark, folder), _facts(spark, folder), linkage.lineage(_units(spark, folder, *_LINEAGE)))


def budget_trim(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder, "text")
    return export.budget_trim(_bm25(spark, folder), units, 600, _facts(spark, folder), linkage.lineage(_units(spark, folder, *_LINEAGE))).select("query_id", "chunk_id", "rank", "is_gold", "overflow")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    e = _examples(spark, folder).where("answer IS NOT NULL AND trim(query_text) <> ''").withColumnRenamed("query_text", "question")
    return e.select("query_id", "dataset", "split", "document_id", "source_file", "question", "answer", "program", "normalized_program", "explanation", "n_steps")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder, "text", "page_start", "page_end", "retrieval_unit_kind")
    return export.training_records(_asked(spark, folder), oracle_augment(spark, folder), units, linkage.lineage(_units(spark, folder, *_LINEAGE)), _facts(spark, folder))


def _shown_records(records: DataFrame) -> DataFrame:
    """Records with their conversation as one digest and their lists as strings."""
    listed = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("expected_values", "expected_units", "gold_source_element_ids", "gold_source_numbers", "source_chunk_ids", "oracle_injected_chunk_ids", "oracle_injected_source_numbers")]
    plain = ["query_id", "dataset", "source_split", "split", "document_group_id", "document_id", "answerable", "category", "context_mode", "calculation_supervised", "unit_status", "reasoning_program", "context_trimmed", "sequence_token_count"]
    return records.select(*plain, *listed, F.md5(F.concat_ws("|", F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])))).alias("messages_md5"))


def training_records(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_records(_records(spark, folder))


def training_record_violations(spark: SparkSession, folder: str) -> DataFrame:
    return export.invalid_records(_records(spark, folder).unionByName(_refusals(spark, folder)))


def _refusals(spark: SparkSession, folder: str) -> DataFrame:
    units, facts = _units(spark, folder, "text", "page_start", "page_end"), _facts(spark, folder)
    deep = cut(_bm25(spark, folder, 20))
    return export.refusal_records(_asked(spark, folder), export.refusal_contexts(deep.where("rank <= 5"), deep, linkage.lineage(_units(spark, folder, *_LINEAGE)), facts, 5), units)


def refusal_records(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_records(_refusals(spark, folder))


def benchmark_units(spark: SparkSession, folder: str) -> DataFrame:
    documents = latest(table(spark, folder, "source_documents").drop("metadata"), "document_id")
    return normalize.benchmark_units(documents, _elements(spark, folder)).select("chunk_id", "document_id", "chunk_index", "source_element_ids")


def training_units(spark: SparkSession, folder: str) -> DataFrame:
    documents = latest(table(spark, folder, "source_documents").drop("metadata"), "document_id")
    return normalize.training_units(documents, _elements(spark, folder)).select("chunk_id", "document_id", "chunk_index", "source_element_ids")


def unit_rules(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.unit_violations(_units(spark, folder))


def element_rules(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.element_violations(_elements(spark, folder))


def plain_chat_records(spark: SparkSession, folder: str) -> DataFrame:
    known = _elements(spark, folder)
    facts = _facts(spark, folder).join(known.select("element_id"), "element_id", "left_semi")
    e = _examples(spark, folder).select("query_id", "dataset", "split", F.col("query_text").alias("question"), "answer")
    records = export.chat_records(e, linkage.context_of(facts, known))
    return records.select("query_id", "dataset", "split", F.md5(F.concat_ws("|", F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])))).alias("messages_md5"))


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Any-JSON column parsed as variants, by event type."""
    e = table(spark, folder, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def _held(query: Query) -> Query:
    """The query with a memory of its own for what its parts share."""
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        before = _HELD.set({})
        try:
            return query(spark, folder)
        finally:
            _HELD.reset(before)

    return run


def windowed_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming aggregation, over a table at rest."""
    counts = ingest.windowed_counts(table(spark, folder, "events"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES: dict[str, Query] = {
    f.__name__.rstrip("_"): _held(f)
    for f in (
        char_windows_, lexical_terms, query_normalize, token_counts, content_ids, bm25_statistics, bm25_okapi_topk, bm25_plus_topk, l2_normalize, dense_cosine_topk, dense_scoped_topk,
        rrf_fusion, parent_diverse_topk, hybrid_search, ranking_validity, retrieval_per_query, retrieval_metrics, metric_deltas, input_counts, table_row_units, pipe_row_units,
        narrative_units, row_units_of_units, parent_lookup, markdown_chunks, qa_link_status, evidence_match, gold_lineage_map, gold_context, gold_removed_topk, gold_sufficiency,
        sample_by_hash, sample_per_split, split_80_10_10, refusal_sample, entity_conflicts, fk_violations, split_overlap, offset_violations, preparation_statistics, export_histograms,
        table_fingerprint, grounded_prompts, citations, answer_assessment, answer_metrics, answer_differences, refusal_guard, unit_inference, oracle_augment, budget_trim, training_records,
        training_record_violations, refusal_records, benchmark_units, training_units, unit_rules, element_rules, plain_chat_records, json_props, windowed_event_counts,
    )
}
