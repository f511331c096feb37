"""Queries of the subpackage on the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm import abuse, bpe, markup, overlap, packing, pieces, splits
from lodestrata.llm.names import split_name
from lodestrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    questions = overlap.same_figure_pairs(table(spark, folder, "examples"))
    documents = overlap.document_pairs(table(spark, folder, "source_documents"), table(spark, folder, "elements"))
    named = questions.select(F.lit("examples").alias("table_name"), "left_key", "right_key")
    return named.unionByName(documents.select(F.lit("source_documents").alias("table_name"), "left_key", "right_key"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    examples, documents = table(spark, folder, "examples"), table(spark, folder, "source_documents")
    members = examples.select(F.lit("examples").alias("table_name"), F.col("record_no").cast("string").alias("key"), F.col("dataset").alias("source"), split_name(F.col("split")).alias("split"))
    meta = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    members = members.unionByName(documents.select(F.lit("source_documents").alias("table_name"), F.trim("document_id").alias("key"), meta("dataset").alias("source"), split_name(meta("split")).alias("split")))
    return overlap.overlap_report(p1_found(spark, folder), members)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(table(spark, folder, "units"), table(spark, folder, "chunking_profiles"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where(F.col("piece_index") == 0).select("chunk_id").distinct()


def _markup_rows(spark: SparkSession, folder: str) -> DataFrame:
    elements = markup.markup_rows(table(spark, folder, "elements"), table_name="elements", row_key="element_id", text="source_text")
    return elements.unionByName(markup.markup_rows(table(spark, folder, "units"), table_name="units", row_key="chunk_id", text="text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_clean(spark, folder).where(F.size("constructs") > 0).select("table_name", "row_key")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(_markup_rows(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder))


def _abuse_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder).where(F.col("abuse_score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse_scores(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abusive_rates(_abuse_scores(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.groups_across_splits(table(spark, folder, "rag_export"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "rag_export"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_splits, p3_found, p3_pieces, p6_found, p6_clean, p7_ids, p8_containers, p8_fill, p9_found, p9_scores, p9_rates)}
