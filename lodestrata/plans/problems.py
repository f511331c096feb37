"""Queries of the general problems (4, 5) on the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import quantities, references
from lodestrata.sources.tables import table


def _dangling(spark: SparkSession, folder: str) -> DataFrame:
    elements, units = table(spark, folder, "elements"), table(spark, folder, "units")
    examples, documents = table(spark, folder, "examples"), table(spark, folder, "source_documents")
    referring = (
        references.reference_rows(elements, table_name="elements", row_key="element_id", keys=F.array("document_id"), target="source_documents")
        .unionByName(references.reference_rows(units, table_name="units", row_key="chunk_id", keys=F.array("parent_chunk_id"), target="units"))
        .unionByName(references.reference_rows(examples, table_name="examples", row_key="record_no", keys=F.col("supporting_facts.element_id"), target="elements", deleted_at=None))
    )
    targets = (
        references.target_rows(documents, target="source_documents", key="document_id")
        .unionByName(references.target_rows(units, target="units", key="chunk_id"))
        .unionByName(references.target_rows(elements, target="elements", key="element_id"))
    )
    return references.dangling_references(referring, targets)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _dangling(spark, folder).select("table_name", "row_key", "ref_key")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.dangling_report(_dangling(spark, folder))


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    statements = (
        quantities.operand_statements(table(spark, folder, "operands"))
        .unionByName(quantities.export_statements(table(spark, folder, "rag_export")))
        .unionByName(quantities.example_statements(table(spark, folder, "examples")))
    )
    return quantities.in_common_units(statements, table(spark, folder, "fx_rates"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantities.same_amount_other_number(_amounts(spark, folder))


def p5_common_units(spark: SparkSession, folder: str) -> DataFrame:
    return _amounts(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_common_units)}

_TRIM = r"regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\p{{Z}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\p{{Z}}]+$', '', 'g')"
_DANGLING = f"""
WITH refs AS (
  SELECT 'elements' AS table_name, element_id AS row_key, 'source_documents' AS target, document_id AS k, received_at, deleted_at IS NULL AS live FROM elements
  UNION ALL SELECT 'units', chunk_id, 'units', parent_chunk_id, received_at, deleted_at IS NULL FROM units
  UNION ALL SELECT 'examples', CAST(record_no AS VARCHAR), 'elements', f.element_id, received_at, TRUE
    FROM (SELECT record_no, received_at, unnest(supporting_facts) AS f FROM examples)
), rows_ AS (
  SELECT table_name, row_key, target, ref_key, min(received_at) AS arrived
  FROM (SELECT *, {_TRIM.format('k')} AS ref_key FROM refs)
  WHERE ref_key <> '' GROUP BY ALL HAVING bool_or(live)
), targets AS (
  SELECT target, k, min(received_at) AS valid_from, bool_or(live) AS valid_now FROM (
    SELECT 'source_documents' AS target, document_id AS k, received_at, deleted_at IS NULL AS live FROM source_documents
    UNION ALL SELECT 'units', chunk_id, received_at, deleted_at IS NULL FROM units
    UNION ALL SELECT 'elements', element_id, received_at, deleted_at IS NULL FROM elements)
  GROUP BY ALL
), judged AS (
  SELECT r.table_name, r.row_key, r.ref_key, r.arrived,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN NOT t.valid_now THEN 'deleted' WHEN t.valid_from > r.arrived THEN 'late' END AS status
  FROM rows_ r LEFT JOIN targets t ON r.target = t.target AND r.ref_key = t.k
)
"""
SQL: dict[str, str] = {
    "p4_found": _DANGLING + "SELECT table_name, row_key, ref_key FROM judged WHERE status IS NOT NULL",
    "p4_report": _DANGLING + "SELECT table_name, strftime(arrived, '%Y-%m') AS month, status, count(*) AS n_references FROM judged WHERE status IS NOT NULL GROUP BY ALL",
}
