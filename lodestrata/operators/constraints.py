"""Rules of single records: (row_key, rule) for every rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions.text import token_count


def _broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that is null counts as kept."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(names).alias("rule"))


def _told(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""


def document_violations(documents: DataFrame) -> DataFrame:
    return _broken(documents, "document_id", {
        "document_id is blank": _told("document_id"), "file_name is blank": _told("file_name"),
        "page_count is below 1": F.col("page_count") >= 1, "checksum isn't 64 hex digits": F.col("checksum_sha256").rlike("^[0-9a-f]{64}$"),
    })


def _counted(column: str, count: Column) -> Column:
    """Whether a count is that of the text; a missing count isn't."""
    return F.when(F.col("text").isNotNull(), F.coalesce(F.col(column) == count, F.lit(False)))


ELEMENT_TYPES = ("heading", "paragraph", "table", "table_row", "caption", "footnote")


def element_violations(elements: DataFrame) -> DataFrame:
    c = F.col("table_coordinates")
    tabular = F.col("element_type").isin("table", "table_row")
    return _broken(elements, "element_id", {
        "element_id is blank": _told("element_id"), "document_id is blank": _told("document_id"), "unknown element_type": F.coalesce(F.col("element_type").isin(*ELEMENT_TYPES), F.lit(False)),
        "page_number is below 1": F.col("page_number") >= 1, "coordinates only for tables and rows": tabular == c.isNotNull(), "table_id is blank": F.when(c.isNotNull(), F.coalesce(F.trim(c["table_id"]), F.lit("")) != ""),
        "row_index is negative": c["row_index"] >= 0, "column_index is negative": c["column_index"] >= 0, "span is below 1": (F.coalesce(c["row_span"], F.lit(1)) >= 1) & (F.coalesce(c["column_span"], F.lit(1)) >= 1),
    })


def unit_violations(units: DataFrame) -> DataFrame:
    """Counts that are missing or don't match the text, pages out of order, parents of units that aren't derived."""
    derived = F.col("retrieval_unit_kind").isin("narrative", "table_row")
    return _broken(units, "chunk_id", {
        "chunk_id is blank": _told("chunk_id"), "text is blank": _told("text"), "char_count differs": _counted("char_count", F.length("text")),
        "token_count differs": _counted("token_count", token_count(F.col("text"))), "pages out of order": F.col("page_start") <= F.col("page_end"),
        "page is below 1": F.col("page_start") >= 1, "chunk_index is negative": F.col("chunk_index") >= 0, "no source element": F.size("source_element_ids") >= 1,
        "unknown kind": F.coalesce(F.col("retrieval_unit_kind").isin("chunk", "narrative", "table_row"), F.lit(False)), "a chunk has no parent": derived | ~_told("parent_chunk_id"),
    })


def citation_violations(citations: DataFrame) -> DataFrame:
    pages = F.col("page_numbers")
    return _broken(citations, "citation_id", {
        "citation_id is blank": _told("citation_id"), "no evidence": F.size("evidence_ids") >= 1, "no source element": F.size("source_element_ids") >= 1, "no page": F.size(pages) >= 1,
        "pages repeat or aren't sorted": F.array_sort(F.array_distinct(pages)) == pages, "page is below 1": F.forall(pages, lambda p: p >= 1),
    })


#: Operations and the number of operands each needs (at least two where it says None).
OPERATIONS = {"sum": None, "difference": 2, "product": None, "ratio": 2, "percentage": 2, "percentage_change": 2, "average": None}


def calculation_violations(calculations: DataFrame) -> DataFrame:
    """calculations: (calculation_id, operation, operands array of decimals, result, unit)."""
    n, op = F.size("operands"), F.col("operation")
    fixed = op.isin(*[k for k, v in OPERATIONS.items() if v == 2])
    divisor = F.when(op == "percentage_change", F.try_element_at("operands", F.lit(1))).otherwise(F.try_element_at("operands", F.lit(2)))
    return _broken(calculations, "calculation_id", {
        "unknown operation": F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "needs two operands": F.when(fixed, n == 2), "needs at least two operands": F.when(op.isin("sum", "product", "average"), n >= 2),
        "divides by zero": F.when(op.isin("ratio", "percentage", "percentage_change"), divisor != 0), "no result": F.col("result").isNotNull(),
    })


def answer_violations(answers: DataFrame) -> DataFrame:
    """answers: (answer_id, status, text, citation_ids, calculation_ids)."""
    answered = F.col("status") == "answered"
    return _broken(answers, "answer_id", {
        "unknown status": F.coalesce(F.col("status").isin("answered", "insufficient_evidence"), F.lit(False)), "an answer needs a citation": F.when(answered, F.size("citation_ids") >= 1), "an answer needs text": F.when(answered, _told("text")),
        "citations repeat": F.size(F.array_distinct("citation_ids")) == F.size("citation_ids"), "calculations repeat": F.size(F.array_distinct("calculation_ids")) == F.size("calculation_ids"),
    })
