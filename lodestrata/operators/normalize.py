"""Raw question-answering records turned into documents, elements and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.ids import digest
from lodestrata.operators.linkage import link_questions, match_evidence
from lodestrata.operators.windows import OVERLAP, SIZE, char_windows

FINQA_RAW = (
    "id string, filename string, pre_text array<string>, post_text array<string>, table array<array<string>>, table_ori array<array<string>>, "
    "qa struct<question:string, answer:string, explanation:string, steps:array<struct<op:string, arg1:string, arg2:string, res:string>>, program:string, program_re:string, gold_inds:map<string,string>, exe_ans:string>"
)
DOCFINQA_RAW = "Context string, Question string, Program string, Answer string"


def _first(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in the order the rows were read."""
    columns = [c for c in df.columns if c != key]
    return df.withColumn("_at", F.monotonically_increasing_id()).groupBy(key).agg(F.min_by(F.struct(*columns), "_at").alias("_r")).select(key, "_r.*").select(*df.columns)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _page(filename: Column) -> Column:
    return F.regexp_extract(filename, r"(?i)page_(\d+)\.pdf$", 1).try_cast("int")


def finqa_documents(raw: DataFrame, split: str) -> DataFrame:
    parts = F.split("filename", "/")
    long = F.size(parts) >= 3
    meta = F.map_from_arrays(F.array(*map(F.lit, ("dataset", "split", "company", "report_year"))), F.array(F.lit("finqa"), F.lit(split), F.when(long, parts[0]), F.when(long, parts[1])))
    rows = raw.select(
        F.concat(F.lit("finqa:"), "filename").alias("document_id"), F.element_at(parts, -1).alias("file_name"), F.lit("application/pdf").alias("mime_type"),
        F.col("filename").alias("source_uri"), F.lit(1).alias("page_count"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"),
    )
    return _first(rows, "document_id")


def finqa_elements(raw: DataFrame) -> DataFrame:
    """Paragraphs before and after the table, the table, and each of its rows, header included.

    Blank paragraphs use up an index and give no element.
    """
    document = F.concat(F.lit("finqa:"), F.col("filename"))
    base = _first(raw.select(document.alias("document_id"), _page(F.col("filename")).alias("page_number"), F.coalesce("pre_text", F.array().cast("array<string>")).alias("pre"), F.coalesce("post_text", F.array().cast("array<string>")).alias("post"), "table"), "document_id")
    none = F.lit(None).cast("string")
    at = lambda *c: F.struct(c[0].alias("table_id"), c[1].cast("int").alias("row_index"))
    text = base.select("document_id", "page_number", F.posexplode(F.concat("pre", "post")).alias("i", "t")).where(_filled(F.col("t")).isNotNull())
    text = text.select(F.concat("document_id", F.lit(":text_"), "i").alias("element_id"), "document_id", F.lit("paragraph").alias("element_type"), F.col("t").alias("source_text"), "page_number", none.alias("parent_element_id"), F.concat(F.lit("text_"), "i").alias("source_key"), F.lit(None).cast("struct<table_id:string,row_index:int>").alias("table_coordinates"))
    row = lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | ", "")
    tables = base.where(F.size("table") > 0).withColumn("table_id", F.concat("document_id", F.lit(":table")))
    whole = tables.select(F.col("table_id").alias("element_id"), "document_id", F.lit("table").alias("element_type"), F.array_join(F.transform("table", row), "\n").alias("source_text"), "page_number", none.alias("parent_element_id"), F.lit("table").alias("source_key"), at(F.col("table_id"), F.lit(None)).alias("table_coordinates"))
    rows = tables.select("document_id", "page_number", "table_id", F.posexplode("table").alias("i", "r"))
    rows = rows.select(F.concat("document_id", F.lit(":table_"), "i").alias("element_id"), "document_id", F.lit("table_row").alias("element_type"), row(F.col("r")).alias("source_text"), "page_number", F.col("table_id").alias("parent_element_id"), F.concat(F.lit("table_"), "i").alias("source_key"), at(F.col("table_id"), F.col("i")).alias("table_coordinates"))
    return text.unionByName(whole).unionByName(rows)


def finqa_examples(raw: DataFrame, split: str) -> DataFrame:
    """Examples with the answer, or the executable one where it is blank, steps and gold facts.

    A key text_-n counts from the end of both text lists together.
    """
    n_text = F.size(F.concat(F.coalesce("pre_text", F.array().cast("array<string>")), F.coalesce("post_text", F.array().cast("array<string>"))))
    document = F.concat(F.lit("finqa:"), F.col("filename"))
    key = lambda k: F.when(k.rlike(r"^text_-\d+$"), F.concat(F.lit("text_"), (n_text + F.regexp_extract(k, r"(-\d+)$", 1).try_cast("int")).cast("string"))).otherwise(k)
    keys = F.array_sort(F.map_keys(F.coalesce("qa.gold_inds", F.create_map().cast("map<string,string>"))))
    facts = F.transform(keys, lambda k: F.struct(key(k).alias("source_key"), F.concat(document, F.lit(":"), key(k)).alias("element_id"), F.lit(None).cast("double").alias("score")))
    steps = F.transform(
        F.coalesce("qa.steps", F.array().cast("array<struct<op:string,arg1:string,arg2:string,res:string>>")),
        lambda s: F.struct(s["op"].alias("operation"), F.filter(F.array(_filled(s["arg1"]), _filled(s["arg2"])), lambda a: a.isNotNull()).alias("arguments"), _filled(s["res"]).alias("result")),
    )
    return raw.select(
        F.lit("finqa").alias("dataset"), F.lit(split).alias("split"), F.concat(F.lit("finqa:"), "id").alias("example_id"),
        F.struct(F.concat(F.lit("finqa:"), "id").alias("question_id"), document.alias("document_id"), F.trim("qa.question").alias("text"), F.lit("unknown").alias("question_type")).alias("question"),
        F.struct(
            F.coalesce(_filled(F.col("qa.answer")), F.col("qa.exe_ans")).alias("text"), F.col("qa.exe_ans").alias("executable_answer"), _filled(F.col("qa.explanation")).alias("explanation"),
            _filled(F.col("qa.program")).alias("program"), _filled(F.col("qa.program_re")).alias("normalized_program"), steps.alias("steps"),
        ).alias("reference_answer"),
        facts.alias("supporting_facts"),
    )


def finqa_evidence(raw: DataFrame) -> DataFrame:
    """(example_id, source_key, evidence) of the gold passages of raw records."""
    return raw.select(F.col("id").alias("example_id"), F.explode("qa.gold_inds").alias("source_key", "evidence"))


def docfinqa_normalized(raw: DataFrame, finqa: DataFrame, split: str, size: int = SIZE, overlap: int = OVERLAP, minimum: float = 0.6) -> dict[str, DataFrame]:
    """documents, elements (windows), examples and statuses of long-document records.

    Each record is linked to a known question by question and answer; every gold passage of that
    one must be found in a window, else the record counts as evidence_incomplete.
    """
    context, question = F.col("Context"), F.col("Question")
    document = F.concat(F.lit("docfinqa:"), digest(context, width=32))
    rows = raw.select(document.alias("document_id"), context.alias("text"), question.alias("question"), F.col("Answer").alias("answer"), F.col("Program").alias("program"))
    rows = rows.withColumn("record_id", F.concat(F.lit("docfinqa:"), digest(F.col("document_id"), F.col("question"), F.coalesce("answer", F.lit("")), F.coalesce("program", F.lit("")), width=32)))
    gold = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col("qa.gold_inds")))))
    known = finqa.select(F.col("id").alias("example_id"), F.col("qa.question").alias("question"), F.coalesce(_filled(F.col("qa.answer")), F.col("qa.exe_ans")).alias("answer"), F.concat_ws("\x1f", "filename", F.coalesce("qa.program_re", "qa.program"), gold).alias("signature"))
    times = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    once = _first(rows, "record_id")
    linked = link_questions(once.select("record_id", "document_id", "question", "answer", "program"), known)
    documents = _first(rows.select("document_id", "text"), "document_id")
    windows = char_windows(documents, key="document_id", size=size, overlap=overlap)
    strategy = f"fixed_character_v1:{size}:{overlap}"
    elements = windows.withColumn("element_id", F.concat("document_id", F.lit(":chunk-"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))).withColumn("strategy", F.lit(strategy))
    facts = linked.where(F.col("linked_id").isNotNull()).join(finqa_evidence(finqa).withColumnRenamed("example_id", "linked_id"), "linked_id").select(F.concat_ws("\x1f", "record_id", "source_key").alias("fact_id"), "record_id", "source_key", "document_id", "evidence")
    found = match_evidence(facts.select("fact_id", "document_id", "evidence"), elements.select("document_id", F.col("element_id").alias("chunk_id"), "chunk_index", "text"), minimum)
    joined = facts.select("fact_id", "record_id", "source_key").join(found, "fact_id", "left")
    per = joined.groupBy("record_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("chunk_id").alias("found"), F.array_sort(F.collect_list(F.struct("source_key", F.col("chunk_id").alias("element_id"), "score"))).alias("supporting_facts"))
    judged = linked.join(per, "record_id", "left").join(times, "record_id")
    status = F.when(~F.col("link_status").isin("exact", "equivalent"), F.col("link_status")).when((F.coalesce("wanted", F.lit(0)) > 0) & (F.col("wanted") == F.col("found")), "normalized").otherwise("evidence_incomplete")
    judged = judged.withColumn("status", status).withColumn("split", F.lit(split))
    copies = judged.select("split", "status", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("turn")).select("split", "status", (F.col("turn") > 1).alias("is_duplicate"))
    good = judged.where("status = 'normalized'")
    examples = good.select(
        F.lit("docfinqa").alias("dataset"), "split", F.col("record_id").alias("example_id"),
        F.struct(F.col("record_id").alias("question_id"), "document_id", F.trim("question").alias("text"), F.lit("unknown").alias("question_type")).alias("question"),
        F.struct(F.col("answer").alias("text"), _filled(F.col("program")).alias("program")).alias("reference_answer"), "supporting_facts", "linked_id", "link_status",
    )
    used = good.select("document_id").distinct()
    return {"documents": documents.join(used, "document_id", "left_semi"), "elements": elements.join(used, "document_id", "left_semi"), "examples": examples, "statuses": copies}


def benchmark_units(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """One unit per top-level element with words; its children's ids follow its own, by row, then id."""
    children = elements.where(F.col("parent_element_id").isNotNull()).select(F.col("parent_element_id").alias("element_id"), F.struct(F.coalesce("table_coordinates.row_index", F.lit(-1)).alias("r"), F.col("element_id").alias("e")).alias("c"))
    lists = children.groupBy("element_id").agg(F.array_sort(F.collect_set("c")).alias("cs")).select("element_id", F.transform("cs", lambda c: c["e"]).alias("child_ids"))
    top = elements.where(F.col("parent_element_id").isNull() & F.col("source_text").rlike(r"[\p{L}\p{N}$€£¥%]")).join(lists, "element_id", "left")
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "element_id")) - 1
    units = top.withColumn("chunk_index", index).join(documents.select("document_id", "file_name"), "document_id", "left")
    ids = F.concat(F.array("element_id"), F.coalesce("child_ids", F.array().cast("array<string>")))
    return units.select(
        F.concat(F.lit("normalized-chunk:"), digest(F.col("document_id"), F.col("element_id"), F.coalesce("source_text", F.lit("")))).alias("chunk_id"),
        "document_id", F.col("file_name").alias("filename"), "chunk_index", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), ids.alias("source_element_ids"), F.col("source_text").alias("text"),
    )


def training_units(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """One unit per element, numbered before tables that have row elements are left out."""
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "element_id")) - 1
    numbered = elements.withColumn("chunk_index", index)
    with_rows = elements.where((F.col("element_type") == "table_row") & F.col("parent_element_id").isNotNull()).select(F.col("parent_element_id").alias("element_id")).distinct()
    kept = numbered.join(with_rows, "element_id", "left_anti").where(F.col("source_text").rlike(r"[\p{L}\p{N}$€£¥%]"))
    return kept.join(documents.select("document_id", "file_name"), "document_id", "left").select(
        F.concat(F.lit("chunk:"), digest(F.col("document_id"), F.col("element_id"), F.col("source_text"), width=24)).alias("chunk_id"),
        "document_id", F.col("file_name").alias("filename"), "chunk_index", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.array("element_id").alias("source_element_ids"), F.col("source_text").alias("text"),
    )
