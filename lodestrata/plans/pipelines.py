"""Jobs: prepare data sets, run retrieval benchmarks, evaluate answers, export training data."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions.text import page_label
from lodestrata.operators import evaluation, export, integrity, linkage, normalize, prompts, ranking, sampling, scoring
from lodestrata.operators.normalize import DOCFINQA_RAW, FINQA_RAW
from lodestrata.operators.windows import OVERLAP, SIZE
from lodestrata.session import cut
from lodestrata.sources import readers, sinks

SPLITS = ("train", "validation", "test")
SAMPLE_SIZES = {"train": 128, "validation": 32}
SAMPLE_DOCUMENTS = 5
KEYS = {"documents": "document_id", "elements": "element_id", "examples": "example_id"}


def _check_splits(splits: Sequence[str]) -> list[str]:
    if not splits or len(set(splits)) != len(splits) or set(splits) - set(SPLITS):
        raise ValueError(f"splits must be different ones of {SPLITS}")
    return sorted(splits)


def prepare_finqa(spark: SparkSession, source: str, files: dict[str, str], target: str, revision: str, seed: str = "evidence-sample") -> dict:
    """Write documents, elements and examples of each split, samples of them, and a manifest.

    An example or a document in two splits raises; reports that splits share are written down.
    """
    counts: dict[str, dict] = {}
    examples_of: dict[str, DataFrame] = {}
    documents_of: DataFrame | None = None
    for split in _check_splits(list(files)):
        raw = readers.finqa_split(spark, source, files[split])
        tables = {"documents": normalize.finqa_documents(raw, split), "elements": normalize.finqa_elements(raw), "examples": normalize.finqa_examples(raw, split)}
        integrity.require_none(integrity.duplicate_keys(tables["examples"], ["example_id"]), "examples repeat")
        facts = tables["examples"].select("example_id", F.explode("supporting_facts.element_id").alias("element_id"))
        integrity.require_none(integrity.missing_parents(facts, "example_id", "element_id", tables["elements"], "element_id", "fact"), "facts name no element")
        counts[split] = {name: sinks.write_json_lines(df, f"{target}/{split}/{name}", key=KEYS[name]) for name, df in tables.items()}
        if n := SAMPLE_SIZES.get(split):
            chosen = sampling.hash_sample(tables["examples"], "example_id", n, seed)
            documents = chosen.select(F.col("question.document_id").alias("document_id")).distinct()
            sinks.write_json_lines(chosen, f"{target}/samples/{split}/examples")
            for name in ("documents", "elements"):
                sinks.write_json_lines(tables[name].join(documents, "document_id", "left_semi"), f"{target}/samples/{split}/{name}")
        examples_of[split] = tables["examples"].select("example_id", F.lit(split).alias("split"))
        parts = F.filter(F.split("source_uri", "/"), lambda p: ~p.isin("", "."))
        report = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(F.col("document_id"))
        placed = tables["documents"].select("document_id", report.alias("report_id"), F.lit(split).alias("split"))
        documents_of = placed if documents_of is None else documents_of.unionByName(placed)
    whole = None
    for df in examples_of.values():
        whole = df if whole is None else whole.unionByName(df)
    integrity.require_none(integrity.split_overlaps(whole, "example_id"), "examples are in two splits")
    integrity.require_none(integrity.split_overlaps(documents_of, "document_id"), "documents are in two splits")
    shared = cut(integrity.split_overlaps(documents_of, "report_id"))
    sinks.write_json_lines(shared, f"{target}/shared_reports", key="report_id")
    overlaps = [r.asDict() for r in shared.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("n_reports")).orderBy("left_split", "right_split").collect()]
    manifest = {"dataset": "finqa", "revision": revision, "splits": counts, "shared_reports": overlaps}
    sinks.write_manifest(f"{target}/manifest.json", manifest)
    return manifest


def prepare_docfinqa(spark: SparkSession, source: str, files: dict[str, str], finqa: DataFrame, target: str, revision: str, size: int = SIZE, overlap: int = OVERLAP, minimum: float = 0.6, sample_documents: int = SAMPLE_DOCUMENTS) -> dict:
    """Link long documents to known questions and write what is complete, with statistics that add up,
    and of each split the so many documents of the smallest hash with all that belongs to them."""
    stats: dict[str, dict] = {}
    artifacts: dict[str, dict] = {}
    for split in _check_splits(list(files)):
        out = normalize.docfinqa_normalized(readers.docfinqa_split(spark, source, files[split]), finqa, split, size, overlap, minimum)
        counted = integrity.preparation_statistics(out["statuses"])
        integrity.require_none(integrity.statistics_violations(counted), "statistics don't add up")
        integrity.require_none(integrity.offset_violations(out["elements"], "document_id", out["documents"]), "windows don't match their documents")
        row = counted.first()
        stats[split] = row.asDict() if row else {}
        artifacts[split] = {name: sinks.write_json_lines(out[name], f"{target}/{split}/{name}", key=KEYS[name]) for name in KEYS}
        chosen = sampling.hash_sample_per_group(out["documents"].withColumn("_all", F.lit(split)), "document_id", ["_all"], sample_documents).select("document_id")
        for name in KEYS:
            of = F.col("question.document_id") if name == "examples" else F.col("document_id")
            sampled = out[name].withColumn("_document", of).join(chosen.withColumnRenamed("document_id", "_document"), "_document", "left_semi").drop("_document")
            sinks.write_json_lines(sampled, f"{target}/samples/{split}/{name}", key=KEYS[name])
    manifest = {"dataset": "docfinqa", "artifacts": artifacts, "revision": revision, "chunk_size": size, "chunk_overlap": overlap, "evidence_minimum_score": minimum, "splits": stats}
    sinks.write_manifest(f"{target}/manifest.json", manifest)
    return manifest


def benchmark(units: DataFrame, queries: DataFrame, gold: DataFrame, retriever: str = "bm25", vectors: tuple[DataFrame, DataFrame] | None = None, k_values: Sequence[int] = evaluation.K_VALUES, candidates: int = 20, rrf_k: int = 60) -> tuple[DataFrame, DataFrame]:
    """(per-query evaluations, metrics per data set) of a retriever that searches each query's own document.

    units: (chunk_id, document_id, text, source_element_ids), queries: (query_id, dataset,
    document_id, query_text), vectors: (chunk_id, embedding) and (query_id, embedding).
    """
    depth, scope = max(k_values), ["document_id"]
    lexical = lambda k: ranking.bm25(units, queries, k=k, scope=scope)
    if retriever == "bm25":
        found = lexical(depth)
    else:
        if vectors is None:
            raise ValueError("dense and hybrid retrieval need vectors")
        u, q = units.select("chunk_id", "document_id").join(vectors[0], "chunk_id"), queries.select("query_id", "document_id").join(vectors[1], "query_id")
        near = lambda k: ranking.dense(u, q, k=k, scope=scope)
        found = near(depth) if retriever == "dense" else ranking.rrf(lexical(candidates), near(candidates), k=depth, rrf_k=rrf_k)
    evals = cut(evaluation.per_query(found, gold, linkage.lineage(units), k_values).join(queries.select("query_id", "dataset"), "query_id"))
    return evals, evaluation.aggregate(evals, k_values=k_values)


def prepared_world(spark: SparkSession, targets: Sequence[str], split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, queries, gold) of a split of prepared data sets, for benchmark()."""
    units = queries = gold = None
    for target in targets:
        t = read_prepared(spark, target, split)
        elements = t["elements"]
        if "source_text" not in elements.columns:  # windows of long documents
            made = elements.select(F.col("element_id").alias("chunk_id"), "document_id", F.array("element_id").alias("source_element_ids"), "text")
        else:
            made = normalize.benchmark_units(t["documents"], elements).select("chunk_id", "document_id", "source_element_ids", "text")
        asked = t["examples"].select(F.col("example_id").alias("query_id"), "dataset", F.col("question.document_id").alias("document_id"), F.col("question.text").alias("query_text"))
        wanted = t["examples"].select(F.col("example_id").alias("query_id"), F.explode("supporting_facts.element_id").alias("element_id"))
        units, queries, gold = (new if old is None else old.unionByName(new) for old, new in ((units, made), (queries, asked), (gold, wanted)))
    return units, queries, gold


def training_world(spark: SparkSession, targets: Sequence[str], split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, examples, gold) of a split of prepared data sets, for export_training()."""
    whole = None
    for target in targets:
        t = read_prepared(spark, target, split)
        elements, e = t["elements"], t["examples"]
        if "source_text" not in elements.columns:
            made = elements.select(F.col("element_id").alias("chunk_id"), "document_id", F.array("element_id").alias("source_element_ids"), "text", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
        else:
            made = normalize.training_units(t["documents"], elements).select("chunk_id", "document_id", "source_element_ids", "text", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"))
        uri = t["documents"].select("document_id", (F.col("source_uri") if "source_uri" in t["documents"].columns else F.lit(None).cast("string")).alias("source_file"))
        kind = e.schema["reference_answer"].dataType.fieldNames()
        told = lambda c: F.col(f"reference_answer.{c}") if c in kind else F.lit(None).cast("string")  # noqa: E731,B023
        steps = F.size("reference_answer.steps") if "steps" in kind else F.lit(0)
        asked = e.select(F.col("example_id").alias("query_id"), "dataset", F.lit(split).alias("split"), F.col("question.document_id").alias("document_id"), F.col("question.text").alias("question"), *[told(c).alias(n) for c, n in (("text", "answer"), ("program", "program"), ("normalized_program", "normalized_program"), ("explanation", "explanation"))], steps.alias("n_steps")).join(uri, "document_id", "left")
        gold = e.select(F.col("example_id").alias("query_id"), F.explode("supporting_facts.element_id").alias("element_id"))
        world = (made, asked, gold)
        whole = world if whole is None else tuple(a.unionByName(b) for a, b in zip(whole, world))
    return whole


def run_benchmark(units: DataFrame, queries: DataFrame, gold: DataFrame, target: str, retriever: str = "bm25", vectors: tuple[DataFrame, DataFrame] | None = None, baseline: str | None = None, k_values: Sequence[int] = evaluation.K_VALUES, candidates: int = 20, rrf_k: int = 60) -> dict:
    """Benchmark a retriever and write it down: an evaluation per query, metrics with fingerprints of
    corpus and queries, and, beside a baseline's folder, the differences per metric.

    A baseline of another corpus or other queries raises, since its metrics can't be compared.
    """
    evals, metrics = benchmark(units, queries, gold, retriever, vectors, k_values, candidates, rrf_k)
    prints = {
        "corpus": integrity.digest_of(units.select("chunk_id", "document_id", "text", F.concat_ws("\x1f", "source_element_ids").alias("e")), ["chunk_id", "document_id", "text", "e"]),
        "chunk_ids": integrity.digest_of(units, ["chunk_id"]),
        "queries": integrity.digest_of(queries, ["query_id", "dataset", "document_id", "query_text"]),
        "gold": integrity.digest_of(gold.distinct(), ["query_id", "element_id"]),
    }
    rows = {r.scope: {c: r[c] for c in metrics.columns if c != "scope"} for r in metrics.collect()}
    found = {"retriever": retriever, "k_values": sorted(set(k_values)), "fingerprints": prints, "metrics": rows, "evaluations": sinks.write_json_lines(evals, f"{target}/evaluations", key="query_id")}
    if baseline:
        base = json.loads(sinks.read_small(f"{baseline}/metrics.json"))
        if base["fingerprints"] != prints or base["metrics"].keys() != rows.keys():
            raise ValueError("the baseline has another corpus or other queries")
        found["comparison"] = {scope: {c: v - base["metrics"][scope][c] for c, v in row.items() if c != "n_queries"} for scope, row in rows.items()}
    sinks.write_manifest(f"{target}/metrics.json", found)
    return found


def evaluate_suite(suite: DataFrame, generator: Callable[[str, str, str], str], target: str | None = None) -> DataFrame:
    """Assessed answers of two models, named base and adapter, to the cases of a frozen suite.

    generator(model, system, user) runs in the executors' Python. With a target the answers, and
    metrics by category and context mode with a fingerprint of the prompts, are written there.
    """
    label = lambda r: prompts.source_item(r["rank"], page_label(r["chunk"]["page_start"], r["chunk"]["page_end"]), r["chunk"]["chunk_id"], r["chunk"]["text"])
    cases = suite.withColumn("user", prompts.user_message(F.transform(F.array_sort("retrieved"), label), F.trim("question")))
    cases = cases.withColumn("model", F.explode(F.array(F.lit("base"), F.lit("adapter"))))

    def answer(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            yield pdf[["case_id", "model"]].assign(answer=[generator(m, prompts.INSTRUCTION, u) for m, u in zip(pdf["model"], pdf["user"])])

    said = cut(cases.select("case_id", "model", "user").mapInPandas(answer, "case_id string, model string, answer string"))
    rows = said.join(suite.select("case_id", "category", "context_mode", "expectation.*", F.size("retrieved").alias("context_count")), "case_id").withColumnRenamed("required_source_numbers", "required_sources")
    assessed = scoring.assess(rows)
    if target:
        measured = {m: scoring.answer_metrics(assessed.where(F.col("model") == m)) for m in ("base", "adapter")}
        listed = {m: [r.asDict() for r in df.collect()] for m, df in measured.items()}
        listed["difference"] = [r.asDict() for r in scoring.metric_differences(measured["base"], measured["adapter"]).collect()]
        written = sinks.write_json_lines(assessed, f"{target}/answers", key="case_id")
        sinks.write_manifest(f"{target}/metrics.json", {"answers": written, "prompts": integrity.digest_of(cases.select("case_id", "user").distinct(), ["case_id", "user"]), "metrics": listed})
    return assessed


def export_training(units: DataFrame, examples: DataFrame, gold: DataFrame, target: str, k: int = 5, candidates: int = 20, most_tokens: int = export.MOST_TOKENS, refusal_ratio: float = sampling.REFUSAL_RATIO, augment: bool = True, resplit: bool = True) -> dict:
    """Write supported and refusal records, split by report, and a manifest.

    examples: (query_id, dataset, split, document_id, source_file, question, answer, program) and
    what else training_records() reads. Examples of one group never part; without resplit they keep
    their split, and a group in two splits raises.
    """
    queries = examples.select("query_id", "document_id", F.col("question").alias("query_text"))
    lineage = linkage.lineage(units)
    found = cut(ranking.bm25(units, queries, k=candidates, variant="plus", normalize_query=True))
    production = found.where(F.col("rank") <= k)
    contexts = export.oracle_augment(production, gold, lineage, k)
    supported = export.training_records(examples, contexts, units, lineage, gold, most_tokens)
    if not augment:
        supported = supported.where("context_mode = 'retrieved'")
    place = (lambda df: df) if resplit else (lambda df: df.withColumn("split", F.col("source_split")))
    supported = cut(place(supported))
    refusals = place(export.refusal_records(examples, export.refusal_contexts(production, found, lineage, gold, k), units, most_tokens))
    refusals = refusals.withColumn("example_id", F.concat(F.col("query_id").cast("string"), F.lit(":unsupported")))
    chosen = cut(sampling.refusal_sample(refusals, supported, refusal_ratio))
    whole = supported.withColumn("example_id", F.concat(F.col("query_id").cast("string"), F.lit(":supported"))).unionByName(chosen)
    integrity.require_none(export.invalid_records(whole, most_tokens), "records break a rule")
    integrity.require_none(integrity.split_overlaps(whole, "document_group_id"), "a report is in two splits")
    artifacts = {split: sinks.write_json_lines(whole.where(F.col("split") == split), f"{target}/split={split}", key="example_id") for split in SPLITS}
    n = F.col("sequence_token_count")
    rows = whole.groupBy("split").agg(F.count_if("answerable").alias("supported"), F.count_if(~F.col("answerable")).alias("refusals"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("tokens"), F.count_if("context_trimmed").alias("trimmed")).collect()
    counts = {r.split: r.asDict() for r in rows}
    shown = {f: {str(r.value): r.n for r in integrity.histogram(whole, f).collect()} for f in ("category", "context_mode", "unit_status", "answerable")}
    sinks.write_manifest(f"{target}/manifest.json", {"dataset": "training", "splits": counts, "artifacts": artifacts, "histograms": shown, "top_k": k, "refusal_ratio": refusal_ratio, "most_tokens": most_tokens, "augment": augment, "resplit": resplit})
    return counts


def export_chat(spark: SparkSession, targets: Sequence[str], target: str, splits: Sequence[str] = SPLITS) -> dict:
    """Plain chat records of prepared data sets with their gold context alone, one folder for each split."""
    artifacts = {}
    for split in _check_splits(list(splits)):
        whole = None
        for prepared in targets:
            t = read_prepared(spark, prepared, split)
            facts = t["examples"].select(F.col("example_id").alias("query_id"), F.posexplode("supporting_facts").alias("position", "f")).select("query_id", "position", "f.source_key", "f.element_id")
            texts = t["elements"].select("element_id", F.col("source_text" if "source_text" in t["elements"].columns else "text").alias("source_text"))
            asked = t["examples"].select(F.col("example_id").alias("query_id"), "dataset", F.lit(split).alias("split"), F.col("question.text").alias("question"), F.col("reference_answer.text").alias("answer"))
            records = export.chat_records(asked, linkage.context_of(facts, texts))
            whole = records if whole is None else whole.unionByName(records)
        artifacts[split] = sinks.write_json_lines(whole, f"{target}/{split}", key="query_id")
    sinks.write_manifest(f"{target}/manifest.json", {"dataset": "chat", "artifacts": artifacts})
    return artifacts


def export_units(units: DataFrame, target: str) -> dict:
    """Write units as canonical lines, fields that hold their default left out."""
    derived = F.col("retrieval_unit_kind") != "chunk"
    lean = units.withColumn("retrieval_unit_kind", F.when(derived, F.col("retrieval_unit_kind"))).withColumn("parent_source_element_ids", F.when(F.size("parent_source_element_ids") > 0, F.col("parent_source_element_ids")))
    return sinks.write_json_lines(lean, target, key="chunk_id")


def read_prepared(spark: SparkSession, target: str, split: str) -> dict[str, DataFrame]:
    """documents, elements and examples of a prepared split; the manifest must name the split. Empty files give empty tables."""
    found = readers.manifest(f"{target}/manifest.json")
    if split not in found.get("splits", {}):
        raise ValueError(f"{target} holds no split {split!r}")
    read = {name: spark.read.json(f"{target}/{split}/{name}") for name in KEYS}
    return {name: df if KEYS[name] in df.columns else spark.createDataFrame([], EMPTY[name]) for name, df in read.items()}


def _differing(spark: SparkSession, target: str, found: dict, split: str) -> DataFrame:
    """The tables of a split whose lines aren't those that the manifest counted and hashed."""
    told = found.get("artifacts", found["splits"]).get(split, {})
    wrong = [name for name in KEYS if told.get(name) != sinks.artifact(spark, f"{target}/{split}/{name}")]
    return spark.createDataFrame([("file differs from manifest", split, name) for name in wrong], "check_name string, split string, row_key string")


def validate_finqa(spark: SparkSession, target: str) -> DataFrame:
    """(check_name, split, row_key) of whatever is wrong with a prepared data set of single pages; none if it is sound."""
    found = readers.manifest(f"{target}/manifest.json", "finqa")
    named = lambda df, check, split, key: df.select(F.lit(check).alias("check_name"), F.lit(split).alias("split"), F.col(key).cast("string").alias("row_key"))
    parts: list[DataFrame] = []
    ids: DataFrame | None = None
    for split in found["splits"]:
        t = read_prepared(spark, target, split)
        facts = t["examples"].select("example_id", F.explode("supporting_facts.element_id").alias("element_id"))
        asked = t["examples"].select("example_id", F.col("question.document_id").alias("document_id"))
        parts.append(_differing(spark, target, found, split))
        parts += [named(integrity.duplicate_keys(t[name], [key]), f"{name[:-1]} repeats", split, key) for name, key in KEYS.items()]
        parts += [
            named(t["elements"].join(t["documents"], "document_id", "left_anti"), "element without document", split, "element_id"),
            named(asked.join(t["documents"], "document_id", "left_anti"), "example without document", split, "example_id"),
            named(integrity.missing_parents(facts, "example_id", "element_id", t["elements"], "element_id", "fact"), "fact without element", split, "row_key"),
        ]
        own = t["examples"].select("example_id", F.lit(split).alias("split"))
        ids = own if ids is None else ids.unionByName(own)
    if ids is not None:
        parts.append(named(integrity.split_overlaps(ids, "example_id"), "example in two splits", None, "example_id"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def validate_docfinqa(spark: SparkSession, target: str) -> DataFrame:
    """(check_name, split, row_key) of whatever is wrong with a prepared long-document data set; none if it is sound."""
    found = readers.manifest(f"{target}/manifest.json", "docfinqa")
    parts: list[DataFrame] = []
    named = lambda df, check, split, key: df.select(F.lit(check).alias("check_name"), F.lit(split).alias("split"), F.col(key).cast("string").alias("row_key"))
    ids: DataFrame | None = None
    for split, stats in found["splits"].items():
        parts.append(_differing(spark, target, found, split))
        sums = spark.createDataFrame([tuple(int(stats.get(c, 0)) for c in STATISTICS)], ", ".join(f"{c} long" for c in STATISTICS))
        parts.append(named(integrity.statistics_violations(sums), "statistics don't add up", split, "total"))
        t = {n: spark.read.schema(s).json(f"{target}/{split}/{n}") for n, s in PREPARED.items()}
        facts = t["examples"].select("example_id", F.explode("supporting_facts").alias("f")).select("example_id", "f.element_id", "f.score")
        parts += [
            named(integrity.duplicate_keys(t["documents"], ["document_id"]), "document repeats", split, "document_id"),
            named(integrity.duplicate_keys(t["elements"], ["document_id", "chunk_index"]), "window repeats", split, "document_id"),
            named(integrity.duplicate_keys(t["examples"], ["example_id"]), "example repeats", split, "example_id"),
            named(integrity.offset_violations(t["elements"], "document_id", t["documents"]), "window differs", split, "document_id"),
            named(integrity.missing_parents(facts, "example_id", "element_id", t["elements"], "element_id", "fact"), "fact without window", split, "row_key"),
            named(t["documents"].join(t["examples"].select(F.col("question.document_id").alias("document_id")), "document_id", "left_anti"), "document without example", split, "document_id"),
            named(t["elements"].join(t["documents"], "document_id", "left_anti"), "window without document", split, "element_id"),
            named(facts.where("score IS NULL"), "fact without score", split, "example_id"),
            named(t["examples"].where(~F.col("link_status").isin("exact", "equivalent")), "example isn't linked", split, "example_id"),
            named(t["examples"].agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != int(stats.get("normalized", 0))), "count differs from manifest", split, "n"),
        ]
        own = t["examples"].select("example_id", F.lit(split).alias("split"))
        ids = own if ids is None else ids.unionByName(own)
    if ids is not None:
        parts.append(named(integrity.split_overlaps(ids, "example_id"), "example in two splits", None, "example_id"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


EMPTY = {
    "documents": "document_id string, file_name string, source_uri string",
    "elements": "element_id string, document_id string, element_type string, source_text string, page_number int, parent_element_id string, table_coordinates struct<table_id:string, row_index:int>",
    "examples": "example_id string, dataset string, question struct<document_id:string, text:string>, reference_answer struct<text:string>, supporting_facts array<struct<source_key:string, element_id:string>>",
}
STATISTICS = ("total", "normalized", "unlinked", "ambiguous", "answer_mismatch", "evidence_incomplete", "duplicates", "skipped")
PREPARED = {
    "documents": "document_id string, text string",
    "elements": "document_id string, chunk_index int, char_start int, char_end int, text string, element_id string",
    "examples": "example_id string, question struct<document_id:string>, link_status string, supporting_facts array<struct<source_key:string, element_id:string, score:double>>",
}
RAW_SCHEMAS = {"finqa": FINQA_RAW, "docfinqa": DOCFINQA_RAW}
