from __future__ import annotations

import json

import pytest
from lodestrata.operators import evaluation
from lodestrata import __main__ as cli
from lodestrata.plans import pipelines
from lodestrata.plans.settings import Settings
from lodestrata.sources import readers, sinks
from lodestrata.streaming import ingest
from pyspark.sql import functions as F


def raw(n, question="How much cash?"):
    return {"id": f"r{n}", "filename": f"ABC/2025/page_{n}.pdf", "pre_text": ["Intro words."], "post_text": ["The end."], "table": [["h", "2025"], ["cash", str(n)]], "qa": {"question": question, "answer": str(n), "steps": [], "program": "x", "gold_inds": {"table_1": f"cash {n}"}, "exe_ans": str(n)}}


def test_prepare_writes_splits_samples_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([raw(i) for i in range(200)]))
    (tmp_path / "b.json").write_text(json.dumps([raw(i) for i in range(200, 210)]))
    target = str(tmp_path / "out")
    m = pipelines.prepare_finqa(spark, str(tmp_path), {"train": "a.json", "test": "b.json"}, target, "0" * 40)
    assert m["splits"]["train"]["examples"]["records"] == 200
    assert m == json.loads((tmp_path / "out/manifest.json").read_text())
    got = pipelines.read_prepared(spark, target, "test")
    assert got["elements"].count() == 50 and spark.read.json(f"{target}/samples/train/examples").count() == 128
    again = pipelines.prepare_finqa(spark, str(tmp_path), {"train": "a.json", "test": "b.json"}, target, "0" * 40)
    assert again == m
    with pytest.raises(ValueError):
        pipelines.prepare_finqa(spark, str(tmp_path), {"train": "a.json", "nonsense": "b.json"}, target, "0" * 40)
    (tmp_path / "b.json").write_text(json.dumps([raw(5)]))
    with pytest.raises(ValueError, match="two splits"):
        pipelines.prepare_finqa(spark, str(tmp_path), {"train": "a.json", "test": "b.json"}, target, "0" * 40)


def _world(spark):
    units = spark.createDataFrame([("u1", "d", "cash was 5 in the year", ["e1"], 1, 1, 6), ("u2", "d", "debt was 7", ["e2"], 1, 2, 3), ("u3", "d", "the board met", ["e3"], 3, 3, 3)], "chunk_id string, document_id string, text string, source_element_ids array<string>, page_start int, page_end int, token_count int")
    queries = spark.createDataFrame([(1, "a", "d", "how much debt?"), (2, "b", "d", "who met?")], "query_id long, dataset string, document_id string, query_text string")
    gold = spark.createDataFrame([(1, "e2"), (1, " e2 "), (1, "e1"), (2, "e3"), (2, "")], "query_id long, element_id string")
    return units, queries, gold


def test_benchmarks_and_deltas(spark):
    units, queries, gold = _world(spark)
    evals, metrics = pipelines.benchmark(units, queries, gold)
    rows = {r.query_id: r for r in evals.collect()}
    assert rows[1].n_gold == 2 and rows[1].hit_1 == 1 and rows[1].recall_1 == 0.5 and rows[1].recall_3 == 1.0 and rows[2].first_relevant_rank == 1
    m = {r.scope: r for r in metrics.collect()}
    assert m["combined"].mrr == 1.0 and m["combined"].recall_1 == 0.75 and m["a"].n_queries == 1
    vectors = (spark.createDataFrame([("u1", [1.0, 0.0]), ("u2", [0.0, 1.0]), ("u3", [1.0, 1.0])], "chunk_id string, embedding array<double>"), spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, embedding array<double>"))
    _, dense = pipelines.benchmark(units, queries, gold, "dense", vectors)
    _, hybrid = pipelines.benchmark(units, queries, gold, "hybrid", vectors)
    delta = {(r.scope, r.metric): r.delta for r in evaluation.deltas(metrics, dense).collect()}
    assert delta["b", "hit_1"] == -1.0 and delta["a", "hit_1"] == 0.0 and hybrid.count() == 3
    with pytest.raises(Exception, match="different queries"):
        evaluation.deltas(metrics, dense.withColumn("n_queries", F.col("n_queries") + 1)).collect()
    with pytest.raises(ValueError):
        pipelines.benchmark(units, queries, gold, "dense")


def test_export_keeps_gold_and_groups(spark, tmp_path):
    units, queries, gold = _world(spark)
    examples = queries.select("query_id", "dataset", F.lit("train").alias("split"), "document_id", F.lit("A/2020/page_1.pdf").alias("source_file"), F.col("query_text").alias("question"), F.lit("7").alias("answer"), F.lit("debt was 7").alias("evidence"), F.lit(None).cast("string").alias("program"))
    counts = pipelines.export_training(units, examples, gold.where("element_id <> ''").select("query_id", F.trim("element_id").alias("element_id")), str(tmp_path / "x"), k=2, refusal_ratio=0.5)
    assert sum(c["supported"] for c in counts.values()) == 2 and len(counts) == 1
    rows = spark.read.json(str(tmp_path / "x")).where("answerable").collect()
    assert all("[Source" in r.messages[2].content for r in rows)


def test_suite_of_two_models(spark, tmp_path):
    chunk = {"chunk_id": "c", "document_id": "d", "text": "sales were 5", "page_start": 1, "page_end": 1, "source_element_ids": ["e"]}
    case = {"case_id": "one", "category": "value", "context_mode": "retrieved", "question": "sales?", "expectation": {"answerable": True, "expected_values": ["5"], "expected_units": [], "expected_phrases": [], "required_source_numbers": [1]}, "retrieved": [{"rank": 1, "score": 1.0, "chunk": chunk}]}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"schema_version": 1, "name": "s", "cases": [case]}))
    out = pipelines.evaluate_suite(readers.evaluation_suite(spark, str(path)), lambda m, s, u: "the answer is 5 [Source 1]" if m == "adapter" and "sales were 5" in u else "no idea")
    assert {r.model: r.overall for r in out.collect()} == {"base": False, "adapter": True}
    path.write_text(json.dumps({"schema_version": 2, "name": "s", "cases": [case]}))
    with pytest.raises(Exception, match="unknown suite version"):
        readers.evaluation_suite(spark, str(path)).collect()


def test_sources_refuse_what_doesnt_fit(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"Context": "a", "Question": "b", "Program": "", "Answer": "c", "More": 1}]')
    with pytest.raises(ValueError, match="unknown keys"):
        readers.docfinqa_split(spark, str(tmp_path), "x.json")
    (tmp_path / "y.json").write_text('[{"Context": " ", "Question": "b", "Program": "", "Answer": "c"}]')
    with pytest.raises(Exception, match="Context is blank"):
        readers.docfinqa_split(spark, str(tmp_path), "y.json").collect()
    (tmp_path / "s.toml").write_text('name = "finqa"\nrevision = "abc"\n')
    with pytest.raises(ValueError):
        readers.settings(str(tmp_path / "s.toml"))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="no object"):
        readers.json_objects(spark, str(tmp_path / "l.jsonl")).collect()
    (tmp_path / "m.json").write_text('{"dataset": "finqa"}')
    assert readers.manifest(str(tmp_path / "m.json"), "finqa") and readers.document_files(spark, str(tmp_path / "m.json")).first().document_id.startswith("sha256:")
    with pytest.raises(ValueError):
        readers.manifest(str(tmp_path / "m.json"), "other")
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, " ")], "document_id string, page_number int, markdown string")
    assert readers.pages_text(pages).first().markdown == "<!-- page: 1 -->\n\na\n\n<!-- page: 2 -->\n\nb"


def test_failed_writes_leave_the_old_file(spark, tmp_path, monkeypatch):
    path = tmp_path / "m.json"
    sinks.write_manifest(str(path), {"a": 1})
    monkeypatch.setattr(sinks, "_rename", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        sinks.write_manifest(str(path), {"a": 2})
    assert json.loads(path.read_text()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1


def test_streams(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    page = {"document_id": "d", "page_number": 1, "markdown": "# A\n\nwords", "received_at": "2024-01-01T00:00:00"}
    (land / "1.json").write_text(json.dumps(page) + "\n" + json.dumps(page | {"page_number": 2, "markdown": "more"}))
    (land / "2.json").write_text(json.dumps(page))
    def land_all():
        ingest.units_sink(ingest.page_stream(spark, str(land)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return sorted((r.chunk_index, r.text) for r in ingest.current_units(spark, str(tmp_path / "out")).collect())

    assert [t for _, t in land_all()] == ["# A\n\nwords", "more"]
    (land / "3.json").write_text(json.dumps(page | {"page_number": 3, "markdown": "# B\n\nlate"}))
    late = land_all()
    assert [i for i, _ in late] == list(range(len(late))) and [t for _, t in late][-1] == "# B\n\nlate" and len(late) >= 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in ingest.windowed_counts(events).collect()] == [(2, 3.0)]


def test_the_rest_doesnt_need_the_llm_subpackage():
    from pathlib import Path

    import lodestrata

    root = Path(lodestrata.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lodestrata.llm" not in p.read_text(), p


def test_service_answers_from_rows_and_prose(spark):
    from lodestrata.plans.service import EvidenceService

    service = EvidenceService()
    questions = spark.createDataFrame([(1, "d", "how much cash?"), (2, "x", "unknown document?")], "query_id long, document_id string, query_text string")
    with pytest.raises(ValueError):
        service.search(questions)
    md = "# Balance\n\nThe board met in May.\n\n| item | 2023 |\n|---|---|\n| cash | 5 |\n| debt | 7 |"
    units = service.index(spark.createDataFrame([("d", 1, md, None)], "document_id string, page_number int, markdown string, source_element_ids array<string>"))
    assert sorted(r.retrieval_unit_kind for r in units.collect()) == ["narrative", "table_row", "table_row"]
    got = {r.query_id: r for r in service.ask(questions, lambda s, u: "5 [Source 1]" if "cash | 2023: 5" in u else "none").collect()}
    assert got[1].answer == "5 [Source 1]" and got[1].citations[0].page_label == "1"
    assert got[2].answer == "none" and got[2].citations is None
    service.clear()
    with pytest.raises(ValueError):
        service.search(questions)


def test_long_document_output_is_validated(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([raw(5)]))
    doc = {"Context": "Long words. " * 30 + "cash 5", "Question": "how much cash?", "Program": "", "Answer": "5"}
    (tmp_path / "l.json").write_text(json.dumps([doc, doc]))
    finqa = readers.finqa_split(spark, str(tmp_path), "a.json")
    target = str(tmp_path / "out")
    m = pipelines.prepare_docfinqa(spark, str(tmp_path), {"train": "l.json"}, finqa, target, "0" * 40, size=100, overlap=20)
    assert m["splits"]["train"]["normalized"] == 1 and m["splits"]["train"]["duplicates"] == 1
    assert pipelines.validate_docfinqa(spark, target).count() == 0
    files = list((tmp_path / "out/train/elements").glob("*.txt"))
    for f in files:
        f.write_text(f.read_text().replace("Long", "Lung"))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert {r.check_name for r in pipelines.validate_docfinqa(spark, target).collect()} == {"window differs", "file differs from manifest"}


def test_benchmarks_are_written_and_compared(spark, tmp_path):
    units, queries, gold = _world(spark)
    first = pipelines.run_benchmark(units, queries, gold, str(tmp_path / "a"))
    again = pipelines.run_benchmark(units, queries, gold, str(tmp_path / "b"), baseline=str(tmp_path / "a"))
    assert first["fingerprints"] == again["fingerprints"] and all(v == 0 for row in again["comparison"].values() for v in row.values())
    assert sinks.artifact(spark, str(tmp_path / "a/evaluations")) == first["evaluations"] and first["evaluations"]["records"] > 0
    with pytest.raises(ValueError, match="another corpus"):
        pipelines.run_benchmark(units.limit(1), queries, gold, str(tmp_path / "c"), baseline=str(tmp_path / "a"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "a.json").write_text(json.dumps([raw(5)]))
    (tmp_path / "s.toml").write_text('revision = "%s"\n[files]\ntest = "a.json"\n' % ("0" * 40))
    out = str(tmp_path / "out")
    assert cli.main(["prepare", str(tmp_path / "s.toml"), str(tmp_path), out]) == 0
    assert cli.main(["validate", out]) == 0
    for retriever in ("bm25", "dense", "hybrid"):
        assert cli.main(["benchmark", retriever, out, "--target", str(tmp_path / retriever)] + (["--baseline", str(tmp_path / "bm25")] if retriever != "bm25" else [])) == 0
    assert cli.main(["export-training", out, "--target", str(tmp_path / "rag"), "--split", "test"]) == 0
    assert cli.main(["export-chat", out, "--target", str(tmp_path / "chat"), "--split", "test"]) == 0
    lines = [line for f in (tmp_path / "chat/test").glob("*.txt") for line in f.read_text().splitlines()]
    assert [m["role"] for m in json.loads(lines[0])["messages"]] == ["system", "user", "assistant"]
    for f in (tmp_path / "out/test/elements").glob("*.txt"):
        f.write_text("")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    capsys.readouterr()
    assert cli.main(["validate", out]) == 1
    assert {r["check_name"] for r in json.loads(capsys.readouterr().out)} == {"file differs from manifest", "fact without element"}


def test_splits_share_reports_but_no_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([raw(1), raw(2)]))
    (tmp_path / "b.json").write_text(json.dumps([raw(3)]))
    (tmp_path / "c.json").write_text(json.dumps([raw(2) | {"id": "other"}]))
    m = pipelines.prepare_finqa(spark, str(tmp_path), {"test": "a.json", "train": "b.json"}, str(tmp_path / "x"), "0" * 40)
    assert m["shared_reports"] == [{"left_split": "test", "right_split": "train", "n_reports": 1}]
    with pytest.raises(ValueError, match="documents are in two splits"):
        pipelines.prepare_finqa(spark, str(tmp_path), {"test": "a.json", "train": "c.json"}, str(tmp_path / "y"), "0" * 40)


def test_exported_units_leave_defaults_out(spark, tmp_path):
    rows = [("a", "chunk", None, []), ("b", "table_row", "a", ["e"])]
    units = spark.createDataFrame(rows, "chunk_id string, retrieval_unit_kind string, parent_chunk_id string, parent_source_element_ids array<string>")
    assert pipelines.export_units(units, str(tmp_path / "u"))["records"] == 2
    lines = sorted(line for f in (tmp_path / "u").glob("*.txt") for line in f.read_text().splitlines())
    assert lines == ['{"chunk_id":"a"}', '{"chunk_id":"b","parent_chunk_id":"a","parent_source_element_ids":["e"],"retrieval_unit_kind":"table_row"}']


def test_paths_on_named_file_systems(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text("[]")
    root = f"file://{tmp_path}/a"
    assert readers.contained(root, "x.json") == f"{root}/x.json"
    for wrong, error in (("../b", ValueError), ("y.json", FileNotFoundError)):
        with pytest.raises(error):
            readers.contained(root, wrong)


def test_settings_come_from_the_environment():
    assert Settings.from_environment({}) == Settings() and Settings.from_environment({"LODESTRATA_TOP_K": "7"}).top_k == 7
    assert Settings.from_environment({"LODESTRATA_ENCODER_REVISION": " "}).encoder_revision is None
    for wrong in ({"LODESTRATA_TOP_K": "x"}, {"LODESTRATA_TOP_K": "0"}, {"LODESTRATA_TOP_K": "30"}, {"LODESTRATA_DEVICE": " "}):
        with pytest.raises(ValueError):
            Settings.from_environment(wrong)


def test_rules_of_records(spark):
    from lodestrata.operators import constraints

    c = spark.createDataFrame([("a", "ratio", [1.0, 0.0], 1.0), ("b", "sum", [1.0], 1.0), ("c", "difference", [1.0, 2.0], -1.0), ("d", "percentage_change", [0.0, 2.0], None), ("e", "other", [1.0, 1.0], 1.0)], "calculation_id string, operation string, operands array<double>, result double")
    assert {tuple(r) for r in constraints.calculation_violations(c).collect()} == {("a", "divides by zero"), ("b", "needs at least two operands"), ("d", "divides by zero"), ("d", "no result"), ("e", "unknown operation")}
    x = spark.createDataFrame([("a", ["e"], ["s"], [2, 1]), ("b", [], ["s"], [1, 1]), ("c", ["e"], ["s"], [1, 2])], "citation_id string, evidence_ids array<string>, source_element_ids array<string>, page_numbers array<int>")
    assert {tuple(r) for r in constraints.citation_violations(x).collect()} == {("a", "pages repeat or aren't sorted"), ("b", "no evidence"), ("b", "pages repeat or aren't sorted")}
    a = spark.createDataFrame([("a", "answered", "x", [], []), ("b", "insufficient_evidence", None, [], ["k", "k"])], "answer_id string, status string, text string, citation_ids array<string>, calculation_ids array<string>")
    assert {tuple(r) for r in constraints.answer_violations(a).collect()} == {("a", "an answer needs a citation"), ("b", "calculations repeat")}
    d = spark.createDataFrame([("d", "f", 0, "zz"), ("e", " ", None, None)], "document_id string, file_name string, page_count int, checksum_sha256 string")
    assert {tuple(r) for r in constraints.document_violations(d).collect()} == {("d", "page_count is below 1"), ("d", "checksum isn't 64 hex digits"), ("e", "file_name is blank")}
