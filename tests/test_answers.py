from __future__ import annotations

import pytest
from lodestrata.functions import ids
from lodestrata.operators import export, linkage, normalize, prompts, sampling, scoring
from pyspark.sql import functions as F

ANSWERS = "answer string, answerable boolean, expected_values array<string>, expected_units array<string>, expected_phrases array<string>, required_sources array<int>, context_count int"


def scored(spark, *row):
    return scoring.assess(spark.createDataFrame([row], ANSWERS)).select(*scoring.CHECKS).first().asDict()


def test_operands_and_source_numbers_are_no_values(spark):
    s = scored(spark, "5 + 5 = 10, the answer is 12 [Source 1]", True, ["5"], ["$"], [], [1], 3)
    assert s["numeric"] is False and s["units"] is False and s["citations"] is True and s["overall"] is False
    assert scored(spark, "[Source 5] says so", True, ["5"], [], [], None, 3)["numeric"] is False
    assert scored(spark, "3 x 4 = $1,200.0 million", True, ["1200"], ["million", "$"], ["1,200.0 MILLION"], None, 1)["overall"] is True


def test_refusals_are_exact(spark):
    assert scored(spark, prompts.UNSUPPORTED, False, None, None, None, None, 0)["overall"] is True
    assert scored(spark, prompts.UNSUPPORTED.lower(), False, [], [], [], [], 0)["refusal"] is False
    assert scored(spark, prompts.UNSUPPORTED, True, ["1"], [], [], [], 0)["content"] is False


def test_phrases_end_at_words_and_citations_stay_in_range(spark):
    assert scored(spark, "net incomes", True, [], [], ["income"], [], 1)["content"] is False
    assert scored(spark, "ok [Source 1] [Source 9]", True, [], [], [], [1], 3)["citations"] is False
    with pytest.raises(Exception, match="blank"):
        scored(spark, " ", True, [], [], [], [], 0)


@pytest.mark.parametrize(
    "answer, question, evidence, program, want",
    [
        ("$5 million.", "q", [], None, ("$5 million", ["$", "million"], "preserved")),
        ("a lot", "q", [], None, ("a lot", [], "not_applicable")),
        ("12.5", "what percentage in million?", [], None, ("12.5% million", ["%", "million"], "inferred")),
        ("1,200", "q", ["it was $ 1200 million."], None, ("$1,200 million", ["$", "million"], "inferred")),
        ("7", "q", ["$ 5 and $ 2"], "add(5, 2)", ("$7", ["$"], "inferred")),
        ("7", "q", ["$ 5 and 2"], "divide(5, 2)", (None, [], "ambiguous")),
        ("7", "q", ["five"], None, ("7", [], "not_applicable")),
        ("12.50", "q", ["rates were 12.5 % and 12.5% then"], None, ("12.50%", ["%"], "inferred")),
        ("12.5", "q", ["12.5% here, 12.5 basis points there"], None, (None, [], "ambiguous")),
        (None, "q", [], None, ("", [], "not_applicable")),
    ],
)
def test_units_of_answers(spark, answer, question, evidence, program, want):
    rows = spark.createDataFrame([(answer, question, "\n".join(evidence), program)], "answer string, question string, evidence string, program string")
    got = export.infer_units(rows).first()
    assert (got.answer_text, got.answer_units, got.unit_status) == want


def test_augmentation_keeps_gold_and_size():
    got, put = export.augmented(["a", "b", "c"], ["z", "b"], 3, "q1")
    assert sorted(got) == ["a", "b", "z"] and put == ["z"]
    assert export.augmented(["a", "b", "c"], ["z", "b"], 3, "q1") == (got, put)
    with pytest.raises(ValueError):
        export.augmented([], ["a", "b"], 1, "q")


def test_budget_drops_the_last_without_gold(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id long, chunk_id string, rank int")
    u = spark.createDataFrame([("a", "w " * 50), ("b", "w " * 40), ("c", "w " * 30)], "chunk_id string, text string").withColumn("token_count", F.lit(None).cast("int"))
    g = spark.createDataFrame([(1, "ec")], "query_id long, element_id string")
    lineage = spark.createDataFrame([("c", "ec")], "chunk_id string, element_id string")
    got = {(x.query_id, x.chunk_id, x.rank, x.overflow) for x in export.budget_trim(r, u, 80, g, lineage).collect()}
    assert got == {(1, "a", 1, False), (1, "c", 2, False), (2, "a", 1, False)}


def test_context_that_gives_the_answer_away(spark):
    df = spark.createDataFrame([("it was 1,200.0 then", "1200."), ("it was 12001", "1200"), ("Net SALES rose", "net sales"), ("x", "y")], "c string, a string")
    assert [r.x for r in df.select(export.context_contains_answer(F.col("c"), F.col("a")).alias("x")).collect()] == [True, False, True, False]


def test_links(spark):
    known = spark.createDataFrame([("e1", "Q  one", "5", "s"), ("e0", "q one", "5", "s"), ("e2", "q two", "7", "s"), ("e3", "q two", "8", "t"), ("e4", "q two", "8", "u")], "example_id string, question string, answer string, signature string")
    asked = spark.createDataFrame([(1, "q ONE", "5"), (2, "q two", "7"), (3, "q two", "8"), (4, "q two", "9"), (5, "unknown", "1"), (6, None, None)], "record_id long, question string, answer string")
    got = {r.record_id: (r.link_status, r.linked_id) for r in linkage.link_questions(asked, known).collect()}
    assert got == {1: ("equivalent", "e0"), 2: ("exact", "e2"), 3: ("ambiguous", None), 4: ("answer_mismatch", None), 5: ("ambiguous", None), 6: ("ambiguous", None)}


def test_evidence_takes_the_lowest_index_on_a_tie(spark):
    facts = spark.createDataFrame([(1, "d", "net sales 1,200"), (2, "d", "nothing alike here"), (3, "d", "--")], "fact_id long, document_id string, evidence string")
    units = spark.createDataFrame([("d", "b", 1, "The net sales 1200 rose"), ("d", "a", 0, "net sales 1200"), ("d", "c", 2, None)], "document_id string, chunk_id string, chunk_index int, text string")
    assert [(r.fact_id, r.chunk_id, r.score) for r in linkage.match_evidence(facts, units).collect()] == [(1, "a", 1.0)]


def test_refusals_round_half_to_even(spark):
    supported = spark.createDataFrame([(f"s{i}", "d", "train") for i in range(10)], "example_id string, dataset string, source_split string")
    candidates = spark.createDataFrame([(f"r{i}", "d", "train") for i in range(10)], "example_id string, dataset string, source_split string")
    assert sampling.refusal_sample(candidates, supported, 0.2).count() == 2  # 2.5
    with pytest.raises(ValueError):
        sampling.refusal_sample(candidates, supported, 1.0)


def test_digests_equal_python(spark):
    import hashlib

    r = spark.createDataFrame([("é", "b")], "x string, y string").select(ids.digest(F.col("x"), F.col("y"), width=24).alias("d"), ids.nul_digest(F.col("x"), F.col("y")).alias("n")).first()
    raw = b"".join(len(p).to_bytes(8, "big") + p for p in ("é".encode(), b"b"))
    assert r.d == hashlib.sha256(raw).hexdigest()[:24]
    assert r.n == hashlib.sha256("é\0b".encode()).hexdigest()[:24]


def test_conflicting_rows_of_one_key_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert sampling.once_by_content(df, "k").count() == 2
    with pytest.raises(Exception, match="different rows"):
        sampling.once_by_content(df.union(spark.createDataFrame([(1, "z")], "k long, v string")), "k").collect()


RAW = '[{"id": "r1", "filename": "ABC/2025/page_10.pdf", "pre_text": ["Intro.", " "], "post_text": ["The end 5."], "table": [["h", "2025"], ["cash", "5"]], "qa": {"question": "How much cash?", "answer": "", "steps": [{"op": "add", "arg1": "1", "arg2": null, "res": ""}], "program": "add(1, 4)", "gold_inds": {"text_-1": "The end 5.", "table_1": "cash 5"}, "exe_ans": "5"}}]'


def test_records_become_documents_elements_and_examples(spark, tmp_path):
    from lodestrata.sources import readers

    (tmp_path / "train.json").write_text(RAW)
    raw = readers.finqa_split(spark, str(tmp_path), "train.json")
    e = {r.element_id.split(":")[-1]: (r.element_type, r.source_text, r.page_number) for r in normalize.finqa_elements(raw).collect()}
    assert e == {"text_0": ("paragraph", "Intro.", 10), "text_2": ("paragraph", "The end 5.", 10), "table": ("table", "h | 2025\ncash | 5", 10), "table_0": ("table_row", "h | 2025", 10), "table_1": ("table_row", "cash | 5", 10)}
    x = normalize.finqa_examples(raw, "train").first()
    assert x.reference_answer.text == "5" and x.reference_answer.steps[0].arguments == ["1"]
    assert [f.source_key for f in x.supporting_facts] == ["table_1", "text_2"]
    with pytest.raises(ValueError):
        readers.contained(str(tmp_path), "../x")
    with pytest.raises(FileNotFoundError):
        readers.contained(str(tmp_path), "none.json")


def test_long_documents_are_linked_and_counted(spark, tmp_path):
    import json

    from lodestrata.operators.integrity import preparation_statistics, statistics_violations
    from lodestrata.sources import readers

    (tmp_path / "train.json").write_text(RAW)
    doc = {"Context": "Long words. " * 20 + "The end 5. cash 5", "Question": "how much  cash?", "Program": "", "Answer": "5"}
    other = doc | {"Question": "what else?"}
    (tmp_path / "long.json").write_text(json.dumps([doc, doc, other]))
    out = normalize.docfinqa_normalized(readers.docfinqa_split(spark, str(tmp_path), "long.json"), readers.finqa_split(spark, str(tmp_path), "train.json"), "train", size=100, overlap=20)
    assert out["examples"].count() == 1 and out["documents"].count() == 1
    assert {f.source_key for f in out["examples"].first().supporting_facts} == {"text_-1", "table_1"}
    stats = preparation_statistics(out["statuses"])
    row = stats.first()
    assert (row.total, row.normalized, row.duplicates, row.ambiguous, row.skipped) == (3, 1, 1, 1, 2)
    assert statistics_violations(stats).count() == 0


@pytest.mark.parametrize(
    "file, document, path",
    [
        ("ABC\\2020\\Page_1.pdf", "d", "abc/2020"), (" ./ABC//2020/page_x.pdf ", "d", "abc/2020"), ("2020/page_1.pdf", "d", "2020/page_1.pdf"), ("A/B/c.pdf", "d", "a/b/c.pdf"),
        ("/a/page_1.pdf", "d", "/a"), (" ", "Doc:1", "doc:1"), (None, "Doc:1", "doc:1"),
    ],
)
def test_groups_of_reports(spark, file, document, path):
    import hashlib

    raw = path.encode()
    group = "source-group:" + hashlib.sha256(len(raw).to_bytes(8, "big") + raw).hexdigest()[:24]
    bucket = int(hashlib.sha256(group.encode()).hexdigest()[:8], 16) % 100
    split = "train" if bucket < 80 else "validation" if bucket < 90 else "test"
    found = ids.document_group(F.col("f"), F.lit(None).cast("string"), F.col("d"))
    r = spark.createDataFrame([(file, document)], "f string, d string").select(found.alias("g"), ids.assigned_split(found).alias("s")).first()
    assert (r.g, r.s) == (group, split)


def test_evidence_keeps_numbers_whole(spark):
    facts = spark.createDataFrame([(1, "d", "Margin was 12.5% of $1,200 in the year"), (2, "d", "2.5"), (3, "d", " ; "), (4, "e", "margin")], "fact_id long, document_id string, evidence string")
    units = spark.createDataFrame([("d", "a", 0, "margin was 12 and 5 of 1 200 in the year"), ("d", "b", 1, "In the year | margin: 12.5% of $1200 was"), ("d", "c", 2, None)], "document_id string, chunk_id string, chunk_index int, text string")
    got = {r.fact_id: (r.chunk_id, round(r.score, 3)) for r in linkage.match_evidence(facts, units).collect()}
    assert got == {1: ("b", 1.0), 2: ("b", 1.0)}


def test_rows_are_found_in_parents_whatever_separates_cells(spark):
    facts = spark.createDataFrame([("f", "d", "row"), ("g", "d", "none")], "fact_id string, document_id string, element_id string")
    units = spark.createDataFrame([("u", "d", ["table"], "a: b, $5.0")], "chunk_id string, document_id string, source_element_ids array<string>, text string")
    elements = spark.createDataFrame([("row", "table", "A | b | $5.0")], "element_id string, parent_element_id string, source_text string")
    assert {(r.fact_id, r.chunk_id, r.via) for r in linkage.map_gold(facts, units, elements, complete=False).collect()} == {("f", "u", "parent"), ("g", None, "unmapped")}
    with pytest.raises(Exception, match="no unit holds"):
        linkage.map_gold(facts, units, elements).collect()


def _supported(spark, room=4_096, checked=False, **more):
    asked = {"query_id": "q", "dataset": "x", "split": "test", "document_id": "d", "source_file": "a/b/page_1.pdf", "question": "how much?", "answer": "7.", "program": None, "normalized_program": None, "explanation": None, "n_steps": 0} | more
    examples = spark.createDataFrame([tuple(asked.values())], "query_id string, dataset string, split string, document_id string, source_file string, question string, answer string, program string, normalized_program string, explanation string, n_steps int")
    contexts = spark.createDataFrame([("q", 1, "a", False), ("q", 2, "g", True), ("q", 3, "b", False)], "query_id string, rank int, chunk_id string, injected boolean")
    units = spark.createDataFrame([("a", "one two", "chunk"), ("g", "it was $ 7 million", "table_row"), ("b", "three " * 50, "chunk")], "chunk_id string, text string, retrieval_unit_kind string")
    lineage = spark.createDataFrame([("g", "e")], "chunk_id string, element_id string")
    gold = spark.createDataFrame([("q", "e")], "query_id string, element_id string")
    records = export.training_records(examples, contexts, units, lineage, gold, room)
    if checked:
        assert export.invalid_records(records, room).count() == 0
    return records.first()


def test_supported_records(spark):
    r = _supported(spark, checked=True)
    assert r.messages[2].content == "The answer is $7 million. [Source 2]" and r.category == "table_lookup" and r.context_mode == "oracle_augmented"
    assert r.gold_source_numbers == [2] and r.oracle_injected_source_numbers == [2] and r.expected_units == ["$", "million"] and not r.context_trimmed
    told = _supported(spark, program="x", normalized_program=" add(3, 4) \n\n", n_steps=1)
    assert told.messages[2].content == "Calculation:\nadd(3, 4)\nThe answer is $7 million. [Source 2]" and told.category == "reasoning" and told.calculation_supervised
    assert _supported(spark, explanation="It paid $7 MILLION in all.").messages[2].content == "It paid $7 MILLION in all. [Source 2]"
    assert _supported(spark, explanation="See the note.").messages[2].content == "See the note. The answer is $7 million. [Source 2]"
    less = _supported(spark, room=r.sequence_token_count - 1, checked=True)
    assert less.source_chunk_ids == ["a", "g"] and less.context_trimmed and less.sequence_token_count < r.sequence_token_count
    least = less.sequence_token_count
    alone = _supported(spark, room=least - 1)
    assert alone.source_chunk_ids == ["g"] and alone.gold_source_numbers == [1]
    assert _supported(spark, room=30) is None


def test_refusals_lose_sources_from_the_end(spark):
    examples = spark.createDataFrame([("q", "x", "test", "d", None, "how much?", "7")], "query_id string, dataset string, split string, document_id string, source_file string, question string, answer string")
    contexts = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, rank int, chunk_id string")
    units = spark.createDataFrame([("a", "one two"), ("b", "three " * 50)], "chunk_id string, text string")
    whole = export.refusal_records(examples, contexts, units).first()
    assert whole.source_chunk_ids == ["a", "b"] and whole.messages[2].content == prompts.UNSUPPORTED and not whole.context_trimmed
    less = export.refusal_records(examples, contexts, units, whole.sequence_token_count - 1).first()
    assert less.source_chunk_ids == ["a"] and less.context_trimmed
    assert export.refusal_records(examples, contexts, units, 20).count() == 0
    assert export.refusal_records(examples.withColumn("answer", F.lit("Two.")), contexts, units).count() == 0


def test_numbers_of_any_length(spark):
    rows = [("0012.50", "12.5"), ("-0.0", "0"), ("+1,234", "1234."), ("9" * 60 + ".10", "9" * 60 + ".1"), (".5", "0.50")]
    r = spark.createDataFrame(rows, "a string, b string").select((scoring.exact_number(F.col("a")) == scoring.exact_number(F.col("b"))).alias("same")).collect()
    assert all(x.same for x in r)
    assert spark.range(1).select(scoring.exact_number(F.lit("1.2.3")).alias("x")).first().x is None
