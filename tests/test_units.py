from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from lodestrata.operators import chunker, tables
from lodestrata.operators.windows import char_windows, latest

HTML = "# Balance\n\nSome words.\n\n<table><thead><tr><th>item</th><th>2023</th></tr></thead><tbody><tr><td>cash</td><td>5</td></tr><tr><td>CASH</td><td>5</td></tr><tr><td>debt</td><td>7</td></tr></tbody></table>"


def test_windows_at_exact_size_and_beyond(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "abcdefghijk"), (3, ""), (4, None), (5, "y" * 25)], "doc_id long, text string")
    rows = [tuple(r) for r in char_windows(df, size=10, overlap=4).orderBy("doc_id", "chunk_index").collect()]
    assert rows[0] == (1, 0, 0, 10, "x" * 10)
    assert rows[1:3] == [(2, 0, 0, 10, "abcdefghij"), (2, 1, 6, 11, "ghijk")]
    assert [r[1:4] for r in rows if r[0] == 5] == [(0, 0, 10), (1, 6, 16), (2, 12, 22), (3, 18, 25)]
    with pytest.raises(ValueError):
        char_windows(df, size=5, overlap=5)


def test_latest_delivery_wins(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'old', TIMESTAMP_NTZ'2024-01-01'), (1, 'new', TIMESTAMP_NTZ'2024-01-02'), (2, 'x', NULL), (NULL, 'y', NULL) AS t(k, v, received_at)")
    assert {(r.k, r.v) for r in latest(df, "k").collect()} == {(1, "new"), (2, "x")}


def test_html_rows_are_canonical_and_once(spark):
    schema = "chunk_id string, document_id string, document_sha256 string, filename string, chunk_index int, page_start int, page_end int, source_element_ids array<string>, text string"
    df = spark.createDataFrame([("c1", "d", "h", "f", 0, 1, 1, ["e"], HTML), ("c2", "d", "h", "f", 1, 1, 1, ["e2"], "no table"), ("c3", "d", "h", "f", 2, 1, 1, ["e3"], None)], schema)
    rows = {(r.retrieval_unit_kind, r.text) for r in tables.table_row_units(df).collect()}
    assert rows == {("table_row", "Table: Balance\nitem: cash | 2023: 5"), ("table_row", "Table: Balance\nitem: debt | 2023: 7"), ("narrative", "# Balance\n\nSome words."), ("chunk", "no table"), ("chunk", None)}


def test_pipe_tables_and_headers():
    text = "# T\n| a | b |\n|---|---|\n| 1 | 2 |\n| a | b |\nafter"
    (t,) = tables.tables_of(text)
    assert (t.title, t.columns, t.rows) == ("T", ("a", "b"), (("1", "2"),))
    assert tables.narrative(text, [t]) == "# T\nafter"
    two = tables.tables_of("<table><tr><th>x</th></tr><tr><th>y</th></tr><tr><td>1</td></tr></table>")[0]
    assert two.columns == ("x / y",) and two.title == "Untitled table"
    assert tables.tables_of("<table><tr><td>1</td><td>2</td></tr></table>")[0].columns == ("Column 1", "Column 2")


def test_blocks_know_fences_tables_and_headings():
    md = "# A\n\npara one\nstill one\n\n```\n# no heading\n| no | table |\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## B\n<table>\n<tr></tr>\n</table>\nend"
    assert [(b.kind, b.text.split("\n")[0]) for b in chunker.blocks_of(md)] == [("heading", "# A"), ("prose", "para one"), ("code", "```"), ("pipe", "| a | b |"), ("heading", "## B"), ("html", "<table>"), ("prose", "end")]


def test_headings_travel_with_their_blocks():
    units = chunker.chunk_page("d", 1, "# A\n\n## B\n\nwords here\n\n# C", limits=chunker.Limits(3, 20, 0))
    assert [u[0] for u in units] == ["# A\n\n## B\n\nwords here", "# C"]
    assert len(units[0][1]) == 3


def test_large_tables_repeat_their_header():
    rows = "\n".join(f"| r{i} | {i} |" for i in range(30))
    units = chunker.chunk_page("d", 1, f"| a | b |\n|---|---|\n{rows}", limits=chunker.Limits(60, 80, 0))
    assert len(units) > 1 and all(u[0].startswith("| a | b |\n|---|---|\n") and u[2] <= 80 for u in units)
    assert sum(u[0].count("| r") for u in units) == 30
    with pytest.raises(ValueError):
        chunker.chunk_page("d", 1, "| a | b |\n|---|---|\n| " + "w " * 100 + "|", limits=chunker.Limits(10, 20, 0))


def test_overlap_is_prose_of_the_same_section():
    md = "# A\n\n" + " ".join(f"a{i}." for i in range(30)) + "\n\n" + " ".join(f"b{i}." for i in range(30)) + "\n\n# B\n\n" + " ".join(f"c{i}." for i in range(30))
    units = [u[0] for u in chunker.chunk_page("d", 1, md, limits=chunker.Limits(70, 90, 10))]
    assert len(units) == 3
    assert "a29." in units[1] and "b0." in units[1]
    assert "b29" not in units[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# H", "## G", "word " * 30, "One. Two. Three.", "```\ncode\n```", "x" * 50, "| a | b |\n|---|---|\n| 1 | 2 |"]), max_size=12), st.integers(8, 40))
def test_no_unit_is_too_large_and_no_word_is_lost(parts, most):
    md = "\n\n".join(parts)
    try:
        units = chunker.chunk_page("d", 1, md, limits=chunker.Limits(max(1, most // 2), most, most // 4))
    except ValueError:
        return  # a table row or its headings need more than a unit
    assert all(u[2] <= most for u in units)
    joined = " ".join(u[0] for u in units)
    # a heading that another replaces before any text has no unit to stand in
    assert set(md.split()) - {"#", "##", "H", "G"} <= set(joined.split())


def test_given_ids_must_match():
    with pytest.raises(ValueError):
        chunker.chunk_page("d", 1, "one\n\ntwo", ["a"])
    with pytest.raises(ValueError):
        chunker.chunk_page("d", 1, "one\n\ntwo", ["a", "a"])
    assert chunker.chunk_page("d", 1, "  ") == []


def test_markdown_units_number_the_document(spark):
    pages = spark.createDataFrame([("d", 2, "second", None), ("d", 1, "first", ["e"])], "document_id string, page_number int, markdown string, source_element_ids array<string>")
    rows = chunker.markdown_units(pages).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_start, r.text) for r in rows] == [(0, 1, "first"), (1, 2, "second")]
    import hashlib

    assert rows[0].chunk_id == "chunk:" + hashlib.sha256(b"d\x001\x000\x00first").hexdigest()[:24]
