from __future__ import annotations

import time

import pytest
from hypothesis import given, settings, strategies as st
from lodestrata.llm import bpe, markup, pieces, queries
from lodestrata.llm.tokens import TOKEN, token_count
from pyspark.sql import functions as F

ODD = st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=300)
#: Java and Python know different versions of Unicode, so letters that are new to one are left out.
SHARED = st.text(alphabet=st.sampled_from("aZ09_ \t\n\r\x0b\x1c\x85\xa0\u2028\u200b.,;-–$€%éßñΩжя中文字①½²́😀…\ufeff"), max_size=120)


@pytest.fixture(scope="session")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_ids_equal_the_public_tokenizer(reference, text):
    assert bpe.load().encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_long_words_take_the_heap_and_agree(reference):
    b = bpe.load()
    for text in ("a" * 20_000, "abcab" * 3_000, "<|endoftext|>" * 200, "é" * 2_000, " " * 5_000 + "x", "😀" * 800):
        assert b.encode(text) == reference.encode(text, add_special_tokens=False).ids
        piece = text.encode()[:150]
        assert b._by_rank_array(piece) == b._by_heap(piece)


def test_encoding_rows(spark):
    df = spark.createDataFrame([(1, "net sales", "x"), (2, "", "x"), (3, None, "x"), (1, "net sales", "y"), (None, " a", "z")], "doc_id long, text string, ids string")
    rows = [(r.doc_id, r.ids) for r in bpe.encode_column(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, rows[0][1]), (2, []), (3, []), (1, rows[0][1]), (None, bpe.load().encode(" a"))], key=str)
    assert [r.n for r in bpe.encode_column(df, out="n", counts_only=True).collect()] == [len(i) for _, i in rows]
    assert bpe.encode_column(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(SHARED)
def test_token_counts_agree_between_java_and_python(spark_session, text):
    got = spark_session.range(1).select(token_count(F.lit(text)).alias("n")).first().n
    assert got == len(TOKEN.findall(text))


@pytest.fixture(scope="session")
def spark_session(spark):
    return spark


STRUCTURED = st.lists(st.sampled_from(["# H", "Title\n=====", "word " * 40, "One. Two? Three!", "- item\n- item two", "1,2,3," * 60, "| a | b |\n|---|---|\n| 1 | 2 |", "```\n# code\n\nmore\n```", "<ul><li>a</li><li>b</li></ul>", "x" * 300, "é ü ß", "\t \n"]), max_size=14)


@settings(max_examples=150, deadline=None)
@given(STRUCTURED, st.integers(1, 60), st.integers(0, 20))
def test_pieces_fit_cover_and_share(parts, most, overlap):
    overlap = min(overlap, most - 1)
    text = "\n\n".join(parts)
    tokens = TOKEN.findall(text)
    found = pieces.split_text(text, most, overlap)
    assert [t for p in found for t in TOKEN.findall(text[p.start : p.end])[p.shared :]] == tokens
    for p in found:
        assert TOKEN.findall(text[p.start : p.end]) == tokens[p.first : p.last] and p.last - p.first <= most
    for a, b in zip(found, found[1:]):
        assert b.shared == overlap and b.first == a.last - overlap and a.first <= b.first


def test_cuts_fall_on_natural_boundaries():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(20)) + "." for _ in range(4))
    assert {p.boundary for p in pieces.split_text(text, 25)} == {"start", "block"}
    text = "# A\n\n" + "a " * 30 + "\n\n# B\n\n" + "b " * 30
    found = pieces.split_text(text, 40)
    assert [text[p.start : p.end].split()[1] for p in found] == ["A", "B"] and found[1].boundary == "section"
    with pytest.raises(ValueError):
        pieces.split_text("x", 5, 5)


def test_very_long_texts_are_cut_fast():
    start = time.time()
    assert sum(p.last - p.first for p in pieces.split_text("a b. " * 200_000, 450)) == 600_000
    assert len(pieces.split_text("1," * 100_000, 450, 50)) > 400
    assert pieces.split_text("z" * 1_000_000, 10)[0].last == 1
    assert time.time() - start < 60


def test_only_oversized_units_come_out(spark):
    long = "word " * 500
    rows = [("a", long, "standard", "x"), ("a", long, "standard", "x"), ("b", "short", "standard", "x"), ("c", None, None, "x"), ("d", "", "compact", "x"), ("e", "word " * 300, None, "x"), ("f", "word " * 300, "compact", "x"), ("g", long, "no such", "x"), (None, long, "standard", "x"), (None, long, "standard", "x")]
    units = spark.createDataFrame(rows, "chunk_id string, text string, profile string, limit string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    profiles = spark.createDataFrame([("standard", 450, 50), ("compact", 220, 25)], "profile string, max_tokens int, overlap_tokens int")
    out = pieces.split_oversized(units, profiles).where("piece_index = 0").collect()
    assert sorted((r.chunk_id or "-") for r in out) == ["-", "-", "a", "f", "g"]
    assert pieces.split_oversized(units.limit(0), profiles).count() == 0


CLEAN = [
    "Tivuveston & Partners holds 5 * 3 * 2 = 30 options.", "Leverage stayed in the band 2.5 < ratio < 3.0, and coverage was > 4.", "Terms: net 30 | net 60 by class.", "The template uses {name} and {a, b, c}.",
    "The file sits under C:\\reports\\2018\\close and more.", "a ~5% gap remains -- see below (a/b).", "Growth of 10^3; the ratio p_1/p_2 and net_sales_2014.", "Values lie within [0, 1] and are cited as [Source 4].",
    "Per-share data are restated*, see note 24. Others are restated*, see 25.", "Ranked #1 in the region and #3 overall.", "item\t2017\t2016\nsales\t5\t6", "It cost $5 million and $6 more.", "don't 'quote' me", "R&D and AT&T", "", "x",
]
MARKED = {
    "<p>word": "html tag", "a </ i> b": "html tag", "x <!-- page 3 -->": "html comment", "a&nbsp;b": "entity", "AT&amp;T": "entity", "## Title": "markdown heading", "Title\n=====\ntext": "markdown heading", "a **b c** d": "markdown strong",
    "a *b c* d": "markdown emphasis", "an _b c_ d": "markdown emphasis", "`code": "markdown code", "see [this](/notes/1)": "markdown link", "![x](y.png)": "markdown link", "> quoted words": "markdown quote", "- one\n- two": "markdown list",
    "| a | b |": "markdown table", "== T ==": "wiki heading", "'''b'''": "wiki emphasis", "[[A|b]]": "wiki link", "{{cite|1}}": "wiki template", "{| class=\"x\"\n|-\n|}": "wiki table", "\\textbf{x}": "tex command", "a & b \\\\ \\hline": "tex command",
    "12\\% paid": "tex escape", "$$ x $$": "tex math", "so $\\frac{1}{2}$": "tex command",
}


@pytest.mark.parametrize("text", CLEAN)
def test_plain_texts_hold_no_markup(text, spark):
    assert markup.constructs(text) == []
    assert markup.clean(text)[0] == text


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_removed(text):
    assert MARKED[text] in markup.constructs(text)
    assert markup.constructs(markup.clean(text)[0]) == [] or "code" in MARKED[text]


def test_structure_is_kept():
    text = "# Sales\n\nThe **sales** rose because of the weather and the price, as it was said in the report of the year.\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\nx = y*z\n```\n\n$$ g = \\frac{a}{b} - 1 $$\n"
    cleaned, main, blocks, found = markup.clean(text)
    assert [b.kind for b in blocks] == ["heading", "text", "item", "item", "table", "code", "formula"]
    assert cleaned.split("\n\n") == ["Sales", "The sales rose because of the weather and the price, as it was said in the report of the year.", "• one\n• two", "a\tb\n1\t2", "    x = y*z", "g = (a) / (b) - 1"]
    assert markup.clean(None) == (None, None, [], []) and markup.clean("")[0] == ""


def test_links_are_boilerplate_and_short_blocks_follow_their_neighbours():
    text = "<div><a href='x'>Home</a> <a href='y'>About us and more</a></div><p>Skip this</p>" + "<p>" + "The company said that it was in the market for the whole of the year, and that the price had been set by the board. " * 3 + "</p><p>So it was.</p>"
    labels = [(b.text[:9], b.label) for b in markup.clean(text)[2]]
    assert labels == [("Home Abou", "boilerplate"), ("Skip this", "boilerplate"), ("The compa", "content"), ("So it was", "content")] or labels[0][1] == "boilerplate" and labels[-1][1] == "content"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*MARKED, *CLEAN, "<b>", "**", "[[", "]]", "{{", "`", "$", "\\", "<", "&", "\n", "|", "==", "__", "word"]), max_size=12))
def test_cleaning_never_fails_and_keeps_plain_words(parts):
    cleaned, _, _, found = markup.clean(" ".join([*parts, "lastword"]))
    assert cleaned is not None and ("lastword" in cleaned or found)


def test_markup_rows(spark):
    rows = [("a", "<b>x</b>", "2024-01-01"), ("a", "x", "2024-01-02"), ("b", "**x**", None), (None, "<i>", None), (None, "<i>", None), ("c", None, None), ("d", "", None)]
    df = spark.createDataFrame(rows, "id string, body string, received_at string").withColumn("text", F.lit("other"))
    named = markup.markup_rows(df, table_name="t", row_key="id", text="body")
    assert sorted(str(r.row_key) for r in markup.clean_markup(named).where("size(constructs) > 0").collect()) == ["None", "None", "b"]
    cleaned = {(r.row_key, r.clean_text) for r in markup.clean_markup(named).collect()}
    assert cleaned == {("a", "x"), ("b", "x"), (None, ""), ("c", None), ("d", "")}
    assert markup.clean_markup(named).count() == 6 and markup.clean_markup(named.limit(0)).count() == 0


def test_entities_without_semicolon():
    for text in ("&copy 2019 the firm", "5 &times 3", "caf&eacute bar"):
        assert markup.constructs(text) == ["entity"]
    for text in ("R&D and AT&T", "profit&loss", "Smith & Sons", "S&P 500"):
        assert markup.constructs(text) == []


def test_found_rows_are_those_of_the_cleaning(spark, small):
    found = queries.p6_found(spark, small)
    assert "_arrow(" in found._jdf.queryExecution().optimizedPlan().toString()
    cleaned = queries.p6_clean(spark, small).where(F.size("constructs") > 0).collect()
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.table_name, r.row_key) for r in cleaned)
    assert cleaned and all(r.blocks is not None and r.clean_text is not None for r in cleaned)
