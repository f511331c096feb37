"""Text functions of retrieval and linking, as SQL expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words are letters and digits, joined by single dots and commas; currency and percent signs are
#: words of their own. Loose dots and commas are blanked first: a pattern that repeats a group would
#: recurse in Java, once per group, and long lists of numbers would exhaust the stack.
_LOOSE = r"[.,](?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[.,]"
_WORD = r"[\p{L}\p{N}.,]+|[$€£¥%]"
#: Words that a query leaves out.
QUERY_STOP_WORDS = "a an and are as at be by did do does for from how in is it much of on the to was were what when which who with".split()


def folded(text: Column) -> Column:
    """Lower case with the one fold of many letters that the corpus has."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(folded(text), _LOOSE, " "), F.lit(_WORD), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Distinct tokens without stop words, in order; all tokens where only stop words remain."""
    tokens = F.array_distinct(lexical_tokens(text))
    kept = F.filter(tokens, lambda t: ~t.isin(*QUERY_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def token_count(text: Column) -> Column:
    """Runs of word characters, or single other signs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}]")), F.lit(0))


#: What evidence is compared by. Numbers keep their sign, currency, decimals and percent.
_EVIDENCE_BREAK = r"[^a-z0-9%.$-]+"
_EVIDENCE_TOKEN = r"-?\$?\d+(?:\.\d+)?%?|[a-z]+"
_ROW_BREAK = r"[^\p{L}\p{N}_%.$-]+"


def evidence_text(text: Column) -> Column:
    """Lower ASCII words and whole numbers without thousands commas, one space apart."""
    s = F.regexp_replace(folded(text), r"(?<=[0-9]),(?=[0-9])", "")
    return F.trim(F.regexp_replace(s, _EVIDENCE_BREAK, " "))


def evidence_tokens(evidence: Column) -> Column:
    """Distinct words and numbers of an evidence_text()."""
    return F.array_distinct(F.regexp_extract_all(evidence, F.lit(_EVIDENCE_TOKEN), F.lit(0)))


def row_text(text: Column) -> Column:
    """Lower words, numbers and signs without the separators of table cells, one space apart."""
    return F.trim(F.regexp_replace(folded(text), _ROW_BREAK, " "))


def link_text(value: Column) -> Column:
    """Lower case, one space apart."""
    return F.trim(F.regexp_replace(folded(value), r"\s+", " "))


def trimmed_lines(text: Column) -> Column:
    """Line ends as \\n, white space cut from line ends and from both ends."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t\f\x0B]+$", ""), r"^\s+|\s+$", "")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))
