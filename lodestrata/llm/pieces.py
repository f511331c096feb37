"""Splitting oversized texts at natural boundaries (problem 3), by structure-tree packing.

A text is a tree of spans: sections under headings, blocks between blank lines, list items, table
rows and markup blocks, sentences, clauses, tokens. Siblings are merged, left to right, as long as
they fit; only a node that doesn't fit is opened. Opening is lazy, so the cost of a text is that of
its tokens and of the few nodes on the way.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestrata.llm.deliveries import latest_delivery
from lodestrata.llm.tokens import TOKEN, token_count

_HEADING = re.compile(
    r"^(?:(?P<atx>\#{1,6})[ \t]+\S.*|(?P<wiki>={1,6})[ \t]*[^=\n].*?={1,6}[ \t]*|\\(?P<tex>(?:sub){0,2}section|chapter|paragraph)\*?\{.*|<h(?P<html>[1-6])\b.*|(?P<setext>\S.*)\n(?P<rule>={3,}|-{3,})[ \t]*)$",
    re.MULTILINE | re.IGNORECASE,
)
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[ \t]*$|\Z)", re.MULTILINE | re.DOTALL)
#: Ways to open a node, from coarse to fine, as patterns whose matches end a child.
_BLOCKS = re.compile(r"\n[ \t]*\n\s*|(?<=</table>)|(?<=</ul>)|(?<=</ol>)|(?<=</p>)|(?<=</div>)", re.IGNORECASE)
_ROWS = re.compile(r"\n+|(?<=</li>)|(?<=</tr>)|<br\s*/?>", re.IGNORECASE)
_SENTENCES = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+")
_CLAUSES = re.compile(r"(?<=[,;:])\s+")
_WORDS = re.compile(r"\s+")
_MARKS = re.compile(r"(?<=[,;|/])")
#: Most rows of settings that are read to the driver.
MOST_PROFILES = 1_000
_LEVELS = ("section", "block", "row", "sentence", "clause", "word", "mark", "token")
_PATTERNS = {"block": _BLOCKS, "row": _ROWS, "sentence": _SENTENCES, "clause": _CLAUSES, "word": _WORDS, "mark": _MARKS}
_TEX_LEVEL = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


@dataclass(frozen=True)
class Piece:
    """Characters [start, end) and tokens [first, last) of the text; shared of the tokens also end the piece before."""

    start: int
    end: int
    first: int
    last: int
    shared: int
    boundary: str


class _Text:
    def __init__(self, text: str) -> None:
        self.text = text
        spans = [m.span() for m in TOKEN.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.ends = [b for _, b in spans]
        fences = [m.span() for m in _FENCE.finditer(text)]
        self.fenced = lambda at: any(a <= at < b for a, b in fences)
        self.headings = [(m.start(), self._level(m)) for m in _HEADING.finditer(text) if not self.fenced(m.start())]

    @staticmethod
    def _level(m: re.Match) -> int:
        if m["atx"]:
            return len(m["atx"])
        if m["wiki"]:
            return len(m["wiki"])
        if m["tex"]:
            return _TEX_LEVEL[m["tex"].lower()]
        if m["html"]:
            return int(m["html"])
        return 1 if m["rule"][0] == "=" else 2

    def count(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_left(self.starts, a)

    def children(self, a: int, b: int, level: int) -> tuple[list[int], int]:
        """Offsets that cut [a, b) at the first level from the given one that cuts it, and that level."""
        while level < len(_LEVELS) - 1:
            name = _LEVELS[level]
            if name == "section":
                inside = [(at, n) for at, n in self.headings if a < at < b]
                # the outermost headings cut; what they enclose stays whole for now
                own = min((n for at, n in self.headings if a <= at < b), default=None)
                cuts = [at for at, n in inside if n == own] or [at for at, n in inside if n == min(x for _, x in inside)]
                if cuts:
                    return cuts, level
            else:
                pattern = _PATTERNS[name]
                cuts = sorted({m.end() for m in pattern.finditer(self.text, a, b) if a < m.end() < b and not (name == "block" and self.fenced(m.end()))})
                if cuts:
                    return cuts, level
            level += 1
        return [], level


def _packed(t: _Text, a: int, b: int, level: int, limit: int) -> list[tuple[int, int, str]]:
    """Spans that cover [a, b), each of at most limit tokens, with the level that cut them off."""
    if t.count(a, b) <= limit:
        return [(a, b, "whole")]
    cuts, level = t.children(a, b, level)
    if not cuts:
        lo, hi = bisect_left(t.starts, a), bisect_left(t.starts, b)
        at = [a, *(t.starts[i] for i in range(lo + limit, hi, limit)), b]
        return [(x, y, "token") for x, y in zip(at, at[1:])]
    name, bounds = _LEVELS[level], [a, *cuts, b]
    merged: list[tuple[int, int, str]] = []
    for x, y in zip(bounds, bounds[1:]):
        # a section is opened again from the section level, for the headings inside it
        for span in _packed(t, x, y, level if name == "section" else level + 1, limit):
            kind = name if span[2] == "whole" else span[2]
            if merged and t.count(merged[-1][0], span[1]) <= limit:
                merged[-1] = (merged[-1][0], span[1], merged[-1][2])
            else:
                merged.append((span[0], span[1], kind))
    return merged


def split_text(text: str | None, max_tokens: int, overlap_tokens: int = 0) -> list[Piece]:
    """Pieces of at most max_tokens that cover every token of the text.

    Each piece but the first begins with the overlap_tokens tokens that end the piece before; the
    overlap must be smaller than the limit. A null or blank text gives none, a text within the
    limit one.
    """
    if max_tokens < 1 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("max_tokens must be positive and overlap_tokens from 0 to below it")
    t = _Text(text or "")
    if not t.starts:
        return []
    spans = _packed(t, 0, len(t.text), 0, max_tokens if len(t.starts) <= max_tokens else max_tokens - overlap_tokens)
    spans = [s for s in spans if t.count(s[0], s[1])]
    # the first piece carries no overlap, so it has room for more, and for what is too short to be shared
    while len(spans) > 1 and (t.count(spans[0][0], spans[1][1]) <= max_tokens or t.count(*spans[0][:2]) < overlap_tokens):
        spans[:2] = [(spans[0][0], spans[1][1], spans[0][2])]
    pieces = []
    for i, (a, b, kind) in enumerate(spans):
        first, last = bisect_left(t.starts, a), bisect_left(t.starts, b)
        shared = overlap_tokens if i else 0
        pieces.append(Piece(t.starts[first - shared], t.ends[last - 1], first - shared, last, shared, kind if i else "start"))
    return pieces


PIECES = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("piece_index", T.IntegerType()),
    T.StructField("n_pieces", T.IntegerType()),
    T.StructField("char_start", T.LongType()),
    T.StructField("char_end", T.LongType()),
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("shared_tokens", T.IntegerType()),
    T.StructField("boundary", T.StringType()),
    T.StructField("text", T.StringType()),
])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk_id", pa.string()), ("piece_index", pa.int32()), ("n_pieces", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int32()), ("shared_tokens", pa.int32()), ("boundary", pa.string()), ("text", pa.string())])
    for batch in batches:
        rows = []
        for chunk_id, text, limit, overlap in zip(*(batch.column(i) for i in range(4))):
            text = text.as_py()
            pieces = split_text(text, limit.as_py(), overlap.as_py())
            for i, p in enumerate(pieces):
                rows.append((chunk_id.as_py(), i, len(pieces), p.start, p.end, p.last - p.first, p.shared, p.boundary, text[p.start : p.end]))
            if sum(len(r[-1]) for r in rows[-len(pieces) :]) > 1_000_000 or len(rows) > 2_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def split_oversized(units: DataFrame, profiles: DataFrame, default_profile: str = "standard") -> DataFrame:
    """Pieces of the units whose text has more tokens than max_tokens of their profile.

    units: (chunk_id, text, profile, received_at), profiles: (profile, max_tokens, overlap_tokens),
    a table of settings of at most MOST_PROFILES names. A null or unknown profile means the default one. Deliveries of one chunk_id
    count once, units without chunk_id each on their own; texts that fit, null and empty ones give
    no rows. Texts that fit are dropped inside the JVM, before any shuffle or Python.
    """
    limits = {r.profile: (r.most, r.shared) for r in profiles.groupBy("profile").agg(F.max("max_tokens").alias("most"), F.max("overlap_tokens").alias("shared")).limit(MOST_PROFILES + 1).collect()}
    if len(limits) > MOST_PROFILES or default_profile not in limits:
        raise ValueError(f"profiles must hold {default_profile!r} and at most {MOST_PROFILES} names")

    for name, (most, shared) in limits.items():
        if not most or most < 1 or not 0 <= (shared or 0) < most:
            raise ValueError(f"profile {name!r} needs a positive max_tokens and an overlap_tokens below it")

    def setting(i: int) -> Column:
        known = F.create_map(*[F.lit(x) for name, values in limits.items() if name is not None for x in (name, values[i] or 0)])
        return F.coalesce(F.try_element_at(known, F.col("profile")), F.lit(limits[default_profile][i]))

    limited = units.select("chunk_id", "text", "received_at", setting(0).alias("limit"), setting(1).alias("overlap"))
    # a text of n characters has at most n tokens, which spares counting in most
    oversized = limited.where((F.length("text") > F.col("limit")) & (token_count(F.col("text")) > F.col("limit")))
    once = latest_delivery(oversized, "chunk_id", ["text", "limit", "overlap"])
    return once.select("chunk_id", "text", F.col("limit").cast("int"), F.col("overlap").cast("int")).mapInArrow(_cut, PIECES)
