"""Markdown pages cut into units of bounded size that keep their headings and lineage.

One pattern scans a page into blocks (fenced code, HTML table, pipe table, heading, paragraph).
Blocks carry the path of headings above them; blocks too large for a unit are cut between table
rows, sentences or words; blocks are then packed greedily up to a target, and each unit may begin
with the end of the prose before it. Token counts are additive over white space, so a block is
counted once and everything else is arithmetic on the counts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Counter = Callable[[str], int]
#: What a token and the end of a sentence are.
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SEPARATOR = r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*"
_BLOCK = re.compile(
    rf"""
    ^[ \t]*(?P<mark>```|~~~)[^\n]*(?:\n(?![ \t]*(?P=mark))[^\n]*)*(?:\n[ \t]*(?P=mark)[^\n]*)?   # to the closing fence or the end
    | ^(?P<html>[ \t]*<table[\s>](?:[^\n]*\n)*?[^\n]*(?:</table>[ \t]*$|\Z))
    | ^(?P<pipe>[^\n]*\|[^\n]*\n{_SEPARATOR}(?:\n(?=[^\n]*\S)[^\n]*\|[^\n]*)*)(?=\n|\Z)
    | ^[ ]{{0,3}}(?P<level>\#{{1,6}})[ \t]+\S[^\n]*$
    | ^(?P<line>[^\n]*\S[^\n]*)$
    """,
    re.MULTILINE | re.VERBOSE | re.IGNORECASE,
)
#: Fixed value, as above.
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def regex_count(text: str) -> int:
    return len(_TOKEN.findall(text))


@dataclass(frozen=True)
class Limits:
    target: int = 300
    most: int = 450
    overlap: int = 50

    def __post_init__(self) -> None:
        if not 0 < self.target <= self.most or not 0 <= self.overlap < self.target:
            raise ValueError("limits must hold 0 < target <= most and 0 <= overlap < target")


@dataclass(frozen=True)
class Block:
    kind: str  # code, html, pipe, heading, prose, titles
    text: str
    ids: tuple[str, ...] = ()
    level: int = 0
    section: str = ""
    section_ids: tuple[str, ...] = ()
    cost: int = 0
    section_cost: int = 0


def normalized(markdown: str) -> str:
    return "\n".join(line.rstrip() for line in markdown.splitlines()).strip()


def blocks_of(markdown: str) -> list[Block]:
    """Blocks of a normalized page, in order."""
    blocks: list[Block] = []
    paragraph: list[str] = []
    end = 0

    def close() -> None:
        if paragraph:
            blocks.append(Block("prose", "\n".join(paragraph).strip()))
            paragraph.clear()

    for m in _BLOCK.finditer(markdown):
        if "\n" in markdown[end : m.start()].replace("\n", "", 1):
            close()
        end = m.end()
        if m["line"] is not None:
            paragraph.append(m["line"])
            continue
        close()
        kind = "code" if m["mark"] else "html" if m["html"] is not None else "pipe" if m["pipe"] is not None else "heading"
        blocks.append(Block(kind, m.group().strip(), level=len(m["level"] or "")))
    close()
    return [b for b in blocks if b.text]


def with_lineage(blocks: Sequence[Block], document_id: str, page: int, given: Sequence[str] | None) -> list[Block]:
    """Blocks with an id each, given or derived from document, page, position and text."""
    if given and len(given) != len(blocks):
        raise ValueError("a page needs as many source ids as it has blocks")
    ids = list(given or ["element:" + hashlib.sha256("\0".join((document_id, str(page), str(i), b.text)).encode()).hexdigest()[:24] for i, b in enumerate(blocks)])
    if any(not x.strip() for x in ids) or len(set(ids)) != len(ids):
        raise ValueError("source ids must be distinct and not blank")
    return [replace(b, ids=(x,)) for b, x in zip(blocks, ids)]


def under_headings(blocks: Sequence[Block]) -> list[Block]:
    """Blocks with the path of headings above them; headings that nothing follows become one block."""
    out: list[Block] = []
    path: list[Block] = []
    lonely = False
    for b in blocks:
        if b.kind == "heading":
            path = [h for h in path if h.level < b.level] + [b]
            lonely = True
        else:
            out.append(replace(b, section="\n\n".join(h.text for h in path), section_ids=tuple(x for h in path for x in h.ids)))
            lonely = False
    if lonely:
        out.append(Block("titles", "\n\n".join(h.text for h in path), tuple(x for h in path for x in h.ids)))
    return out


def filled(costs: Sequence[int], room: int) -> list[tuple[int, int]]:
    """Runs of neighbours, each as long as its costs fit the room; one that doesn't fit runs alone."""
    runs, start, used = [], 0, 0
    for i, cost in enumerate(costs):
        if i > start and used + cost > room:
            runs.append((start, i))
            start, used = i, 0
        used += cost
    if start < len(costs):
        runs.append((start, len(costs)))
    return runs


def _wrapped(text: str, room: int, count: Counter) -> list[str]:
    """Text cut at the last white space before the room is used up, else between tokens."""
    if room < 1:
        raise ValueError("the headings leave no room for text")
    parts, rest = [], text.strip()
    while count(rest) > room:
        low, high = 1, len(rest)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(rest[:middle]) <= room else (low, middle - 1)
        space = max((i for i in range(min(low, len(rest) - 1), 0, -1) if rest[i].isspace()), default=0)
        at = space or low
        parts.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in (*parts, rest) if p]


def _prose(text: str, room: int, count: Counter) -> list[str]:
    sentences = [s.strip() for s in _SENTENCE_END.split(text) if s.strip()]
    if len(sentences) < 2:
        return _wrapped(text, room, count)
    costs = [count(s) for s in sentences]
    out = []
    for a, b in filled(costs, room):
        out += [" ".join(sentences[a:b])] if sum(costs[a:b]) <= room else _wrapped(sentences[a], room, count)
    return out


def _rows(lead: str, head: str, rows: list[str], tail: str, room: int, count: Counter) -> list[str]:
    """Tables of the given rows, each with the head again, and the first with the lead."""
    room -= count("\n".join((lead, head, tail)))
    costs = [count(r) for r in rows]
    if not rows or max(costs) > room:
        raise ValueError("a table row doesn't fit a unit")
    return ["\n".join(x for x in (head, *rows[a:b], tail) if x) for a, b in filled(costs, room)]


def fitting(b: Block, most: int, count: Counter) -> list[Block]:
    """The block, or parts of it that fit a unit together with their headings."""
    section_cost = count(b.section)
    if count(b.text) + section_cost <= most:
        return [replace(b, cost=count(b.text), section_cost=section_cost)]
    room = most - section_cost
    if b.kind == "pipe":
        lines = b.text.split("\n")
        texts = _rows("", "\n".join(lines[:2]), lines[2:], "", room, count)
    elif b.kind == "html":
        body = re.search(r"(<tbody\b[^>]*>)(.*?)</tbody>", b.text, re.IGNORECASE | re.DOTALL)
        if not body:
            raise ValueError("an HTML table too large for a unit needs a body")
        opened = re.search(r"<table\b[^>]*>", b.text, re.IGNORECASE)
        head = re.search(r"<thead\b[^>]*>.*?</thead>", b.text, re.IGNORECASE | re.DOTALL)
        rows = [r.strip() for r in re.findall(r"<tr\b[^>]*>.*?</tr>", body[2], re.IGNORECASE | re.DOTALL)]
        top = "\n".join(x for x in (opened.group(), head.group().strip() if head else "", body[1]) if x)
        texts = _rows("", top, rows, "</tbody>\n</table>", room, count)
    else:
        texts = _prose(b.text, room, count)
    return [replace(b, text=t, cost=count(t), section_cost=section_cost) for t in texts]


def _cost(pack: Sequence[Block]) -> int:
    """Tokens of a pack, each run of one section under its headings once."""
    return sum(b.cost + (b.section_cost if i == 0 or pack[i - 1].section_ids != b.section_ids else 0) for i, b in enumerate(pack))


def packed(blocks: Sequence[Block], target: int) -> list[list[Block]]:
    packs: list[list[Block]] = []
    used = 0
    for b in blocks:
        joins = bool(packs) and packs[-1][-1].section_ids == b.section_ids
        cost = b.cost + (0 if joins else b.section_cost)
        if packs and used + cost <= target:
            packs[-1].append(b)
            used += cost
        else:
            packs.append([b])
            used = b.cost + b.section_cost
    return packs


def shared_end(before: Sequence[Block], pack: Sequence[Block], limits: Limits, count: Counter) -> list[Block]:
    """The longest end of the pack before that may begin this one: prose of the same section."""
    first = pack[0]
    room = min(limits.overlap, limits.most - _cost(pack))
    taken: list[Block] = []
    if first.kind != "prose":
        return taken
    for b in reversed(before):
        if b.kind != "prose" or b.section_ids != first.section_ids or room < 1:
            break
        if b.cost <= room:
            taken.insert(0, b)
            room -= b.cost
            continue
        text = b.text.strip()
        # starts behind white space come first, from the left; then those between tokens
        starts = [m.end() for m in re.finditer(r"\s+", text) if m.end() < len(text)]
        tokens = [m.start() for m in _TOKEN.finditer(text)] if count is regex_count else []
        left = [len(tokens) - bisect_left(tokens, s) for s in starts] if tokens else [count(text[s:]) for s in starts]
        at = next((s for s, n in zip(starts, left) if n <= room), None)
        if at is None:
            at = next((s for s in range(1, len(text)) if text[s:].strip() and count(text[s:]) <= room), None)
        if at is not None:
            taken.insert(0, replace(b, text=text[at:].strip(), cost=count(text[at:])))
        break
    return taken


def rendered(pack: Sequence[Block]) -> str:
    parts: list[str] = []
    for i, b in enumerate(pack):
        if b.section and (i == 0 or pack[i - 1].section_ids != b.section_ids):
            parts.append(b.section)
        parts.append(b.text)
    return "\n\n".join(parts).strip()


def chunk_page(document_id: str, page: int, markdown: str | None, given: Sequence[str] | None = None, limits: Limits = Limits(), count: Counter = regex_count) -> list[tuple[str, list[str], int, int]]:
    """(text, source ids, tokens, blocks) of the units of one page; none for a blank page."""
    text = normalized(markdown or "")
    if not text:
        if given is not None and len(given):
            raise ValueError("a blank page has no source ids")
        return []
    blocks = under_headings(with_lineage(blocks_of(text), document_id, page, given))
    packs = packed([part for b in blocks for part in fitting(b, limits.most, count)], limits.target)
    out = []
    for i, pack in enumerate(packs):
        whole = (shared_end(packs[i - 1], pack, limits, count) if i and limits.overlap else []) + pack
        ids = list(dict.fromkeys(x for b in whole for x in (*b.section_ids, *b.ids)))
        unit = rendered(whole)
        out.append((unit, ids, count(unit), len(whole)))
    return out


def markdown_units(pages: DataFrame, limits: Limits = Limits(), count: Counter = regex_count) -> DataFrame:
    """Units of pages (document_id, page_number, markdown, source_element_ids), in the units' schema.

    Pages are cut one by one in Python; the units are then numbered over the whole document.
    """
    def cut_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [
                (d, p, i, text, ids, n, blocks)
                for d, p, md, given in zip(pdf["document_id"], pdf["page_number"], pdf["markdown"], pdf["source_element_ids"])
                for i, (text, ids, n, blocks) in enumerate(chunk_page(d, int(p), md, list(given) if given is not None else None, limits, count))
            ]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "position", "text", "source_element_ids", "token_count", "block_count"])

    from pyspark.sql import Window

    from lodestrata.functions.ids import nul_digest

    source = pages.select("document_id", "page_number", "markdown", "source_element_ids")
    cut = source.mapInPandas(cut_pages, "document_id string, page_number int, position int, text string, source_element_ids array<string>, token_count int, block_count int")
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "position")) - 1
    numbered = cut.withColumn("chunk_index", index)
    return numbered.select(
        F.concat(F.lit("chunk:"), nul_digest(F.col("document_id"), F.col("page_number"), F.col("chunk_index"), F.col("text"))).alias("chunk_id"),
        "document_id", "chunk_index", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "source_element_ids", "text",
        F.length("text").alias("char_count"), "token_count", "block_count", F.lit("chunk").alias("retrieval_unit_kind"),
    )
