"""What figure a question asks for: kind, measure, entity and years, however it is worded."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from lodestrata.functions.quantities import one_slip
from lodestrata.llm.names import LEGAL_FORMS

#: Measures of financial reports; others are taken from the words that remain.
MEASURES = (
    "net sales|net income|operating income|cost of services|gross margin|total assets|long-term debt|goodwill|inventories|trade receivables|deferred revenue|interest expense|"
    "capital expenditures|research spending|stock compensation|restructuring charges|lease obligations|pension contributions|dividends paid|cash from operations|warranty reserves|"
    "effective tax rate|dividend yield|discount rate|borrowing rate|return on equity|renewal rate|occupancy|diluted share count|shares repurchased|options outstanding|restricted units granted|"
    "leased floor space|owned office space|warehouse area|steel shipments|coal output|freight carried|crude output|refinery throughput|power generated|plant consumption|electricity sold"
).split("|")
#: Words of which questions are built, by what they say about the kind.
PERCENT = "percent percentage pct".split()
CHANGE = "change changes changed difference differ move moved moves grow grew growth increase increased decrease decreased rise rose fall fell delta".split()
AVERAGE = "average averaged averages mean".split()
SUM = "sum total combined together add adds added altogether".split()
FRAME = (
    "above based below context data described document excerpt following information looking page passage provided section table text using see "
    "a according across all also an and annual are as asked at based be been between both by calculate can combined compute computed considering could did do does during each express expressed fiscal filing find for from fy "
    "give given had has have how in is it its large let me much need note notes of on or out over per please published q question report reported reporting reports show shown state stated tell that the their there this through to told "
    "two up us value values was we were what whats when which who will with within would year years you your figure figures amount company firm group ended ending"
).split()
#: Words of unit expressions at a question's end.
UNIT_WORDS = "us usd eur gbp dollar dollars euro euros pound pounds sterling million millions thousand thousands billion billions mm mn bn k s percent pct cent basis point points bp bps ratio fraction decimal shares share shs acre acres sq ft ft2 m2 m square feet foot metres meters metre meter kwh mwh gwh kilowatt megawatt gigawatt hour hours kilowatt-hour kilowatt-hours megawatt-hour megawatt-hours gigawatt-hour gigawatt-hours kg kilograms kilogram lb lbs t tonnes tonne metric short ton tons bbl barrel barrels".split()

_KNOWN_MEASURES = "(?<![a-z])(?:" + "|".join(re.escape(m) for m in sorted(MEASURES, key=lambda m: (-len(m), m))) + ")(?![a-z])"
_KNOWN = sorted({w for w in [*PERCENT, *CHANGE, *AVERAGE, *SUM, *FRAME] if len(w) >= 3})
_MEASURE_WORDS = sorted({w for m in MEASURES for w in re.findall(r"[a-z]+", m)})


@lru_cache(maxsize=100_000)
def respelled(word: str) -> str:
    """The known word that a word slipped from; itself if it is known or none is near."""
    if word in _KNOWN or word in _MEASURE_WORDS or len(word) < 3:
        return word
    for vocabulary in (_MEASURE_WORDS, _KNOWN):
        near = [k for k in vocabulary if len(k) >= 3 and one_slip(word, k) and (len(word) >= 5 or sorted(word) == sorted(k) or len(k) >= 5)]
        if near:
            same = [k for k in near if sorted(k) == sorted(word)]
            return (same or near)[0]
    return word


_YEAR = re.compile(r"\b(?:fy|fiscal year|fiscal|calendar|years? ended)?[ ']*(?P<long>(?:19|20)\d{2})(?:-\d{2}-\d{2})?\b|\bfy[ ']*(?P<short>\d{2})\b")


def _years(s: str) -> tuple[list[int], str]:
    """The years of a text, two-digit ones of the years since 2000, and the text without them."""
    found = {int(m["long"] or 2000 + int(m["short"])) for m in _YEAR.finditer(s)}
    return sorted(found), _YEAR.sub(" ", s)


#: Words after which a firm may be named, the surest first.
_LEADS = ("did", "at", "by", "of", "for")


def _entity(words: list[str], content: set[str]) -> tuple[int, int]:
    """Where the firm is named, from and to: by its genitive, by a leading "for", else behind the surest of _LEADS, the last one of its kind.

    A name runs on over legal forms, also behind a comma, to the next word of the question's frame.
    """
    def run(i: int) -> int:
        while i < len(words) and (words[i] in content or words[i] in LEGAL_FORMS or (words[i] == "," and i + 1 < len(words) and words[i + 1] in LEGAL_FORMS)):
            i += 1
        return i

    for i, w in enumerate(words):
        if w == GENITIVE and i and words[i - 1] in content:
            start = i
            while start and (words[start - 1] in content or words[start - 1] in LEGAL_FORMS):
                start -= 1
            return start, i
    named = [(i + 1, run(i + 1)) for i, w in enumerate(words) if w in _LEADS and i + 1 < len(words) and words[i + 1] in content]
    leading = [n for n in named if words[n[0] - 1] == "for" and n[1] < len(words) and words[n[1]] == "," and not content.intersection(words[: n[0]]) and "|" not in words[: n[0]]]
    if leading:
        return leading[0]
    for lead in _LEADS:
        of_kind = [n for n in named if words[n[0] - 1] == lead]
        if of_kind:
            return of_kind[-1]
    return 0, 0


GENITIVE = "'s"


def figure(text: str | None) -> tuple[str, str] | None:
    """(kind|measure|years, entity) of a question; None for a text that asks for no figure of a year.

    The entity is the whole name without legal forms. Measures that no list knows are what the
    question holds beside its frame, in order.
    """
    if not text or not text.strip():
        return None
    s = unicodedata.normalize("NFKC", text).casefold()
    s = re.sub("[\u00ad\u200b-\u200f\ufeff]", "", s)
    years, s = _years(s)
    if not years:
        return None
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", s)
    s = re.sub(r"(?<=\w)['\u2019]s\b", f" {GENITIVE} ", s)
    raw = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*|,|:|'s", s)
    joined = " ".join(respelled(w) if w not in (",", ":", GENITIVE) else w for w in raw)
    measures = re.findall(_KNOWN_MEASURES, joined)
    joined = re.sub(_KNOWN_MEASURES, "|", joined)
    # a unit told behind a comma, "in ..." or "expressed in ...", says nothing about the figure
    units = "|".join(UNIT_WORDS)
    joined = re.sub(rf",\s*(?:expressed |stated |measured )?(?:in )?(?:(?:{units}|of|per)(?:\s+|$))+$", " ", joined.strip() + " ").strip()
    words = joined.split()
    has = lambda group: any(w in group for w in words)
    adds = has(SUM) if "add" not in words else True
    if has(PERCENT) and has(CHANGE):
        kind = "percent change"
    elif has(AVERAGE):
        kind = "average"
    elif has(CHANGE) and len(years) > 1:
        kind = "change"
    elif adds and len(years) > 1:
        kind = "sum"
    else:
        kind = "value" if len(years) == 1 else "values"
    frame = {*PERCENT, *CHANGE, *AVERAGE, *SUM, *FRAME, *LEGAL_FORMS, "|", ",", ":", GENITIVE}
    content = {w for w in words if w not in frame}
    start, end = _entity(words, content)
    if not end and measures:
        # beside a known measure only the firm is left
        entity, rest = [w for w in words if w in content], []
    else:
        entity = [w for w in words[start:end] if w in content]
        rest = [w for w in words[:start] + words[end:] if w in content]
    measure = " ".join([*measures, *rest])
    if not measure and not entity:
        return None
    return f"{kind}|{measure}|{','.join(map(str, years))}", " ".join(entity)
