"""Grammar of amounts: numbers, unit expressions, dimensions as exponent vectors.

    expression := term { ("/" | "per" | "*" | "·" | "x") term }
    term       := { currency | scale | prefix unit | unit [power] | connecting word }
    power      := ["^"] ["-"] digits | "²" | "³" | "squared" | "cubed", or "square", "cubic" before it

for example "thousands of US dollars", "USD (000s)", "sq. ft.", "[in GWh]", "USD/share", "kWh per m2",
"$ per barrel", "m s^-2". Products add exponent vectors, quotients subtract them and powers multiply
them; factors follow. An expression parses only if every word of it is known, so that ordinary words
beside a unit never give one. Within a term a repeated unit names it again ("$ ... USD") and two
different ones contradict each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Base dimensions of the exponent vectors.
BASES = ("usd", "kg", "m", "s", "kelvin", "share", "barrel")


def _vector(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(b, 0) for b in BASES)


MONEY, RATIO, AREA, ENERGY = _vector(usd=1), _vector(), _vector(m=2), _vector(kg=1, m=2, s=-2)
MASS, LENGTH, TIME, HEAT = _vector(kg=1), _vector(m=1), _vector(s=1), _vector(kelvin=1)
SHARES, BARRELS = _vector(share=1), _vector(barrel=1)
POWER, VOLUME = _vector(kg=1, m=2, s=-3), _vector(m=3)

#: Name and canonical unit of each kind of quantity. The factors below lead to these units, but
#: that of money, which is per unit of its own currency.
CANONICAL = {MONEY: "USD", RATIO: "fraction", AREA: "m2", ENERGY: "J", MASS: "kg", LENGTH: "m", TIME: "s", HEAT: "K", SHARES: "share", BARRELS: "barrel", POWER: "W", VOLUME: "m3"}


@dataclass(frozen=True)
class Unit:
    """A unit: exponents of the bases, factor and offset to the canonical unit, and the currency whose power the money in it is."""

    dimension: tuple[int, ...]
    factor: float
    offset: float = 0.0
    currency: str | None = None

    def power(self, n: int) -> Unit:
        return Unit(tuple(e * n for e in self.dimension), self.factor**n, 0.0 if n != 1 else self.offset, self.currency if n else None)

    def times(self, other: Unit) -> Unit | None:
        """The product; offsets are left out, since only differences of such units multiply. None for two currencies."""
        if self.currency and other.currency and self.currency != other.currency:
            return None
        return Unit(tuple(a + b for a, b in zip(self.dimension, other.dimension)), self.factor * other.factor, 0.0, self.currency or other.currency)

    @property
    def money(self) -> int:
        """Power of money in it."""
        return self.dimension[BASES.index("usd")]


def canonical_name(dimension: tuple[int, ...]) -> str:
    """Name of the common unit of a dimension: its own where it has one, else the product of its bases."""
    if dimension in CANONICAL:
        return CANONICAL[dimension]
    names = {"usd": "USD", "kelvin": "K"}
    part = lambda sign: "*".join(names.get(b, b) + (str(abs(e)) if abs(e) > 1 else "") for b, e in zip(BASES, dimension) if e * sign > 0)
    return (part(1) or "1") + ("/" + part(-1) if part(-1) else "")


def _money(code: str) -> Unit:
    return Unit(MONEY, 1.0, currency=code)


#: Unit names as written and their factors to the canonical unit.
UNITS = {
    "$": _money("USD"), "us$": _money("USD"), "usd": _money("USD"), "us dollars": _money("USD"), "us dollar": _money("USD"),
    "u.s. dollars": _money("USD"), "u.s. dollar": _money("USD"), "dollars": _money("USD"), "dollar": _money("USD"),
    "€": _money("EUR"), "eur": _money("EUR"), "euros": _money("EUR"), "euro": _money("EUR"),
    "£": _money("GBP"), "gbp": _money("GBP"), "pounds sterling": _money("GBP"), "pound sterling": _money("GBP"), "sterling": _money("GBP"),
    "%": Unit(RATIO, 0.01), "percent": Unit(RATIO, 0.01), "per cent": Unit(RATIO, 0.01), "pct": Unit(RATIO, 0.01), "percentage": Unit(RATIO, 0.01),
    "bp": Unit(RATIO, 0.0001), "bps": Unit(RATIO, 0.0001), "basis points": Unit(RATIO, 0.0001), "basis point": Unit(RATIO, 0.0001),
    "ratio": Unit(RATIO, 1.0), "fraction": Unit(RATIO, 1.0), "decimal": Unit(RATIO, 1.0),
    "shares": Unit(SHARES, 1.0), "share": Unit(SHARES, 1.0), "shs": Unit(SHARES, 1.0),
    "barrels": Unit(BARRELS, 1.0), "barrel": Unit(BARRELS, 1.0), "bbl": Unit(BARRELS, 1.0), "bbls": Unit(BARRELS, 1.0),
    "j": Unit(ENERGY, 1.0), "joules": Unit(ENERGY, 1.0), "gj": Unit(ENERGY, 1e9),
    "wh": Unit(ENERGY, 3600.0), "kwh": Unit(ENERGY, 3.6e6), "mwh": Unit(ENERGY, 3.6e9), "gwh": Unit(ENERGY, 3.6e12), "twh": Unit(ENERGY, 3.6e15),
    "watt hours": Unit(ENERGY, 3600.0), "watt hour": Unit(ENERGY, 3600.0), "kilowatt hours": Unit(ENERGY, 3.6e6), "kilowatt hour": Unit(ENERGY, 3.6e6),
    "megawatt hours": Unit(ENERGY, 3.6e9), "megawatt hour": Unit(ENERGY, 3.6e9), "gigawatt hours": Unit(ENERGY, 3.6e12), "gigawatt hour": Unit(ENERGY, 3.6e12),
    "terawatt hours": Unit(ENERGY, 3.6e15), "terawatt hour": Unit(ENERGY, 3.6e15),
    "m2": Unit(AREA, 1.0), "m²": Unit(AREA, 1.0), "sq m": Unit(AREA, 1.0), "sqm": Unit(AREA, 1.0), "square metres": Unit(AREA, 1.0), "square meters": Unit(AREA, 1.0),
    "square metre": Unit(AREA, 1.0), "square meter": Unit(AREA, 1.0), "ft2": Unit(AREA, 0.09290304), "ft²": Unit(AREA, 0.09290304), "sq ft": Unit(AREA, 0.09290304),
    "sqft": Unit(AREA, 0.09290304), "square feet": Unit(AREA, 0.09290304), "square foot": Unit(AREA, 0.09290304), "acres": Unit(AREA, 4046.8564224), "acre": Unit(AREA, 4046.8564224),
    "hectares": Unit(AREA, 10000.0), "hectare": Unit(AREA, 10000.0), "ha": Unit(AREA, 10000.0), "km2": Unit(AREA, 1e6), "square kilometres": Unit(AREA, 1e6), "square kilometers": Unit(AREA, 1e6),
    "kg": Unit(MASS, 1.0), "kgs": Unit(MASS, 1.0), "kilograms": Unit(MASS, 1.0), "kilogram": Unit(MASS, 1.0), "g": Unit(MASS, 0.001), "grams": Unit(MASS, 0.001),
    "lb": Unit(MASS, 0.45359237), "lbs": Unit(MASS, 0.45359237), "pounds": Unit(MASS, 0.45359237), "pound": Unit(MASS, 0.45359237),
    "t": Unit(MASS, 1000.0), "tonnes": Unit(MASS, 1000.0), "tonne": Unit(MASS, 1000.0), "metric tons": Unit(MASS, 1000.0), "metric ton": Unit(MASS, 1000.0), "metric tonnes": Unit(MASS, 1000.0),
    "short tons": Unit(MASS, 907.18474), "short ton": Unit(MASS, 907.18474), "long tons": Unit(MASS, 1016.0469088), "long ton": Unit(MASS, 1016.0469088),
    "cm": Unit(LENGTH, 0.01), "watts": Unit(POWER, 1.0), "kw": Unit(POWER, 1e3), "mw": Unit(POWER, 1e6), "gw": Unit(POWER, 1e9),
    "litres": Unit(VOLUME, 0.001), "liters": Unit(VOLUME, 0.001), "gallons": Unit(VOLUME, 0.003785411784),
    "metres": Unit(LENGTH, 1.0), "meters": Unit(LENGTH, 1.0), "km": Unit(LENGTH, 1000.0), "kilometres": Unit(LENGTH, 1000.0), "kilometers": Unit(LENGTH, 1000.0),
    "feet": Unit(LENGTH, 0.3048), "miles": Unit(LENGTH, 1609.344), "seconds": Unit(TIME, 1.0), "minutes": Unit(TIME, 60.0), "hours": Unit(TIME, 3600.0), "days": Unit(TIME, 86400.0),
    "°c": Unit(HEAT, 1.0, 273.15), "celsius": Unit(HEAT, 1.0, 273.15), "°f": Unit(HEAT, 5 / 9, 459.67 * 5 / 9), "fahrenheit": Unit(HEAT, 5 / 9, 459.67 * 5 / 9), "kelvin": Unit(HEAT, 1.0),
}
#: Scale words.
SCALES = {
    "hundreds": 1e2, "hundred": 1e2, "000s": 1e3, "000": 1e3, "k": 1e3, "thousands": 1e3, "thousand": 1e3,
    "mm": 1e6, "mn": 1e6, "mln": 1e6, "millions": 1e6, "million": 1e6,
    "bn": 1e9, "bln": 1e9, "billions": 1e9, "billion": 1e9, "tn": 1e12, "trillions": 1e12, "trillion": 1e12,
}
#: Words that join the parts of a unit expression.
CONNECTORS = ("in", "of", "expressed", "stated", "measured", "units", "unit", "as", "a", "an", "the")
#: A lone "m" or "b" scales money; elsewhere "m" is a length, of which nothing is told alone.
MONEY_SCALE = {"m": 1e6, "b": 1e9}
#: Words for powers, and what divides or multiplies.
BEFORE_POWER = {"square": 2, "sq": 2, "cubic": 3, "cu": 3}
BEHIND_POWER = {"squared": 2, "cubed": 3, "²": 2, "³": 3}
DIVIDES = ("/", "per")
MULTIPLIES = ("*", "·", "×")
#: Units whose names mean other things alone ("m" scales money), so they count only with a power or in a quotient or product.
COMPOUND_UNITS = {
    "m": Unit(LENGTH, 1.0), "metre": Unit(LENGTH, 1.0), "meter": Unit(LENGTH, 1.0), "kilometre": Unit(LENGTH, 1000.0), "kilometer": Unit(LENGTH, 1000.0),
    "ft": Unit(LENGTH, 0.3048), "foot": Unit(LENGTH, 0.3048), "mile": Unit(LENGTH, 1609.344), "s": Unit(TIME, 1.0), "second": Unit(TIME, 1.0), "minute": Unit(TIME, 60.0),
    "h": Unit(TIME, 3600.0), "hour": Unit(TIME, 3600.0), "day": Unit(TIME, 86400.0), "year": Unit(TIME, 31557600.0), "years": Unit(TIME, 31557600.0), "watt": Unit(POWER, 1.0),
    "litre": Unit(VOLUME, 0.001), "liter": Unit(VOLUME, 0.001), "gallon": Unit(VOLUME, 0.003785411784),
}
_ALL_UNITS = UNITS | COMPOUND_UNITS

_NAMES = sorted([*_ALL_UNITS, *SCALES, *CONNECTORS, *MONEY_SCALE, *BEFORE_POWER, *BEHIND_POWER, *DIVIDES, *MULTIPLIES], key=lambda x: (-len(x), x))
_TERM = re.compile(r"(?:" + "|".join(re.escape(x) for x in _NAMES if x[0].isalnum() or x[-1].isalnum()) + r")(?![\w²³])|" + "|".join(re.escape(x) for x in _NAMES if not (x[0].isalnum() or x[-1].isalnum())))
_POWER = re.compile(r"\s*\^\s*\(?(-?\d)\)?|(-?\d)(?![\w.,])")
_BARE_UNIT = re.compile(r"(?:" + "|".join(re.escape(x) for x in sorted(_ALL_UNITS, key=lambda x: (-len(x), x)) if x.isalpha()) + r")(?=[²³^]|-?\d(?![\w.,]))")
_LONG_WORDS = sorted({w for x in [*UNITS, *SCALES, "expressed", "square", "squared"] for w in x.split() if len(w) >= 5})
_NUMBER = re.compile(r"""
    (?P<open>\(\s*)? (?P<sign>[-+−–])? \s* (?P<cur>us\$|[$€£])? \s* (?P<open2>\(\s*)? (?P<sign2>[-+−])?
    (?P<num>(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[-+]?\d+)?|\.\d+)
    (?P<close>\s*\))?
""", re.VERBOSE | re.IGNORECASE)


@dataclass(frozen=True)
class Expression:
    """What a unit expression says; either part may be absent."""

    unit: Unit | None = None
    scale: float | None = None

    def filled_from(self, other: Expression) -> Expression:
        """Missing parts from another place of the same statement."""
        scale = self.scale
        if scale is None and (self.unit is None or other.unit is None or other.unit.dimension == self.unit.dimension):
            scale = other.scale
        return Expression(self.unit or other.unit, scale)


NOTHING = Expression()


def one_slip(word: str, known: str) -> bool:
    """Whether words are the same, or one letter is changed, missing, added or swapped with its neighbour."""
    if abs(len(word) - len(known)) > 1 or word == known:
        return word == known
    i = 0
    while i < min(len(word), len(known)) and word[i] == known[i]:
        i += 1
    a, b = word[i:], known[i:]
    return a[1:] == b or a == b[1:] or a[1:] == b[1:] or (len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and a[2:] == b[2:])


def _respelled(word: str) -> str:
    if len(word) < 5 or word in _LONG_WORDS:
        return word
    near = {x for x in _LONG_WORDS if one_slip(word, x)}
    # two that differ by the plural s only are the same word
    near = {x for x in near if not (x.endswith("s") and x[:-1] in near)} if len(near) > 1 else near
    return near.pop() if len(near) == 1 else word


def _tokens(s: str) -> list[tuple[str, int]] | None:
    """(word, power) of a unit expression, power 1 unless one is written behind a unit; None if a word is unknown."""
    out: list[tuple[str, int]] = []
    at = 0
    while at < len(s):
        if s[at] == " ":
            at += 1
            continue
        found = _TERM.match(s, at) or _BARE_UNIT.match(s, at)
        if not found:
            return None
        word, at = found.group(), found.end()
        power = 1
        if word in _ALL_UNITS and (behind := _POWER.match(s, at)):
            power, at = int(behind[1] or behind[2]), behind.end()
        out.append((word, power))
    return out


def _term(tokens: list[tuple[str, int]], compound: bool) -> Expression | None:
    """The unit and scale of one term; None if it contradicts itself."""
    unit: Unit | None = None
    scale: float | None = None
    loose: float | None = None
    ahead = 1
    for i, (word, power) in enumerate(tokens):
        if word in MONEY_SCALE and (not compound or (unit is not None and unit.dimension == MONEY)) and power == 1 and ahead == 1 and not (i + 1 < len(tokens) and tokens[i + 1][0] in BEHIND_POWER):
            loose = MONEY_SCALE[word]
        elif word in _ALL_UNITS:
            if word in COMPOUND_UNITS and not compound and power == 1 and ahead == 1 and not (i + 1 < len(tokens) and tokens[i + 1][0] in BEHIND_POWER):
                return None
            behind = BEHIND_POWER.get(tokens[i + 1][0], 1) if i + 1 < len(tokens) else 1
            said = _ALL_UNITS[word].power(power * ahead * behind) if power * ahead * behind != 1 else _ALL_UNITS[word]
            ahead = 1
            if unit is not None and unit != said:
                product = unit.times(said) if compound else None
                if product is None:
                    return None
                said = product
            unit = said
        elif word in SCALES:
            scale = SCALES[word] if scale is None or scale == SCALES[word] else scale * SCALES[word]
        elif word in BEFORE_POWER:
            ahead = BEFORE_POWER[word]
        elif word in BEHIND_POWER and (not i or tokens[i - 1][0] not in _ALL_UNITS):
            return None
    if ahead != 1:
        return None
    if loose is not None:
        if unit is None or unit.dimension != MONEY or scale is not None:
            return None
        scale = loose
    return Expression(unit, scale)


@lru_cache(maxsize=200_000)
def parse_unit(text: str | None) -> Expression | None:
    """The expression a text consists of; None if any word of it is unknown or it contradicts itself."""
    if not text or not text.strip():
        return NOTHING
    s = re.sub(r"[()\[\]{}_,;:]", " ", text.casefold().replace(" ", " "))
    s = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", s)
    s = re.sub(r"\b(sq|cu|ft|yd|no|pct|approx)\.", r"\1", s)
    s = re.sub(r"([$€£%])", r" \1 ", s)
    s = re.sub(r"\bus \$", "us$", s)
    s = re.sub(r"\bper cent\b", "percent", s)
    s = " ".join(_respelled(w) for w in s.split()).rstrip(".?! ")
    tokens = _tokens(s)
    if tokens is None:
        return None
    compound = any(w in DIVIDES or w in MULTIPLIES for w, _ in tokens)
    terms: list[tuple[int, list[tuple[str, int]]]] = [(1, [])]
    for word, power in tokens:
        if word in DIVIDES:
            terms.append((-1, []))
        elif word in MULTIPLIES:
            terms.append((1, []))
        else:
            terms[-1][1].append((word, power))
    if not compound:
        return _term(tokens, False)
    parts = [(sign, _term(held, True)) for sign, held in terms]
    if any(said is None for _, said in parts):
        return None
    if any(said.unit is None for _, said in parts):
        # a stroke that only separates ("USD / thousands", "/ USD") is no quotient
        return None if any(w != "/" and (w in DIVIDES or w in MULTIPLIES) for w, _ in tokens) else _term([x for _, held in terms for x in held], False)
    units = [said.unit.power(sign) if sign < 0 else said.unit for sign, said in parts]
    if len(set(said.unit for _, said in parts)) == 1 and all(sign < 0 for sign, _ in parts[1:]):
        return _term([x for _, held in terms for x in held], False)  # one unit named twice: "USD/$"
    whole_unit: Unit | None = units[0]
    for u in units[1:]:
        whole_unit = whole_unit.times(u) if whole_unit else None
    if whole_unit is None:
        return None
    scale: float | None = None
    for sign, said in parts:
        if said.scale is not None:
            scale = (scale or 1.0) * (said.scale if sign > 0 else 1 / said.scale)
    return Expression(whole_unit, scale)


def parse_number(text: str | None) -> tuple[float, str] | None:
    """The first number of a text, signed, and what the text says besides; None without a number."""
    found = _NUMBER.search(text or "")
    if not found:
        return None
    value = float(found["num"].replace(",", ""))
    opened = found["open"] or found["open2"]
    negative = bool(opened and found["close"]) or (found["sign"] or found["sign2"]) in ("-", "−", "–")
    before, after = text[: found.start()], text[found.end():]
    rest = f"{before} {found['cur'] or ''} {after}"
    return (-value if negative else value), rest


_BRACKETED = re.compile(r"[(\[]([^()\[\]]*(?:\([^()]*\)[^()\[\]]*)?)[)\]]")


@lru_cache(maxsize=200_000)
def unit_in_text(text: str | None) -> Expression:
    """The unit expression that a label or a question holds in brackets or behind a comma."""
    if not text:
        return NOTHING
    s = text.replace("，", ",").replace("（", "(").replace("）", ")")
    s = re.sub(r"[?!\"“”‘’]+", " ", s)
    pieces = [m.group(1) for m in _BRACKETED.finditer(s)]
    plain = _BRACKETED.sub(" ", s)
    pieces += [x for x in plain.split(",")[1:]]
    result = NOTHING
    for piece in pieces:
        said = parse_unit(piece)
        if said is not None and said != NOTHING:
            result = result.filled_from(said)
    return result


@dataclass(frozen=True)
class Amount:
    written: float
    unit: Unit
    scale: float

    def canonical(self, usd_per_unit: float | None = None) -> float | None:
        value = self.written * self.scale * self.unit.factor + self.unit.offset
        if self.unit.money:
            return None if usd_per_unit is None else value * usd_per_unit**self.unit.money
        return value


def amount(written: float | None, said: Expression) -> Amount | None:
    """None where the number or the unit is nowhere told."""
    if written is None or written != written or said.unit is None:
        return None
    return Amount(float(written), said.unit, said.scale or 1.0)


def from_parts(value: float | None, unit: str | None, label: str | None) -> Amount | None:
    """An amount in three columns: number, unit and a label that may hold the unit or its scale."""
    said = parse_unit(unit)
    return amount(value, (said or NOTHING).filled_from(unit_in_text(label)))


def from_text(text: str | None, context: str | None = None) -> Amount | None:
    """An amount in a text; what its own words leave open is looked for in the context."""
    found = parse_number(text)
    if not found:
        return None
    said = parse_unit(found[1])
    return amount(found[0], (said or NOTHING).filled_from(unit_in_text(context)))


def from_arrays(values: list[str] | None, units: list[str] | None) -> Amount | None:
    """An amount in an array of values and one of unit words; the first value that holds a number counts."""
    for value in values if values is not None else ():
        if found := parse_number(value):
            said = parse_unit(found[1]) or NOTHING
            words = parse_unit(" ".join(u for u in units if u)) if units is not None else NOTHING
            return amount(found[0], said.filled_from(words or NOTHING))
    return None


def units_of(units: list[str] | None, at: int, values: int) -> list[str] | None:
    """The unit words of the value at a place: its own where each value has a unit beside it, else all."""
    if units is None or values < 2 or len(units) != values:
        return units
    each = [parse_unit(u) for u in units]
    return [units[at]] if all(said is not None and said.unit is not None for said in each) else units
