from __future__ import annotations

import math

import pytest
from hypothesis import given, settings, strategies as st
from lodestrata.functions import quantities as grammar, quantities as q
from lodestrata.operators import quantities
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "value, unit, label, canonical, usd",
    [
        (4020.8, None, "cost of services, $ thousands", 4_020_800.0, 1.0),
        (2.5, "EUR", "interest expense (in millions)", 2_750_000.0, 1.1),
        (5.0, "usd_billions", "net sales", 5e9, 1.0),
        (1097.0, "BPS", "EFFECTIVE TAX RATE", 0.1097, None),
        (35.05, None, "gross margin, pct", 0.3505, None),
        (2.0, "short tons", "freight carried", 1814.36948, None),
        (3.0, "barrels (000s)", "crude output", 3000.0, None),
        (2.0, "GWh", "power generated", 7.2e12, None),
        (10.0, None, "leased floor space [in acres]", 40468.564224, None),
        (7.0, "pounds", "coal output", 3.17514659, None),
        (7.0, "pounds sterling", "goodwill", 14.0, 2.0),
    ],
)
def test_parts(value, unit, label, canonical, usd):
    assert q.from_parts(value, unit, label).canonical(usd) == pytest.approx(canonical)


@pytest.mark.parametrize(
    "text, context, written, canonical",
    [
        ("$ 14,862mm", None, 14862.0, 14_862_000_000.0),
        ("GBP (12.1678) mm", None, -12.1678, -12_167_800.0),
        ("$(6,761,700)", None, -6761700.0, -6761700.0),
        ("(887.19) USD thousand", None, -887.19, -887190.0),
        ("413.96", "what is the goodwill at Acme (USD thousands)?", 413.96, 413960.0),
        ("0.5478", "how much discount rate, in fraction?", 0.5478, 0.5478),
        ("5.2 million", "what was it, in US dollars?", 5.2, 5_200_000.0),
    ],
)
def test_texts(text, context, written, canonical):
    found = q.from_text(text, context)
    assert (found.written, found.canonical(1.0)) == (pytest.approx(written), pytest.approx(canonical))


def test_what_tells_no_unit_gives_none():
    assert q.from_parts(5.0, None, "shares repurchased") is None
    assert q.from_parts(None, "USD", "x") is None
    assert q.from_parts(5.0, "parsecs", "x") is None
    assert q.from_text("no number here", "in US dollars") is None
    assert q.from_arrays(["12"], []) is None
    assert q.from_arrays([], ["$"]) is None and q.from_arrays(None, None) is None
    assert q.from_text("12 parsecs of dollars") is None


def test_a_slip_in_a_unit_is_understood():
    assert q.parse_unit("thousnads of US dollars").scale == 1000.0
    assert q.parse_unit("barels").unit.dimension == q.BARRELS


@settings(max_examples=200, deadline=None)
@given(st.floats(-1e12, 1e12, allow_nan=False), st.sampled_from(sorted(q.UNITS)), st.sampled_from(["", "thousands of ", "million "]))
def test_number_and_unit_round_trip(x, unit, scale):
    written = f"{x:.4f}"
    found = q.from_text(f"{written} {scale}{unit}")
    assert found is not None and math.isclose(found.written, float(written))
    assert found.unit == q.UNITS[unit]


def test_pairs_equal_brute_force(spark):
    from lodestrata.operators.quantities import same_amount_other_number

    rows = []
    for i in range(120):
        key = f"F{i % 7}" if i % 11 else None
        amount = [100.0, 100.9, 101.2, -100.0, 0.0, None][i % 6]
        rows.append((i % 100, key, [1.0, 1.005, 1000.0, 0.001][i % 4] * (amount or 0), "1,0" if i % 5 else "0,1", amount))
    df = spark.createDataFrame(rows, "statement_no long, fact_key string, written double, dimension string, amount double")
    extra = df.withColumns({"band": df.amount, "l_written": df.amount})
    got = {tuple(r) for r in same_amount_other_number(extra).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if None in (a[1], b[1], a[4], b[4]) or a[0] >= b[0] or a[1] != b[1] or a[3] != b[3]:
                continue
            if abs(a[2] - b[2]) > 0.01 * max(abs(a[2]), abs(b[2])) and abs(a[4] - b[4]) <= 0.01 * max(abs(a[4]), abs(b[4])):
                want.add((a[0], b[0]))
    assert got == want and want
    assert same_amount_other_number(extra.limit(0)).count() == 0


def test_statements_keep_rows_without_units(spark, small):
    from lodestrata.plans.problems import p5_common_units

    rows = p5_common_units(spark, small).collect()
    keys = [(r.table_name, r.statement_no) for r in rows]
    assert len(keys) == len(set(keys))
    assert {r.unresolved for r in rows} >= {None, "no unit or number"}
    assert all((r.amount is None) == (r.unresolved is not None) for r in rows)


def test_every_value_of_an_array_is_a_statement(spark):
    from lodestrata.operators.quantities import export_statements, in_common_units

    rows = [(1, ["12", "15"], ["$", "million"]), (2, ["3", "n/a", None, "4"], ["USD"]), (3, ["5", "7"], ["USD", "EUR"]), (4, [], ["USD"]), (5, None, None), (6, ["8 shares"], [])]
    df = spark.createDataFrame(rows, "record_no long, expected_values array<string>, expected_units array<string>").withColumns({"fact_key": F.lit("a|b|2020"), "received_at": F.lit(None).cast("timestamp_ntz")})
    rates = spark.createDataFrame([("EUR", 2020, 2.0)], "currency string, fiscal_year int, usd_per_unit double")
    got = sorted(((r.statement_no, r.written, r.amount, r.unresolved) for r in in_common_units(export_statements(df), rates).collect()), key=lambda r: (r[0], r[1] is None, r[1]))
    none = (None, None, "no unit or number")
    assert got == [(1, 12.0, 12e6, None), (1, 15.0, 15e6, None), (2, 3.0, 3.0, None), (2, 4.0, 4.0, None), (2, *none), (2, *none), (3, 5.0, 5.0, None), (3, 7.0, 14.0, None), (4, *none), (5, *none), (6, 8.0, 8.0, None)]


@pytest.mark.parametrize(
    "text, name, factor, currency",
    [
        ("USD/share", "USD/share", 1.0, "USD"), ("usd per tonne", "USD/kg", 1e-3, "USD"), ("$ per barrel", "USD/barrel", 1.0, "USD"), ("EUR / MWh", "USD*s2/kg*m2", 1 / 3.6e9, "EUR"), ("kWh/m2", "kg/s2", 3.6e6, None),
        ("m^2", "m2", 1.0, None), ("m³", "m3", 1.0, None), ("cubic metres", "m3", 1.0, None), ("km squared", "m2", 1e6, None), ("kg m/s^2", "kg*m/s2", 1.0, None), ("short tons per day", "kg/s", 907.18474 / 86400, None), ("m s^-1 · kg", "kg*m/s", 1.0, None),
    ],
)
def test_products_quotients_and_powers(text, name, factor, currency):
    said = grammar.parse_unit(text)
    assert grammar.canonical_name(said.unit.dimension) == name and said.unit.currency == currency
    assert said.unit.factor == pytest.approx(factor)


def test_what_is_no_compound():
    for text in ("per share", "USD per", "m", "GBP/EUR", "USD * thousands", "in 2019", "cubic", "squared"):
        assert grammar.parse_unit(text) is None, text
    assert grammar.parse_unit("USD / thousands") == grammar.parse_unit("thousands of USD") and grammar.parse_unit("USD/$") == grammar.parse_unit("USD")
    said = grammar.parse_unit("USD millions per thousand barrels")
    assert said.scale == 1e3 and said.unit == grammar.parse_unit("USD/barrel").unit


def test_compound_money_converts_by_the_rate_of_its_year(spark):
    rows = [(1, "a|price|2020", 10.0, "EUR per tonne", None), (2, "a|price|2020", 0.012, "USD/kg", None), (3, "b|price|2020", 5.0, "JPY/kg", None)]
    operands = spark.createDataFrame(rows, "operand_id long, fact_key string, value double, unit string, label string").withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    rates = spark.createDataFrame([("EUR", 2020, 1.2), ("USD", 2020, 1.0)], "currency string, fiscal_year int, usd_per_unit double")
    amounts = quantities.in_common_units(quantities.operand_statements(operands), rates)
    got = {r.statement_no: (r.common_unit, None if r.amount is None else round(r.amount, 6)) for r in amounts.collect()}
    assert got == {1: ("USD/kg", 0.012), 2: ("USD/kg", 0.012), 3: (None, None)}
    assert {tuple(r) for r in quantities.same_amount_other_number(amounts).collect()} == {(1, 2)}
