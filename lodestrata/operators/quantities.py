"""Quantities recorded in different units (problem 5): common units, and statements of one amount.

Numbers and units are parsed by the grammar of functions.quantities in one Arrow pass beside the
scan. Pairs come from a band join: the logarithm of an amount gives its band, so only neighbours
within about one percent ever meet. Statements with the same key, number and amount are one class
until the last step, which bounds the join of a hot key by its distinct amounts.
"""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodestrata.functions import quantities as grammar
from lodestrata.session import cut

_NUMBERS = ("written", "scale", "factor", "shift", "money")
_COLUMNS = ("written", "dimension", "unit", "scale", "factor", "shift", "currency", "money")
PARSED = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMBERS else T.StringType()) for c in _COLUMNS])


def _describe(amount: grammar.Amount | None) -> tuple:
    if amount is None:
        return (None,) * 8
    d = amount.unit.dimension
    return amount.written, ",".join(map(str, d)), grammar.canonical_name(d), amount.scale, amount.unit.factor, amount.unit.offset, amount.unit.currency, float(amount.unit.money)


@F.pandas_udf(PARSED)
def _parse_parts(value: pd.Series, unit: pd.Series, label: pd.Series) -> pd.DataFrame:
    rows = [_describe(grammar.from_parts(None if v is None or v != v else float(v), u, x)) for v, u, x in zip(value, unit, label)]
    return pd.DataFrame(rows, columns=_COLUMNS)


@F.pandas_udf(PARSED)
def _parse_arrays(value: pd.Series, at: pd.Series, n: pd.Series, units: pd.Series) -> pd.DataFrame:
    rows = [_describe(grammar.from_arrays(None if v is None else [v], u if a != a else grammar.units_of(u, int(a), int(k)))) for v, a, k, u in zip(value, at, n, units)]
    return pd.DataFrame(rows, columns=_COLUMNS)


@F.pandas_udf(PARSED)
def _parse_texts(texts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
    rows = [_describe(grammar.from_text(t, c)) for t, c in zip(texts, contexts)]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _one_delivery(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the latest delivery; rows without a key are no statements."""
    columns = [c for c in df.columns if c != key]
    order = F.struct(F.coalesce(F.col("received_at"), F.lit("0001-01-01").cast("timestamp_ntz")), F.xxhash64(*columns))
    latest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return latest.select(key, "_row.*")


def operand_statements(operands: DataFrame) -> DataFrame:
    """Statements (table_name, statement_no, fact_key, parsed) of (operand_id, fact_key, value, unit, label)."""
    rows = _one_delivery(operands.select("operand_id", "fact_key", "value", "unit", "label", "received_at"), "operand_id")
    parsed = _parse_parts(F.col("value").cast("double"), "unit", "label")
    return rows.select(F.lit("operands").alias("table_name"), F.col("operand_id").alias("statement_no"), "fact_key", parsed.alias("parsed"))


def export_statements(rag_export: DataFrame) -> DataFrame:
    """Statements of (record_no, fact_key, expected_values, expected_units), one for each value.

    Nothing but the arrays tells the unit. A record without values is one statement without amount.
    """
    rows = _one_delivery(rag_export.select("record_no", "fact_key", "expected_values", "expected_units", "received_at"), "record_no")
    rows = rows.select("*", F.size("expected_values").alias("_n"), F.posexplode_outer("expected_values").alias("_at", "_value"))
    parsed = _parse_arrays("_value", "_at", "_n", "expected_units")
    return rows.select(F.lit("rag_export").alias("table_name"), F.col("record_no").alias("statement_no"), "fact_key", parsed.alias("parsed"))


def example_statements(examples: DataFrame) -> DataFrame:
    """Statements of (record_no, question, reference_answer): the answer's words, then the question's."""
    rows = _one_delivery(
        examples.select(
            "record_no",
            F.try_element_at(F.col("question.metadata"), F.lit("fact_key")).alias("fact_key"),
            F.col("question.text").alias("question_text"),
            F.col("reference_answer.text").alias("answer_text"),
            "received_at",
        ),
        "record_no",
    )
    parsed = _parse_texts("answer_text", "question_text")
    return rows.select(F.lit("examples").alias("table_name"), F.col("record_no").alias("statement_no"), "fact_key", parsed.alias("parsed"))


def in_common_units(statements: DataFrame, rates: DataFrame) -> DataFrame:
    """Every statement in the common unit of its kind of quantity.

    rates: (currency, fiscal_year, usd_per_unit), a table of currencies by years, thus small. Money
    converts by the rate of the fact_key's year ("company|measure|year"). amount is null where no
    number or unit is told, or money has no rate; such rows stay, with the reason.
    """
    flat = statements.select("table_name", "statement_no", F.nullif(F.trim("fact_key"), F.lit("")).alias("fact_key"), "parsed.*")
    year = F.expr("try_cast(element_at(split(fact_key, '[|]'), -1) AS INT)")
    fx = rates.groupBy(F.col("currency").alias("fx_currency"), F.col("fiscal_year").alias("fx_year")).agg(F.max("usd_per_unit").alias("usd"))
    joined = flat.withColumn("_year", year).join(fx, (F.col("currency") == F.col("fx_currency")) & (F.col("_year") == F.col("fx_year")), "left")
    rate = F.when(F.col("currency") == "USD", F.coalesce("usd", F.lit(1.0))).otherwise(F.col("usd"))
    plain = F.col("written") * F.col("scale") * F.col("factor") + F.col("shift")
    value = F.when(F.col("money") == 0, plain).otherwise(plain * F.when(F.col("money") == 1, rate).otherwise(F.pow(rate, "money")))
    return joined.select(
        "table_name", "statement_no", "fact_key", "written", "dimension", F.col("unit").alias("common_unit"), value.alias("amount"),
        F.when(F.col("written").isNull(), "no unit or number").when(value.isNull(), "no rate").alias("unresolved"),
    )


def same_amount_other_number(amounts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pairs (left_no, right_no) of one fact whose written numbers differ by more than the tolerance
    of the larger while their amounts in the common unit differ by at most it.

    amounts: rows of in_common_units(). Statements without fact_key or amount take no part. Two
    statements of one number (a key both tables use) are one. left_no < right_no.
    """
    known = amounts.where(F.col("fact_key").isNotNull() & F.col("amount").isNotNull() & F.col("written").isNotNull())
    # four joins read it, and the grammar should run once
    known = cut(known.select("statement_no", "fact_key", "dimension", "written", "amount"))
    classes = known.select("fact_key", "dimension", "written", "amount").distinct()
    width = -math.log(1 - tolerance) * (1 + 1e-9)
    band = F.when(F.col("amount") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs("amount")) / width))
    classes = classes.withColumn("sign", F.signum("amount").cast("int")).withColumn("band", band)
    left = classes.select(*[F.col(c).alias(f"l_{c}") for c in ("written", "amount")], "fact_key", "dimension", "sign", "band")
    right = classes.select(*[F.col(c).alias(f"r_{c}") for c in ("written", "amount")], "fact_key", "dimension", "sign", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    apart = F.abs(F.col("l_written") - F.col("r_written")) > tolerance * F.greatest(F.abs("l_written"), F.abs("r_written")) * (1 + 1e-12)
    close = F.abs(F.col("l_amount") - F.col("r_amount")) <= tolerance * F.greatest(F.abs("l_amount"), F.abs("r_amount")) * (1 + 1e-12)
    met = left.join(right, ["fact_key", "dimension", "sign", "band"]).where(apart & close & (F.col("l_written") < F.col("r_written")))
    members = known.select("fact_key", "dimension", "written", "amount", "statement_no")
    of = lambda side, no: members.select("fact_key", "dimension", F.col("written").alias(f"{side}_written"), F.col("amount").alias(f"{side}_amount"), F.col("statement_no").alias(no))
    pairs = met.join(of("l", "a"), ["fact_key", "dimension", "l_written", "l_amount"]).join(of("r", "b"), ["fact_key", "dimension", "r_written", "r_amount"])
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("left_no"), F.greatest("a", "b").alias("right_no")).distinct()
