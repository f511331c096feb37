"""Scores of generated answers: content, numbers, units, citations and refusals, each on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.operators.prompts import UNSUPPORTED

#: How numbers, final answers and source labels are written.
NUMBER = r"(?<![\w.])[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?!\w)"
MARKER = r"(?i)\bthe\s+answer\s+is\b"
SOURCE = r"(?i)\[\s*source\s+(\d+)(?:\s*\]|\s*\|[^\]]*\])"
CHECKS = ("overall", "content", "refusal", "numeric", "units", "citations")


def exact_number(text: Column) -> Column:
    """A number of any length in one spelling, so that equal numbers are equal strings; null for what is no number."""
    bare = F.replace(F.trim(text), F.lit(","), F.lit(""))
    whole = F.regexp_replace(F.regexp_extract(bare, r"^[-+]?([0-9]*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(bare, r"\.([0-9]+)$", 1), "0+$", "")
    sign = F.when(bare.startswith("-") & ((whole != "") | (part != "")), "-").otherwise("")
    return F.when(bare.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), F.concat(sign, whole, F.lit("."), part))


def decimals(texts: Column) -> Column:
    """Numbers of an array of strings in one spelling each; what is no number is left out."""
    return F.filter(F.transform(texts, exact_number), lambda d: d.isNotNull())


def answer_numbers(answer: Column) -> Column:
    """Numbers of the part that states the result: behind the last marker, else behind the last equals sign."""
    bare = F.regexp_replace(answer, SOURCE, "")
    marked = F.element_at(F.split(bare, MARKER), -1)
    behind = F.when(bare.rlike(MARKER), marked).otherwise(F.element_at(F.split(bare, "="), -1))
    return decimals(F.regexp_extract_all(behind, F.lit(NUMBER), F.lit(0)))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def assess(answers: DataFrame) -> DataFrame:
    """answers with the flags overall, content, refusal, numeric, units and citations.

    answers: (answer, answerable, expected_values, expected_units, expected_phrases,
    required_sources, context_count, ...). A flag is null where nothing of its kind is expected;
    content ignores citations and units, overall needs every flag that applies. A blank answer
    raises.
    """
    text = F.trim("answer")
    given = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.raise_error(F.lit("an answer is blank")).cast("string"))
    a = answers.withColumn("_a", given).withColumn("_t", _plain(F.col("_a")))
    filled = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    a = a.withColumn("_numbers", answer_numbers(F.col("_a"))).withColumn("_values", decimals(filled("expected_values")))
    a = a.withColumn("_sources", F.array_distinct(F.transform(F.regexp_extract_all("_a", F.lit(SOURCE), F.lit(1)), lambda s: s.cast("int"))))
    refused = F.col("_a") == UNSUPPORTED
    refusal = F.when(F.col("answerable"), ~refused).otherwise(refused)
    numeric = F.when(F.size("_values") > 0, F.forall("_values", lambda v: F.exists("_numbers", lambda n: n == v)))
    units = F.when(F.size(filled("expected_units")) > 0, F.forall(filled("expected_units"), lambda u: F.contains(F.col("_t"), _plain(u))))
    phrases = F.forall(filled("expected_phrases"), lambda p: F.regexp_like(F.col("_t"), F.concat(F.lit(r"(?<!\w)\Q"), _plain(p), F.lit(r"\E(?!\w)"))))
    needed = F.coalesce(F.col("required_sources"), F.array().cast("array<int>"))
    cited = F.when(F.size(needed) > 0, (F.size(F.array_except(needed, "_sources")) == 0) & F.forall("_sources", lambda s: (s >= 1) & (s <= F.col("context_count"))))
    a = a.withColumn("refusal", refusal).withColumn("numeric", numeric).withColumn("units", units).withColumn("citations", cited)
    a = a.withColumn("content", F.when(F.col("answerable"), phrases & F.coalesce("numeric", F.lit(True))).otherwise(F.col("refusal")))
    whole = F.col("content") & F.col("refusal") & F.coalesce("numeric", F.lit(True)) & F.coalesce("units", F.lit(True)) & F.coalesce("citations", F.lit(True))
    return a.withColumn("overall", whole).drop("_a", "_t", "_numbers", "_values", "_sources")


def answer_metrics(assessed: DataFrame, by: tuple[str, str] = ("category", "context_mode")) -> DataFrame:
    """Correct, applicable and accuracy of each check, per value of each column of by, and in all."""
    measures = []
    for c in CHECKS:
        measures += [F.count_if(F.col(c)).alias(f"{c}_correct"), F.count(c).alias(f"{c}_count")]
    sets = [[F.col(by[0])], [F.col(by[1])], []]
    rolled = assessed.groupingSets(sets, F.col(by[0]), F.col(by[1])).agg(*measures, F.grouping(by[0]).alias("_a"), F.grouping(by[1]).alias("_b"))
    scope = F.when(F.col("_a") == 0, by[0]).when(F.col("_b") == 0, by[1]).otherwise("all")
    value = F.when(F.col("_a") == 0, F.col(by[0])).when(F.col("_b") == 0, F.col(by[1])).otherwise("all")
    accuracy = [F.try_divide(F.col(f"{c}_correct"), F.col(f"{c}_count")).alias(f"{c}_accuracy") for c in CHECKS]
    return rolled.select(scope.alias("scope"), value.alias("value"), *[f"{c}_{x}" for c in CHECKS for x in ("correct", "count")], *accuracy)


def metric_differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """(scope, value, check, base, other, delta) of two results of answer_metrics(); null where either is."""
    long = lambda df, name: df.select("scope", "value", *[F.col(f"{c}_accuracy").alias(c) for c in CHECKS]).unpivot(["scope", "value"], list(CHECKS), "check_name", name)
    return long(base, "base").join(long(other, "other"), ["scope", "value", "check_name"]).withColumn("delta", F.col("other") - F.col("base"))
