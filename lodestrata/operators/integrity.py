"""Integrity checks as queries: every row they return is a violation, so none means sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, functions as F


def entity_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, n_rows, n_contents) of keys whose rows differ in the given columns."""
    content = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(content).alias("n_contents"))
    return seen.where(F.col("n_contents") > 1)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def missing_parents(children: DataFrame, child_key: str, foreign: str, parents: DataFrame, parent_key: str, check: str) -> DataFrame:
    """(check_name, row_key, ref_key) of children whose foreign key no parent has; null is no reference."""
    rows = children.where(F.col(foreign).isNotNull()).select(F.col(child_key).cast("string").alias("row_key"), F.col(foreign).cast("string").alias("ref_key")).distinct()
    known = parents.select(F.col(parent_key).cast("string").alias("ref_key")).where(F.col("ref_key").isNotNull())
    return rows.join(known, "ref_key", "left_anti").select(F.lit(check).alias("check_name"), "row_key", "ref_key")


def split_overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, left_split, right_split) of keys that two splits share, the smaller split name first."""
    once = df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = once.select(key, "s", F.posexplode("s").alias("i", "left_split")).select(key, "left_split", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right_split"))
    return pairs


def offset_violations(windows: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """Windows whose length or text isn't that of their offsets: (key, chunk_index, reason)."""
    joined = windows.join(texts.select(F.col(key), F.col("text").alias("whole")), key, "left")
    exact = F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    reason = (
        F.when(F.col("whole").isNull(), "no document")
        .when(F.length("text") != F.col("char_end") - F.col("char_start"), "length")
        .when(F.col("text") != exact, "text")
    )
    return joined.select(key, "chunk_index", reason.alias("reason")).where(F.col("reason").isNotNull())


def preparation_statistics(statuses: DataFrame, by: str = "split") -> DataFrame:
    """Counters of link and preparation statuses per split, one column each.

    statuses: (split, status, is_duplicate). skipped is what isn't normalized.
    """
    known = ("normalized", "unlinked", "ambiguous", "answer_mismatch", "evidence_incomplete")
    counted = [F.count_if((F.col("status") == s) & ~F.col("is_duplicate")).alias(s) for s in known]
    all_ = statuses.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *counted, F.count_if("is_duplicate").alias("duplicates"))
    return all_.withColumn("skipped", F.col("total") - F.col("normalized"))


def statistics_violations(stats: DataFrame) -> DataFrame:
    """Rows of preparation statistics whose identities don't hold."""
    parts = F.col("normalized") + F.col("unlinked") + F.col("ambiguous") + F.col("answer_mismatch") + F.col("evidence_incomplete") + F.col("duplicates")
    return stats.where((F.col("total") != parts) | (F.col("skipped") != F.col("total") - F.col("normalized")))


def histogram(df: DataFrame, field: str) -> DataFrame:
    """(value, n) of a field, null its own value."""
    return df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def list_histogram(df: DataFrame, field: str) -> DataFrame:
    """(value, n) of the members of an array field, in the type and order of their values."""
    return df.select(F.explode(field).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One digest of a table that doesn't depend on the order of its rows.

    The count, and the sums of the four quarters of each row's SHA-256 over its values, each led by
    its length, null told from empty.
    """
    value = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    row = F.sha2(F.concat(*[value(F.col(c).cast("string")) for c in columns]), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in (1, 16, 31, 46)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *parts).alias("digest"))


def digest_of(df: DataFrame, columns: Sequence[str]) -> str:
    """The fingerprint of a table as one string."""
    row = fingerprint(df, columns).first()
    return f"{row.n_rows}:{row.digest}"


def require_none(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raise if there is any violation, naming a few."""
    found: list[Row] = violations.limit(shown).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
