"""Samples and splits decided by hashes, the same on every run and for every order of input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestrata.functions.ids import digest, nul_digest

REFUSAL_RATIO = 0.2


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of the smallest SHA-256 over seed, NUL and key; the key breaks ties."""
    if not seed or n < 1:
        raise ValueError("a sample needs a seed and a positive size")
    return df.withColumn("_h", nul_digest(F.lit(seed), F.col(key), width=64)).orderBy("_h", key).limit(n).drop("_h")


def hash_sample_per_group(df: DataFrame, key: str, group: Sequence[str], n: int) -> DataFrame:
    """The n rows of each group with the smallest SHA-256 of the key."""
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.sha2(F.col(key), 256), F.col(key)))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).drop("_turn")


def refusal_sample(candidates: DataFrame, supported: DataFrame, ratio: float = REFUSAL_RATIO, by: Sequence[str] = ("dataset", "source_split"), key: str = "example_id") -> DataFrame:
    """Refusals so many that they are ratio of all: per group, by hash, round-half-even of n r / (1 - r)."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be from 0 to below 1")
    wanted = supported.groupBy(*by).agg(F.bround(F.count(F.lit(1)) * F.lit(ratio) / F.lit(1 - ratio), 0).cast("long").alias("_wanted"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(digest(F.col(key), width=24), key))
    return candidates.withColumn("_turn", turn).join(wanted, list(by)).where(F.col("_turn") <= F.col("_wanted")).drop("_turn", "_wanted")


def once_by_content(df: DataFrame, key: str) -> DataFrame:
    """One row per key; rows of one key must be equal, else it raises."""
    columns = [c for c in df.columns if c != key]
    content: Column = F.sha2(F.to_json(F.struct(*columns)), 256)
    kept = df.withColumn("_c", content).groupBy(key).agg(F.min("_c").alias("_least"), F.max("_c").alias("_most"), F.min_by(F.struct(*columns), "_c").alias("_row"))
    clash = F.when(F.col("_least") != F.col("_most"), F.raise_error(F.concat(F.lit("different rows of one key: "), F.col(key).cast("string"))).cast("string")).otherwise(F.lit(""))
    return kept.withColumn("_clash", clash).where(F.col("_clash") == "").select(key, "_row.*")
