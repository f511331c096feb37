"""Retrieval metrics: gold lineage joined to rankings, hits, recall and reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.ranking import merged

K_VALUES = (1, 3, 5)


def per_query(rankings: DataFrame, gold: DataFrame, lineage: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """One row per query: first relevant rank, and hit_k and recall_k for each k.

    rankings: (query_id, chunk_id, rank), gold: (query_id, element_id), lineage: (chunk_id,
    element_id). Gold ids are trimmed and distinct, blanks none; queries without gold are left out.
    Recall is the share of distinct gold elements that the first k units cover.
    """
    wanted = gold.select("query_id", F.trim("element_id").alias("element_id")).where(F.col("element_id") != "").distinct()
    found = rankings.select("query_id", "chunk_id", "rank").join(merged(lineage.select("chunk_id", "element_id").distinct()), "chunk_id").groupBy("query_id", "element_id").agg(F.min("rank").alias("rank"))
    joined = wanted.join(merged(found), ["query_id", "element_id"], "left")
    measures = [F.min("rank").alias("first_relevant_rank"), F.count(F.lit(1)).alias("n_gold")]
    for k in sorted(set(k_values)):
        within = F.count(F.when(F.col("rank") <= k, 1))
        measures += [(within > 0).cast("int").alias(f"hit_{k}"), (within / F.count(F.lit(1))).alias(f"recall_{k}")]
    return joined.groupBy("query_id").agg(*measures)


def aggregate(evaluations: DataFrame, by: str = "dataset", k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Unweighted means per value of by, and combined over all in the row named "combined"."""
    means = [F.count(F.lit(1)).alias("n_queries")]
    for k in sorted(set(k_values)):
        means += [F.avg(f"hit_{k}").alias(f"hit_{k}"), F.avg(f"recall_{k}").alias(f"recall_{k}")]
    means.append(F.avg(F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0))).alias("mrr"))
    rolled = evaluations.groupingSets([[F.col(by)], []], F.col(by)).agg(*means, F.grouping_id().alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "combined").otherwise(F.col(by)).alias("scope"), *[c for c in rolled.columns if c not in (by, "_all")])


def deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """candidate minus baseline, per scope and metric, of two results of aggregate().

    Runs are comparable only over the same queries: a scope with other counts raises.
    """
    metrics = [c for c in baseline.columns if c not in ("scope", "n_queries")]
    long = lambda df, name: df.unpivot(["scope", "n_queries"], metrics, "metric", name)
    joined = long(baseline, "baseline").withColumnRenamed("n_queries", "n_baseline").join(long(candidate, "candidate"), ["scope", "metric"])
    same = F.when(F.col("n_baseline") == F.col("n_queries"), F.col("candidate") - F.col("baseline")).otherwise(F.raise_error(F.lit("the runs cover different queries")).cast("double"))
    return joined.select("scope", "metric", "baseline", "candidate", same.alias("delta"))


def input_counts(documents: DataFrame, units: DataFrame, queries: DataFrame, by: str = "dataset") -> DataFrame:
    """Documents, units and queries per dataset, and in all."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))

    rows = counted(documents, "documents").join(counted(units, "units"), by, "full_outer").join(counted(queries, "queries"), by, "full_outer").na.fill(0)
    return rows.groupingSets([[F.col(by)], []], F.col(by)).agg(*[F.sum(c).alias(c) for c in ("documents", "units", "queries")], F.grouping_id().alias("_all")).select(
        F.when(F.col("_all") == 1, "combined").otherwise(F.col(by)).alias("scope"), "documents", "units", "queries"
    )
