"""Duplicate deliveries of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_delivery(df: DataFrame, key: str, columns: list[str], arrived: str = "received_at") -> DataFrame:
    """(key, *columns) of the latest delivery of each key.

    Ties in arrival are broken by a hash of the row, a null arrival is the earliest. Rows with a
    null key are no deliveries of one record: they all stay, each in a group of its own. Aggregation
    starts before the shuffle.
    """
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = df.select(key, *columns, F.col(arrived).alias("_arrived"), own.alias("_own"))
    order: Column = F.struct(F.col("_arrived").isNotNull(), F.col("_arrived"), F.xxhash64(*columns))
    return rows.groupBy(key, "_own").agg(F.max_by(F.struct(*columns), order).alias("_row")).select(key, "_row.*")
