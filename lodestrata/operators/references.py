"""References to records that do not exist (problem 4).

References and parent keys are hash-partitioned on (target, key) and sorted, then merged linearly:
that is Spark's sort-merge join, asked for by hint. Parents are first folded to one validity
interval per key, references to one row per (row, key). A hot key sits on the outer side of the
join, where AQE splits its partition over many tasks and repeats the one parent row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Java's trim set is ASCII only; keys carry any white space of Unicode.
EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def trimmed_key(key: Column) -> Column:
    """The key without surrounding white space; null where nothing is left."""
    return F.nullif(F.regexp_replace(key, EDGE_SPACE, ""), F.lit(""))


def reference_rows(df: DataFrame, *, table_name: str, row_key: str, keys: Column, target: str, arrived: str = "received_at", deleted_at: str | None = "deleted_at") -> DataFrame:
    """Rows (table_name, row_key, target, ref_keys, arrived, live) of one referring table.

    keys is an array column of the row's references. Nulls and blanks in it are no reference.
    """
    live = F.col(deleted_at).isNull() if deleted_at else F.lit(True)
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(row_key).cast("string").alias("row_key"),
        F.lit(target).alias("target"),
        F.array_distinct(F.filter(F.transform(keys, trimmed_key), lambda k: k.isNotNull())).alias("ref_keys"),
        F.col(arrived).alias("arrived"),
        live.alias("live"),
    )


def target_rows(df: DataFrame, *, target: str, key: str, arrived: str = "received_at", deleted_at: str | None = "deleted_at") -> DataFrame:
    """Rows (target, key, arrived, deleted_at) of one referred table."""
    return df.select(
        F.lit(target).alias("target"),
        F.col(key).cast("string").alias("key"),
        F.col(arrived).alias("arrived"),
        (F.col(deleted_at) if deleted_at else F.lit(None).cast("timestamp_ntz")).alias("deleted_at"),
    )


def dangling_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References without a valid parent, as (table_name, row_key, ref_key, arrived, status).

    references: union of reference_rows(); targets: union of target_rows(). Deliveries of one row
    count once; its first arrival is that of its first delivery with the reference. status is

    * missing: no row has the key,
    * deleted: every row with the key is marked deleted,
    * late: the key first arrived after the referring row did.

    Null or blank references and rows whose deliveries are all marked deleted give nothing; null
    row keys count as one key; a null arrival is never late; an empty targets table makes every
    reference missing. Columns beyond the named ones are ignored.
    """
    left = (
        references.select("table_name", "row_key", "target", F.explode("ref_keys").alias("ref_key"), "arrived", "live")
        .groupBy("table_name", "row_key", "target", "ref_key")
        .agg(F.min("arrived").alias("arrived"), F.max("live").alias("live"))
        .where("live")
    )
    validity = (
        targets.where(F.col("key").isNotNull())
        .groupBy("target", "key")
        .agg(F.min("arrived").alias("valid_from"), F.max(F.col("deleted_at").isNull()).alias("valid_now"))
        .select(F.col("target").alias("p_target"), F.col("key").alias("p_key"), "valid_from", "valid_now")
    )
    joined = left.join(validity.hint("merge"), (F.col("target") == F.col("p_target")) & (F.col("ref_key") == F.col("p_key")), "left")
    status = (
        F.when(F.col("p_key").isNull(), "missing")
        .when(~F.col("valid_now"), "deleted")
        .when(F.col("valid_from") > F.col("arrived"), "late")
    )
    return joined.select("table_name", "row_key", "ref_key", "arrived", status.alias("status")).where(F.col("status").isNotNull())


def dangling_report(dangling: DataFrame) -> DataFrame:
    """Counts per table, month of the referring row's first arrival (null where unknown) and status."""
    return dangling.groupBy("table_name", F.date_format("arrived", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n_references"))
