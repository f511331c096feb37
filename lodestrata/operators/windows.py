"""Units cut from texts: fixed character windows, and rows once per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SIZE, OVERLAP = 2_750, 550


def latest(df: DataFrame, key: str, arrived: str = "received_at", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the latest delivery, ties broken by a hash of the row; null keys are left out.

    With keep only those columns beside the key are shuffled; the choice is the same.
    """
    others = [c for c in df.columns if c != key]
    hashed = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c) for c in others])
    order = F.struct(F.col(arrived).isNotNull(), F.col(arrived), hashed)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(keep or others)), order).alias("_row")).select(key, "_row.*")


def char_windows(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, char_start, char_end, text): windows of size characters, each overlapping the last.

    The last window is the first that reaches the end. Null and empty texts have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    stride = size - overlap
    length = F.length(text)
    last = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / stride)).cast("int")
    rows = df.where(length > 0).select(key, text, length.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * stride
    return rows.select(key, "chunk_index", start.alias("char_start"), F.least(F.col("_n"), start + size).alias("char_end"), F.substring(F.col(text), start + 1, F.lit(size)).alias("text"))
