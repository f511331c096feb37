"""Sinks: canonical JSON lines, manifests, and the embedding cache, on whatever file system the paths name."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def canonical_json(df: DataFrame) -> Column:
    """One compact object per row, top-level keys in order; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def _digests(line: Column) -> list[Column]:
    """Count of lines and the sums of the four quarters of their SHA-256, which don't depend on their order."""
    h = F.sha2(line, 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"d{i}") for i in (1, 16, 31, 46)]
    return [F.count(F.lit(1)).alias("records"), *parts]


def _artifact(found: dict) -> dict:
    return {"records": found["records"], "digest": "-".join(str(found[f"d{i}"]) for i in (1, 16, 31, 46))}


def write_json_lines(df: DataFrame, path: str, key: str | None = None, allow_empty: bool = True) -> dict:
    """Write canonical lines, sorted by key within range partitions, under Spark's commit protocol.

    Returns {"records", "digest"}, counted and hashed while the lines are written; the digest
    doesn't depend on their order. Nothing to write raises unless allow_empty.
    """
    if not allow_empty and df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key else df
    seen = Observation()
    ordered.select(canonical_json(ordered).alias("value")).observe(seen, *_digests(F.col("value"))).write.mode("overwrite").text(path)
    return _artifact(seen.get)


def artifact(spark: SparkSession, path: str) -> dict:
    """{"records", "digest"} of lines that were written, to compare with a manifest's."""
    return _artifact(spark.read.text(path).agg(*_digests(F.col("value"))).first().asDict())


def _place(path: str):  # noqa: ANN202
    spark = SparkSession.active()
    files, configuration = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = files.Path(path)
    return files, target, target.getFileSystem(configuration), configuration


def _rename(files, source, target, system, configuration) -> None:  # noqa: ANN001
    overwrite = SparkSession.active().sparkContext._gateway.new_array(files.Options.Rename, 1)
    overwrite[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(system.getUri(), configuration).rename(source, target, overwrite)


def write_atomically(path: str, content: bytes) -> None:
    """One small file, whole or not at all, on the file system that the path names."""
    files, target, system, configuration = _place(path)
    target = system.makeQualified(target)
    system.mkdirs(target.getParent())
    system.setWriteChecksum(False)
    temporary = files.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = system.create(temporary, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        _rename(files, temporary, target, system, configuration)
    except BaseException:
        system.delete(temporary, False)
        raise
    finally:
        system.setWriteChecksum(True)


def read_small(path: str) -> str:
    """A small text file whole, from the file system that the path names."""
    rows = SparkSession.active().read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is no single file")
    return rows[0].value


def exists(path: str) -> bool:
    _, target, system, _ = _place(path)
    return system.exists(target)


def write_manifest(path: str, fields: dict) -> None:
    write_atomically(path, (json.dumps(fields, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode())


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """Append unit vectors to the cache, one folder per model and revision."""
    vectors.write.mode("append").partitionBy("model", "revision").parquet(path)
