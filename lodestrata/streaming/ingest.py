"""Structured Streaming: pages that land in a folder become units, and counts per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.chunker import Limits, markdown_units

PAGES = "document_id string, page_number int, markdown string, source_element_ids array<string>, received_at timestamp"


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Pages of JSON-lines files as they land; a page delivered again within the watermark is left out."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return pages.withWatermark("received_at", "1 day").dropDuplicatesWithinWatermark(["document_id", "page_number"])


def units_sink(pages: DataFrame, target: str, checkpoint: str, limits: Limits = Limits(), available_now: bool = True) -> StreamingQuery:
    """Cut each micro-batch's documents into units and write them under its batch number.

    Pages are kept in target/pages by batch, so a document whose pages land apart is cut anew as a
    whole, numbered from its first page; current_units() takes the last batch of each document. A
    retried batch replaces what it wrote.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/pages/batch={number}")
        held = spark.read.option("basePath", f"{target}/pages").parquet(f"{target}/pages").where(F.col("batch") <= number)
        landed = held.where(F.col("batch") == number).select("document_id").distinct()
        whole = held.drop("batch").join(landed, "document_id", "left_semi")
        markdown_units(whole, limits).write.mode("overwrite").parquet(f"{target}/units/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_units(spark: SparkSession, target: str) -> DataFrame:
    """Units that units_sink() has written, of each document those of its last batch."""
    units = spark.read.option("basePath", f"{target}/units").parquet(f"{target}/units")
    last = units.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return units.join(last, ["document_id", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream (ts, event_type, value); late events up to a limit count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
