"""Structured Streaming: chunks of new page-marked texts, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """source_file and text of each file that arrives in the folder."""
    rows = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def ingest(spark: SparkSession, folder: str, to: str, checkpoint: str, doc_type: str = "unknown", priority: int = 9):
    """Appends the chunks of what has arrived to a Parquet table; a restart goes on where the last one ended."""
    docs = new_texts(spark, folder).withColumns({"doc_type": F.lit(doc_type), "priority": F.lit(priority)})
    rows = chunking.built(chunking.folded(docs))
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their value by tumbling window and kind; state older than the watermark goes."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    rows = timed.groupBy(F.window("__t", width), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), kind, "n", "total")
