"""Scanned files as a resumable stream: one reading of each file for its text, its statistics and its duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..sources import scans
from ..sources.shared import saved


def read_stream(spark: SparkSession, folder: str, to: str, checkpoint: str, extract: scans.Extractor = scans.plain_pages, read: scans.Reader | None = scans.plain_reader, glob: str = "*.pdf", files_each: int = 1000):
    """Reads what has arrived in a folder, `files_each` files at a time, and stops. A batch's results are folders named by
    its number: `texts` (source_file, text), `statistics`, and `digests` (source_file, digest, duplicate_of: the file that
    had the same first pages before). A batch is written anew if it was interrupted, and counts once; batches that were
    done are not read again."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_each).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        pages = saved(scans.page_texts(batch, extract, read), "pages")
        texts = saved(scans.marked_texts(pages), "texts")
        texts.write.mode("overwrite").parquet(f"{to}/texts/batch={number}")
        scans.statistics(pages).write.mode("overwrite").parquet(f"{to}/statistics/batch={number}")
        digested(own, texts, to, number).write.mode("overwrite").parquet(f"{to}/digests/batch={number}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digested(spark: SparkSession, texts: DataFrame, to: str, number: int) -> DataFrame:
    """A digest of each text's first pages, in lower case and with even spaces, and the file that had it first: in an earlier
    batch, or in this one by name. Blank texts are no duplicates."""
    even = F.lower(F.trim(F.regexp_replace(providers.first_pages(F.col("text")), r"(?U)\s+", " ")))
    new = texts.select("source_file", F.when(even != "", F.sha2(even, 256)).alias("digest"))
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/digests")
    seen = spark.createDataFrame([], "digest string, known string")
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        rows = spark.read.schema("source_file string, digest string, duplicate_of string, batch int").parquet(f"{to}/digests")
        seen = rows.filter((F.col("batch") < number) & F.col("duplicate_of").isNull() & F.col("digest").isNotNull()).select("digest", F.col("source_file").alias("known"))
    first = new.filter("digest is not null").groupBy("digest").agg(F.min("source_file").alias("first"))
    both = new.join(first, "digest", "left").join(seen, "digest", "left")
    of = F.coalesce("known", F.when(F.col("first") != F.col("source_file"), F.col("first")))
    return both.select("source_file", "digest", F.when(F.col("digest").isNotNull(), of).alias("duplicate_of"))


def texts(spark: SparkSession, to: str) -> DataFrame:
    """source_file and text of the files read so far that are no duplicates."""
    again = spark.read.parquet(f"{to}/digests").filter("duplicate_of is not null").select("source_file")
    return spark.read.parquet(f"{to}/texts").select("source_file", "text").join(again, "source_file", "left_anti")
