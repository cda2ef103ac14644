"""The training-data pipeline over `documents`: language ID, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet into the shared folder and read again. Documents
without an id, or with one that others have too, are numbered by the stages that decide by document, so that each is
judged by itself. Columns that a stage doesn't read may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language, minhash, packing, pii
from millrace.llm.common import free_name, fresh_path, saved
from millrace.llm.queries import table, tokenizer

#: Documents whose best language is less likely than this are rejected, like those without a letter.
LEAST_SCORE = 0.5
#: Percent of shared shingles from which documents are near-duplicates, and minima in a band.
SIMILARITY, ROWS = 80, 5


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of a column that no two rows share: doc_id or, where ids are missing or repeated, a number."""
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs, "doc_id"
    key = free_name(docs.columns, "row")
    return saved(docs.withColumn(key, F.monotonically_increasing_id())), key


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    found = language.identify(docs.select("text", F.struct(*rest).alias("rest")), language.train(docs))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, key = keyed(docs)
    groups = minhash.near_duplicates(named.select(F.col(key).alias("doc_id"), "text"), width=5, percent=SIMILARITY, rows=ROWS)
    if key == "doc_id":
        gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return named.join(gone, "doc_id", "left_anti").select(docs.columns)
    placed = groups.join(named.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("name")), "doc_id")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull().alias("null"), "name", "doc_id")).alias("first"))
    return named.join(first.select(F.col("first.doc_id").alias(key)), key, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, key = keyed(docs)
    found = decontamination.contamination(named.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), width=10)
    return named.join(found.filter("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, key = keyed(docs)
    spans = free_name(named.columns, "spans")
    found = pii.find(named.select(F.col(key).alias("doc_id"), "text")).filter(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(spans))
    clean = named.join(found, key, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col(spans))))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
