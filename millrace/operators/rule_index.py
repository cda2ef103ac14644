"""The inverted index of rule numbers: rule -> chunks, in order of authority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entries(chunks: DataFrame) -> DataFrame:
    """One row for each rule and chunk that has or mentions it. chunks: chunk_id, rule_number, all_rule_numbers, doc_type,
    priority, source_file, content_type, seq."""
    own = F.when(F.col("rule_number").isNotNull(), F.array(F.struct(F.col("rule_number").alias("rule"), F.lit(False).alias("secondary")))).otherwise(F.array().cast("array<struct<rule:string,secondary:boolean>>"))
    rest = F.transform(F.filter(F.array_distinct(F.coalesce("all_rule_numbers", F.array().cast("array<string>"))), lambda r: ~r.eqNullSafe(F.col("rule_number"))), lambda r: F.struct(r.alias("rule"), F.lit(True).alias("secondary")))
    return chunks.select(F.explode(F.concat(own, rest)).alias("e"), "chunk_id", "doc_type", "priority", "source_file", "content_type", "seq").select("e.*", "chunk_id", "doc_type", "priority", "source_file", "content_type", "seq")


def rule_index(chunks: DataFrame) -> DataFrame:
    """entries with rank from 1 by (priority, seq, secondary) within each rule; a rule's entries are ranked in one task. For
    rules that a large part of all chunks has, and for tables that are looked up in, see sources.rule_table."""
    return entries(chunks).withColumn("rank", F.row_number().over(Window.partitionBy("rule").orderBy("priority", "seq", "secondary", "chunk_id")))


def nested(index: DataFrame) -> DataFrame:
    """rule -> array of its entries in order."""
    entry = F.struct("rank", "chunk_id", "doc_type", "priority", "source_file", "content_type", "secondary")
    return index.groupBy("rule").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def lookup(index: DataFrame, wanted: DataFrame, each: int | None = None, limit: int | None = None) -> DataFrame:
    """Chunk ids of the wanted rules (rule, ord), without repeats, in order of (ord, rank): the first `each` of a rule,
    the first `limit` of all. Adds pos from 1."""
    found = index.join(wanted, "rule")
    if each is not None:
        found = found.filter(F.col("rank") <= each)
    first = found.groupBy("chunk_id").agg(F.min(F.struct("ord", "rank")).alias("at"))
    if limit is not None:
        first = first.orderBy("at", "chunk_id").limit(limit)
    return first.withColumn("pos", F.row_number().over(Window.orderBy("at", "chunk_id"))).select("chunk_id", "pos")


def chase(docs: DataFrame, index: DataFrame, reference_pattern: str, rule_tag: str, max_refs: int = 5, entries: int = 1, known: bool = True) -> DataFrame:
    """One hop along the references of docs (text, pos): the first max_refs, of those that none of docs is about if `known`
    rules are left out, each with its first `entries` chunks: ref, chunk_id, pos."""
    from ..functions import text

    refs = docs.select("pos", F.posexplode(text.cross_references(F.col("text"), reference_pattern)).alias("at", "ref")).groupBy("ref").agg(F.min(F.struct("pos", "at")).alias("first"))
    if known:
        refs = refs.join(docs.select(F.regexp_extract("text", rule_tag, 1).alias("ref")), "ref", "left_anti")
    new = refs.orderBy("first", "ref").limit(max_refs)
    return new.join(index.filter(F.col("rank") <= entries), new["ref"] == index["rule"]).select("ref", "chunk_id", F.struct("first", "rank").alias("pos"))


def conflicts(docs: DataFrame) -> DataFrame:
    """Rules that documents of different types are about: rule_number, the type that counts, its priority, the others in
    order of authority, and a note. docs: rule_number, doc_type, priority, pos."""
    entry = F.struct(F.coalesce("priority", F.lit(9)).alias("priority"), "pos", F.coalesce("doc_type", F.lit("")).alias("doc_type"))
    by_rule = docs.filter(F.coalesce("rule_number", F.lit("")) != "").groupBy("rule_number").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count_distinct("doc_type").alias("types")).filter("types > 1")
    first, rest = F.element_at("e", 1), F.array_join(F.transform(F.slice("e", 2, F.size("e")), lambda x: x["doc_type"]), ", ")
    note = F.format_string("CONFLICT ON RULE %s: Multiple sources found. The authoritative version is from '%s' (priority %d). Other versions from: %s.", "rule_number", first["doc_type"], first["priority"], rest)
    return by_rule.select("rule_number", first["doc_type"].alias("doc_type"), first["priority"].alias("priority"), rest.alias("others"), note.alias("note"))
