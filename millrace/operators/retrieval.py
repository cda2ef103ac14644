"""From hits to context: reranking, removal of repeats, neighbours, page references, budget, routing and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text
from . import rule_index as index_ops
from . import vector


def priority_rerank(docs: DataFrame, weight: float = fixed.PRIORITY_WEIGHT) -> DataFrame:
    """Ordered by distance + weight * priority, then pos; a row without a distance counts as 0.5, without a priority as 9."""
    combined = F.coalesce("distance", F.lit(fixed.DEFAULT_DISTANCE)) + weight * F.coalesce("priority", F.lit(fixed.DEFAULT_PRIORITY))
    return docs.withColumn("combined", F.round(combined, 6)).orderBy("combined", "pos")


def priority_order(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.coalesce("priority", F.lit(fixed.DEFAULT_PRIORITY)), "pos")


def without_repeats(docs: DataFrame, prefix: int = 200) -> DataFrame:
    """The first row, by pos, of those whose texts begin alike."""
    order = Window.partitionBy(F.substring("text", 1, prefix)).orderBy("pos")
    return docs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def neighbours(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """hits with `expanded`: the text between those of chunks n - 1 and n + 1 of its file, without their carrier tags;
    the text alone where the id has no number. Joins, for numbers may have gaps."""
    prefix, number = F.regexp_extract(key, r"^(.*)_chunk_(\d+)$", 1), F.regexp_extract(key, r"^(.*)_chunk_(\d+)$", 2).try_cast("int")
    placed = hits.withColumns({"__before": F.concat(prefix, F.lit("_chunk_"), (number - 1).cast("string")), "__after": F.concat(prefix, F.lit("_chunk_"), (number + 1).cast("string"))})
    other = lambda name: chunks.select(F.col(key).alias(f"__{name}"), text.without_carrier(F.col("text")).alias(f"__{name}_text"))
    both = placed.join(other("before"), "__before", "left").join(other("after"), "__after", "left")
    return both.withColumn("expanded", F.concat_ws("\n", "__before_text", "text", "__after_text")).drop("__before", "__after", "__before_text", "__after_text")


def referenced_pages(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of each hit (id, carrier, source, page, expanded), the pages that its text refers to but its carrier's hits are not
    from: chunk_id, ref_page, ord and the pages' text."""
    refs = hits.select(key, "carrier", "source", F.posexplode(text.page_references(F.col("expanded"))).alias("ord", "ref_page"))
    there = hits.select("carrier", F.col("page").alias("ref_page"))
    wanted = refs.join(there, ["carrier", "ref_page"], "left_anti").groupBy(key, "carrier", "source", "ref_page").agg(F.min("ord").alias("ord"))
    pages = chunks.select("carrier", F.col("page").alias("ref_page"), "seq", F.col("text").alias("__text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "__text"))), lambda x: x["__text"])
    joined = wanted.join(pages, ["carrier", "ref_page"]).groupBy(key, "carrier", "source", "ref_page", "ord").agg(F.array_join(lines, "\n").alias("body"))
    head = F.format_string("=== CROSS-REFERENCE: %s Page %d (from %s) ===\n%s\n", "carrier", "ref_page", "source", "body")
    return joined.select(key, "carrier", "ref_page", "ord", head.alias("text"))


def within_budget(items: DataFrame, limit: int = 18_000) -> DataFrame:
    """Items (pos, size) in order, up to the first that would follow more than `limit` characters. One request's items
    are few; they are ordered in one task."""
    before = F.coalesce(F.sum("size").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("before", before).filter(F.col("before") <= limit).drop("before")


def result_count(carriers: int) -> int:
    return max(4, min(6, 2 * carriers)) if carriers else 5


def result_counts(carriers: Column) -> Column:
    """result_count of a column."""
    return F.when(carriers > 0, F.greatest(F.lit(4), F.least(F.lit(6), 2 * carriers))).otherwise(5)


def context(docs: DataFrame, limit: int = 12) -> DataFrame:
    """One row: the first documents by pos under headings, set apart by rules."""
    head = F.concat_ws(" | ", F.concat(F.lit("Source: "), "source_file"), F.concat(F.lit("Type: "), "doc_type"), F.concat(F.lit("Rule: "), "rule_number"), F.concat(F.lit("Page: "), F.col("page").cast("string")))
    few = docs.orderBy("pos").limit(limit).select("pos", F.concat(F.lit("["), head, F.lit("]\n"), "text").alias("block"))
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n---\n").alias("context"))


def branches(kind: str, rules: list[str], scenario: str | None) -> list[tuple]:
    """The searches of a question, in order: (how, number, what)."""
    if kind == "direct_rule" and rules:
        return [("lookup", 20, None), ("search", 4, None)]
    if kind == "scenario" and scenario:
        return [("search", 10, ("scenario", scenario)), ("search", 4, None)]
    if kind == "comparison" and rules:
        return [("each", 10, None), ("search", 4, None)]
    if kind == "variant":
        return [("search", 6, ("doc_type", "variant")), ("search", 4, None)]
    return [("search", 10 if kind == "situation" else 8, None)]


def route(chunks: DataFrame, index: DataFrame, query: str, embed, kind: str = "concept", rules: list[str] = (), scenario: str | None = None, sub_queries: list[str] = ()) -> DataFrame:
    """The hits of all branches with pos, in the branches' order; looked-up rows have no distance."""
    spark = chunks.sparkSession
    parts: list[DataFrame] = []
    columns = chunks.columns

    def add(found: DataFrame, order: list[Column]) -> None:
        own = found if "distance" in found.columns else found.withColumn("distance", F.lit(None).cast("double"))
        pos = F.row_number().over(Window.orderBy(*order))
        parts.append(own.withColumn("pos", pos + 1000 * len(parts)).select(*columns, "distance", "pos"))

    def search(q: str, n: int, where: Column | None) -> None:
        found = vector.semantic_search(chunks, q, embed(q), n, where)
        add(found, [F.col("final_score"), F.col("distance"), F.col("chunk_id")])

    for q in sub_queries:
        search(q, 6, None)
    for how, n, what in branches(kind, list(rules), scenario):
        if how == "search":
            search(query, n, F.col(what[0]) == what[1] if what else None)
            continue
        wanted = spark.createDataFrame([(r, k) for k, r in enumerate(dict.fromkeys(rules))], "rule string, ord int")
        ids = index_ops.lookup(index, wanted, n if how == "each" else None, n if how == "lookup" else None)
        add(chunks.join(ids.withColumnRenamed("pos", "__pos"), "chunk_id"), [F.col("__pos")])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer_context(chunks: DataFrame, index: DataFrame, query: str, embed, classified: dict | None = None, prefix: int = 200, preset: str = "rules", reference_pattern: str = fixed.CHASED_REFERENCE) -> dict:
    """What an answer would be written from: documents in order, chased references, conflicts and the context text.
    preset `rules` reranks by distance and priority; `profile` orders by priority and cuts at 12 + 4 documents."""
    c = {"query_type": "concept", "rule_numbers": [], "scenario": None, "sub_queries": []} | (classified or {})
    found = route(chunks, index, query, embed, c["query_type"], c["rule_numbers"], c["scenario"], c["sub_queries"])
    found = without_repeats(found, prefix if preset == "rules" else 100)
    ranked = priority_rerank(found) if preset == "rules" else priority_order(found)
    order = [F.col("combined"), F.col("pos")] if preset == "rules" else [F.coalesce("priority", F.lit(fixed.DEFAULT_PRIORITY)), F.col("pos")]
    docs = ranked.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    if preset != "rules":
        docs = docs.filter(F.col("pos") <= 12)
    refs = index_ops.chase(docs.filter(F.col("pos") <= 10) if preset != "rules" else docs, index, reference_pattern, fixed.RULE_TAG, entries=1 if preset == "rules" else 2, known=preset == "rules")
    chased = chunks.join(refs.select("chunk_id", F.col("pos").alias("__at")), "chunk_id")
    chased = chased.withColumn("pos", 10_000 + F.row_number().over(Window.orderBy("__at", "chunk_id"))).drop("__at")
    if preset != "rules":
        chased = chased.filter(F.col("pos") <= 10_004)
    both = docs.select(*chunks.columns, "pos").unionByName(chased.select(*chunks.columns, "pos"))
    return {"documents": docs, "references": chased, "conflicts": index_ops.conflicts(both), "context": context(both, 30)}


def search_policies(chunks: DataFrame, query: str, embedding: list[float], carriers: list[str] = (), n: int | None = None) -> DataFrame:
    """Carriers' hits with neighbours: carrier, chunk_id, section, page, expanded, pos; carriers in order of first hit."""
    where = vector.predicate(carrier=list(carriers))
    found = vector.semantic_search(chunks, query, embedding, n or result_count(len(carriers)), where, stop_words=fixed.STOP_WORDS_POLICIES)
    placed = found.withColumn("pos", F.row_number().over(Window.orderBy("final_score", "distance", "chunk_id")))
    wide = neighbours(placed, chunks)
    return wide.withColumn("carrier_pos", F.min("pos").over(Window.partitionBy("carrier")))


def policy_context(hits: DataFrame, chunks: DataFrame, limit: int = 18_000) -> dict:
    """What an answer about policies is written from: search_policies' hits in order of (carrier_pos, pos), then the pages
    that they refer to, added until more than `limit` characters are there."""
    head = F.format_string("--- %s | Section: %s | Page %d ---\n%s", "carrier", F.coalesce("section", F.lit("")), "page", "expanded")
    own = hits.select("carrier_pos", "pos", F.lit(0).alias("ord"), "carrier", F.lit(False).alias("is_reference"), head.alias("text"))
    refs = referenced_pages(hits, chunks).join(hits.select("chunk_id", "carrier_pos", "pos"), "chunk_id").groupBy("carrier", "ref_page").agg(F.min(F.struct("carrier_pos", "pos", "ord", "text")).alias("r"))
    refs = refs.select("r.carrier_pos", "r.pos", "r.ord", "carrier", F.lit(True).alias("is_reference"), "r.text")
    items = own.unionByName(refs).withColumn("n", F.row_number().over(Window.orderBy("is_reference", "carrier_pos", "pos", "ord", "carrier")))
    kept = within_budget(items.withColumns({"size": F.char_length("text"), "pos": F.col("n")}), limit).filter("not is_reference or before <= %d" % limit)
    every = items.filter("not is_reference").select("n", "carrier", "is_reference", "text").unionByName(kept.filter("is_reference").select("n", "carrier", "is_reference", "text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return {"items": every, "context": every.agg(F.array_join(lines, "\n").alias("context"))}


def listing_line(key: Column, neighborhood: Column, room_type: Column, price: Column, rating: Column, review: Column) -> Column:
    return F.format_string("- Listing %s in %s: %s at $%s (Rating: %s). Review: %s", key.cast("string"), neighborhood, room_type, price.cast("string"), rating.cast("string"), review)


def search_listings(listings: DataFrame, embedding: list[float], price_max: float | None = None, rating_min: float | None = None, k: int = 3) -> DataFrame:
    """The k listings nearest to a question among those that it allows, each as a line; the bounds are inclusive."""
    found = vector.top_k(listings, embedding, k, where=vector.predicate(price__lte=price_max, rating__gte=rating_min), key="id")
    line = listing_line(F.col("id"), F.col("neighborhood"), F.col("room_type"), F.col("price"), F.col("rating"), F.col("review_text"))
    return found.select("id", "distance", line.alias("line"))


def answer_listings(listings: DataFrame, query: str, embed, answer=None) -> dict:
    """The listings that a question is about, the context that they make, and what `answer` (question, context) says."""
    from ..functions import providers

    asked = providers.listing_filters(F.lit(query))
    price, rating = listings.sparkSession.range(1).select(asked.alias("f")).select("f.price_max", "f.rating_min").first()
    rows = search_listings(listings, embed(query), price, rating)
    lines = [r["line"] for r in rows.collect()]  # at most k
    text = "\n".join(lines) if lines else fixed.NOTHING_FOUND["listings"]
    return {"listings": rows, "context": text, "answer": answer(query, text) if answer else None}
