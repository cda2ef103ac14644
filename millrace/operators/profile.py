"""Inference of a corpus's schema: votes over pattern tables, first-match classifiers, caps and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def vote(samples: DataFrame, patterns: list[tuple[str, str]], flags: str = "(?m)") -> DataFrame:
    """name, ord and hits of each pattern over samples (text); the first row by (hits desc, ord) wins. One pass: each
    pattern is a column of the same aggregate."""
    sums = samples.agg(*(F.coalesce(F.sum(F.regexp_count("text", F.lit(flags + p))), F.lit(0)).alias(f"c{k}") for k, (_, p) in enumerate(patterns)))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("ord"), F.col(f"c{k}").cast("bigint").alias("hits")) for k, (n, _) in enumerate(patterns)))
    return sums.select(F.inline(rows))


def rule_schema(samples: DataFrame) -> DataFrame:
    return vote(samples, [(n, p) for n, p, _ in fixed.RULE_SCHEMAS])


def scenario_format(samples: DataFrame) -> DataFrame:
    """With the confidence: a format's share of all hits."""
    found = vote(samples, fixed.SCENARIO_FORMATS, "(?im)")
    total = found.agg(F.greatest(F.sum("hits"), F.lit(1)).alias("total"))
    return found.join(F.broadcast(total)).select("name", "ord", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("confidence"))


def by_file_name(name: Column) -> Column:
    """(doc_type, priority) by the name in lower case without its ending."""
    return text.first_match(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), fixed.FILE_NAME_RULES)


def by_content(title: Column) -> Column:
    return text.first_match(F.lower(title), fixed.CONTENT_RULES)


def classified(files: DataFrame, model: Column | None = None) -> DataFrame:
    """files (source_file, title) with doc_type, priority, description and edition: by name, by content, by what a model
    says (a struct of doc_type and priority, null if it can't tell), or unknown."""
    both = F.coalesce(by_file_name(F.col("source_file")), by_content(F.coalesce("title", F.lit(""))), *([] if model is None else [model]))
    kind = F.coalesce(both["doc_type"], F.lit("unknown"))
    stem = F.regexp_replace(F.lower("source_file"), r"\.[a-z0-9]+$", "")
    defaults = F.create_map(*(F.lit(x) for p in fixed.PRIORITIES.items() for x in p))
    return files.withColumns({"doc_type": kind, "priority": F.coalesce(both["priority"], defaults[kind], F.lit(9)), "description": F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" document")), "edition": F.coalesce(text.edition(stem), text.edition(F.lower("title"), "edition|ed"))})


def page_cap(size_mb: Column, doc_type: Column) -> Column:
    """Pages to read at most: 0 leaves the file out, null means all."""
    return (
        F.when((size_mb > 50) & doc_type.isin("core_rules_v1", "journal", "unknown"), 0)
        .when((size_mb > 100) & (doc_type == "core_rules"), 200)
        .when((size_mb > 15) & (doc_type == "scenarios"), 80)
        .when((size_mb > 15) & doc_type.isin("journal", "version_tracker", "supplement"), 50)
    )


def known_documents(files: DataFrame) -> DataFrame:
    """files (source_file) with doc_type, priority and description from the fixed table, null for others."""
    table = files.sparkSession.createDataFrame(fixed.DOCUMENTS, "source_file string, doc_type string, priority int, description string")
    return files.join(F.broadcast(table), "source_file", "left")


def sampled_pages(pages: DataFrame, numbers: list[int] | None = None, most: int = 2000) -> DataFrame:
    """Of each file's pages (source_file, page from 1, text): those of the given numbers, else the first four, the 11th or
    the last, and those after a quarter and a half of all; their texts cut to `most` characters."""
    n = F.col("n")
    at = [F.lit(k) for k in numbers] if numbers is not None else [*(F.lit(k) for k in (1, 2, 3, 4)), F.least(F.lit(11), n), F.floor(n / 4) + 1, F.floor(n / 2) + 1]
    last = pages.groupBy("source_file").agg(F.max("page").alias("n"))
    spots = last.select("source_file", F.explode(F.array_distinct(F.array(*(k.cast("int") for k in at)))).alias("page"))
    text_ = F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, most)
    return pages.join(spots, ["source_file", "page"], "left_semi").select("source_file", "page", text_.alias("text"))


def titles(pages: DataFrame, least: int = 50, most: int = 1500) -> DataFrame:
    """source_file and title: the beginning of the first page with more than `least` characters."""
    return pages.filter(F.char_length("text") > least).groupBy("source_file").agg(F.substring(F.min_by("text", "page"), 1, most).alias("title"))


def carrier(file_name: Column) -> Column:
    names = F.create_map(*(F.lit(x) for p in fixed.CARRIERS.items() for x in p))
    return F.coalesce(names[file_name], F.upper(F.regexp_replace(file_name, r"\.pdf$", "")))


def patched(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """The catalog (source_file, doc_type, priority, description) with what overrides has for files that are there."""
    new = overrides.select("source_file", *(F.col(c).alias(f"__{c}") for c in ("doc_type", "priority", "description")))
    joined = catalog.join(new, "source_file", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in ("doc_type", "priority", "description")}).select(catalog.columns)


def discovered(pages: DataFrame, game_name: str, sizes: DataFrame | None = None, model: Column | None = None, keep=None) -> dict:
    """A profile from pages (source_file, page, text) and sizes (source_file, size_mb): schema, scenario format, catalog
    and glossary candidates, of which `keep` (a list of them) may choose."""
    samples, last = sampled_pages(pages), pages.select("source_file").distinct()
    votes = rule_schema(samples).orderBy(F.desc("hits"), "ord").collect()  # one row for each schema
    schema, named = votes[0]["name"], {n: (p, x) for n, p, x in fixed.RULE_SCHEMAS}
    scenario = scenario_format(samples).orderBy(F.desc("hits"), "ord").first()
    catalog = classified(last.join(titles(pages), "source_file", "left"), model)
    if sizes is not None:
        catalog = catalog.join(sizes, "source_file", "left").withColumn("max_pages", page_cap(F.col("size_mb"), F.col("doc_type")))
    candidates = pages.select(F.explode(text.acronyms(F.col("text"))).alias("candidate")).distinct()
    game_id = pages.sparkSession.range(1).select(text.slug(F.lit(game_name)).alias("s")).first()["s"]
    return {"game_name": game_name, "game_id": game_id, "rule_schema": schema, "rule_pattern": named[schema][0], "cross_ref_pattern": named[schema][1], "scenario_format": scenario["name"], "scenario_confidence": scenario["confidence"], "schema_detection_scores": {r["name"]: r["hits"] for r in votes}, "catalog": catalog, "glossary_candidates": candidates if keep is None else keep(candidates)}


def profile_row(found: dict) -> DataFrame:
    """The profile as one row, its documents and glossary as arrays: what a corpus has of both is small, and it is written
    as one JSON object."""
    documents = found["catalog"].agg(F.array_sort(F.collect_list(F.struct("source_file", "doc_type", "priority", "description"))).alias("documents"))
    glossary = found["glossary_candidates"].agg(F.array_sort(F.collect_list("candidate")).alias("glossary"))
    plain = {k: v for k, v in found.items() if isinstance(v, (str, float, int))}
    scores = F.create_map(*(F.lit(x) for p in found["schema_detection_scores"].items() for x in p))
    return documents.join(glossary).select(*(F.lit(v).alias(k) for k, v in plain.items()), scores.alias("schema_detection_scores"), "documents", "glossary")
