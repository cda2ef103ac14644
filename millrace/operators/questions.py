"""Tables of questions: routing, retrieval, context, answers and verdicts of all of them in one plan.

A question becomes rows, one for each branch of its kind; branches that search are answered by one search of many queries
for each kind of predicate, branches that look up by joins with the index. All that follows, from removal of repeats to
the context, goes by question in windows and groups whose size the branches bound. So the plan does not grow with the
questions, and no question passes through the driver.

questions: question_id, query, embedding, query_type, rule_numbers, scenario and sub_queries, an array of
struct<query, embedding>. Nulls in the last four count as a concept without any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, models, text
from ..sources.shared import saved
from . import vector

_BRANCH = "array<struct<how:string,n:int,what:string,value:string,query:string,embedding:array<double>>>"
#: Columns that a branch may ask a value of.
ASKED_OF = ("scenario", "doc_type")


def branches(questions: DataFrame) -> DataFrame:
    """One row for each branch of each question, numbered from 0 in their order: how (search, lookup, each), n, what and
    value (a predicate, or null), query, embedding and rule_numbers."""
    kind, rules = F.coalesce("query_type", F.lit("concept")), F.coalesce("rule_numbers", F.array().cast("array<string>"))
    own = F.col("embedding").cast("array<double>")
    none = F.lit(None).cast("string")

    def branch(how: str, n: Column | int, what: str | None = None, value: Column = none, query: Column = F.col("query"), embedding: Column = own) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return F.struct(F.lit(how).alias("how"), n.cast("int").alias("n"), F.lit(what).cast("string").alias("what"), value.cast("string").alias("value"), query.alias("query"), embedding.alias("embedding"))

    numbered = F.size(rules) > 0
    two = F.when((kind == "direct_rule") & numbered, F.array(branch("lookup", 20), branch("search", 4)))
    two = two.when((kind == "scenario") & (F.coalesce("scenario", F.lit("")) != ""), F.array(branch("search", 10, "scenario", F.col("scenario")), branch("search", 4)))
    two = two.when((kind == "comparison") & numbered, F.array(branch("each", 10), branch("search", 4)))
    two = two.when(kind == "variant", F.array(branch("search", 6, "doc_type", F.lit("variant")), branch("search", 4)))
    two = two.otherwise(F.array(branch("search", F.when(kind == "situation", 10).otherwise(8))))
    first = F.transform(F.coalesce("sub_queries", F.array().cast("array<struct<query:string,embedding:array<double>>>")), lambda s: branch("search", 6, query=s["query"], embedding=s["embedding"].cast("array<double>")))
    every = F.concat(first.cast(_BRANCH), two.cast(_BRANCH))
    rows = questions.select("question_id", F.array_distinct(rules).alias("rule_numbers"), F.posexplode(every).alias("branch", "b"))
    return rows.select("question_id", "branch", "rule_numbers", "b.*")


def searched(chunks: DataFrame, asked: DataFrame, stop_words: list[str]) -> DataFrame:
    """question_id, branch, chunk_id, distance and pos of the searching branches: oversampled, then with the keyword bonus."""
    found = None
    for what in (None, *ASKED_OF):
        rows = asked.filter(F.col("what").isNull() if what is None else F.col("what") == what)
        queries = rows.select(F.struct("question_id", "branch").alias("query_id"), F.col("embedding").alias("query"), "value")
        near = vector.multi_top_k(chunks, queries, vector.oversampled(10), key="chunk_id", same=what and (what, "value"))
        found = near if found is None else found.unionByName(near)
    wide = found.select("query_id.*", "chunk_id", "distance", "rank").join(asked.select("question_id", "branch", "n", "query"), ["question_id", "branch"])
    wide = wide.filter(F.col("rank") <= F.floor(F.col("n") * F.lit(2.5))).join(chunks.select("chunk_id", "text"), "chunk_id")
    bonus = F.size(text.keywords_in(F.coalesce("text", F.lit("")), text.keywords(F.col("query"), stop_words))) * F.lit(fixed.KEYWORD_WEIGHT)
    order = Window.partitionBy("question_id", "branch").orderBy(F.round(F.col("distance") - bonus, 6), "distance", "chunk_id")
    return wide.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= F.col("n")).select("question_id", "branch", "chunk_id", "distance", "pos")


def looked_up(index: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, branch, chunk_id, pos of the branches that look rules up: each chunk once, in order of (rule, rank).
    A rule gives its first entries only: n for `each`; for `lookup`, which takes n chunks of all rules, n more than the
    rules before it could have given, so a hot rule's entries are cut before they are joined."""
    wanted = asked.select("question_id", "branch", "how", "n", F.posexplode("rule_numbers").alias("ord", "rule"))
    most = F.when(F.col("how") == "each", F.col("n")).otherwise(F.col("n") * (F.col("ord") + 1))
    rows = wanted.withColumn("most", most).join(index.select("rule", "rank", "chunk_id"), "rule").filter(F.col("rank") <= F.col("most"))
    first = rows.groupBy("question_id", "branch", "how", "n", "chunk_id").agg(F.min(F.struct("ord", "rank")).alias("at"))
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("question_id", "branch").orderBy("at", "chunk_id")))
    return placed.filter((F.col("how") == "each") | (F.col("pos") <= F.col("n"))).select("question_id", "branch", "chunk_id", F.lit(None).cast("double").alias("distance"), "pos")


def route(chunks: DataFrame, index: DataFrame, questions: DataFrame, stop_words: list[str] = fixed.STOP_WORDS_RULES) -> DataFrame:
    """The hits of all branches of all questions: question_id, the chunk's columns, distance (null for looked-up rows) and
    pos, in the branches' order."""
    asked = saved(branches(questions))
    hits = searched(chunks, asked.filter("how = 'search'"), stop_words).unionByName(looked_up(index, asked.filter("how <> 'search'")))
    placed = hits.select("question_id", "chunk_id", "distance", (F.col("pos") + 1000 * F.col("branch")).alias("pos"))
    return placed.join(chunks, "chunk_id").select("question_id", *chunks.columns, "distance", "pos")


def _numbered(rows: DataFrame, *order, to: str = "pos") -> DataFrame:
    return rows.withColumn(to, F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))


def documents(hits: DataFrame, preset: str = "rules", prefix: int = 200) -> DataFrame:
    """Each question's hits without repeats, in order: by distance and priority (`rules`), or by priority, 12 at most
    (`profile`)."""
    start = F.substring("text", 1, prefix if preset == "rules" else 100)
    once = hits.withColumn("__n", F.row_number().over(Window.partitionBy("question_id", start).orderBy("pos"))).filter("__n = 1").drop("__n")
    authority = F.coalesce("priority", F.lit(fixed.DEFAULT_PRIORITY))
    if preset != "rules":
        return _numbered(once, authority, "pos").filter(F.col("pos") <= 12)
    return _numbered(once, F.round(F.coalesce("distance", F.lit(fixed.DEFAULT_DISTANCE)) + fixed.PRIORITY_WEIGHT * authority, 6), "pos")


def references(docs: DataFrame, chunks: DataFrame, index: DataFrame, preset: str = "rules", pattern: str = fixed.CHASED_REFERENCE, most: int = 5) -> DataFrame:
    """The chunks that each question's documents refer to, one hop: of the first `most` rules the first entry, of rules that
    no document is about; by `profile` of the first 10 documents' rules two entries, 4 in all. pos from 10,001."""
    own = docs if preset == "rules" else docs.filter(F.col("pos") <= 10)
    refs = own.select("question_id", "pos", F.posexplode(text.cross_references(F.col("text"), pattern)).alias("at", "ref")).groupBy("question_id", "ref").agg(F.min(F.struct("pos", "at")).alias("first"))
    if preset == "rules":
        refs = refs.join(docs.select("question_id", F.regexp_extract("text", fixed.RULE_TAG, 1).alias("ref")), ["question_id", "ref"], "left_anti")
    few = _numbered(refs, "first", "ref", to="n").filter(F.col("n") <= most)
    entries = index.filter(F.col("rank") <= (1 if preset == "rules" else 2)).select(F.col("rule").alias("ref"), "rank", "chunk_id")
    found = few.join(entries, "ref").select("question_id", "chunk_id", "ref", F.struct("first", "rank").alias("__at")).join(chunks, "chunk_id")
    placed = _numbered(found, "__at", "chunk_id", "ref").withColumn("pos", F.col("pos") + 10_000).drop("__at", "ref")
    return placed if preset == "rules" else placed.filter(F.col("pos") <= 10_004)


def conflicts(docs: DataFrame) -> DataFrame:
    """For each question the rules that its documents of different types are about, with the type that counts and a note."""
    entry = F.struct(F.coalesce("priority", F.lit(9)).alias("priority"), "pos", F.coalesce("doc_type", F.lit("")).alias("doc_type"))
    by_rule = docs.filter(F.coalesce("rule_number", F.lit("")) != "").groupBy("question_id", "rule_number").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count_distinct("doc_type").alias("types")).filter("types > 1")
    first, rest = F.element_at("e", 1), F.array_join(F.transform(F.slice("e", 2, F.size("e")), lambda x: x["doc_type"]), ", ")
    note = F.format_string("CONFLICT ON RULE %s: Multiple sources found. The authoritative version is from '%s' (priority %d). Other versions from: %s.", "rule_number", first["doc_type"], first["priority"], rest)
    return by_rule.select("question_id", "rule_number", first["doc_type"].alias("doc_type"), first["priority"].alias("priority"), rest.alias("others"), note.alias("note"))


def contexts(docs: DataFrame, limit: int = 30) -> DataFrame:
    """question_id and context: the first documents by pos under headings, set apart by rules."""
    head = F.concat_ws(" | ", F.concat(F.lit("Source: "), "source_file"), F.concat(F.lit("Type: "), "doc_type"), F.concat(F.lit("Rule: "), "rule_number"), F.concat(F.lit("Page: "), F.col("page").cast("string")))
    few = _numbered(docs, "pos", "chunk_id", to="n").filter(F.col("n") <= limit).select("question_id", "n", F.concat(F.lit("["), head, F.lit("]\n"), "text").alias("block"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])
    return few.groupBy("question_id").agg(F.array_join(lines, "\n---\n").alias("context"))


def retrieved(chunks: DataFrame, index: DataFrame, questions: DataFrame, preset: str = "rules") -> dict[str, DataFrame]:
    """documents, references, conflicts and contexts of all questions; the documents and references are stored once."""
    docs = saved(documents(route(chunks, index, questions), preset))
    chased = saved(references(docs, chunks, index, preset))
    columns = ["question_id", *chunks.columns, "pos"]
    both = docs.select(columns).unionByName(chased.select(columns))
    return {"documents": docs, "references": chased, "conflicts": conflicts(both), "contexts": contexts(both)}


def answered(questions: DataFrame, found: dict[str, DataFrame], replies, model: models.Model, judge: models.Model, collection: str = "the documents") -> DataFrame:
    """question_id, query, context, answer, what went wrong with it, and a verdict for each aspect. Replies are taken from
    and kept in a store of replies; questions without a context are told so without a model."""
    asked = questions.select("question_id", "query").join(found["contexts"], "question_id", "left")
    prompt = F.when(F.col("context").isNotNull(), models.answer_prompt(collection, F.col("query"), F.col("context")))
    said = replies.asked(asked, prompt, model, to="answer", error="answer_error")
    said = said.withColumn("answer", F.when(F.col("context").isNull(), fixed.NOTHING_FOUND["rules"]).otherwise(F.col("answer")))
    check = F.when(F.col("context").isNotNull() & F.col("answer").isNotNull(), models.judge_prompt(F.col("query"), F.col("answer"), F.col("context")))
    judged = replies.asked(said, check, judge, to="said", error="verdict_error")
    return judged.select("question_id", "query", "context", "answer", "answer_error", models.verdicts(F.col("said")).alias("verdicts"), "verdict_error")
