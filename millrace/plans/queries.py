"""Queries over the test tables, each with the SQL that gives the same rows where SQL can express it.

The prose of the tables has hardly any rule numbers, so rule queries make their corpus from columns of `part`, the same in
both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, providers, text
from ..operators import chunking, evaluation, layout, profile, retrieval, rule_index, vector
from ..sources import collections, tables
from ..sources.shared import fresh_path
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT c_mktsegment AS segment, round(avg(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS avg_price, round(avg(c_acctbal), 2) AS avg_balance, count(o_orderkey) AS orders
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY avg_balance DESC, segment LIMIT 5""")
def segment_avg_topk(spark, d):
    rows = read(spark, d, "orders").filter("o_orderstatus = 'F'").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("avg_price"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance"), F.count("o_orderkey").alias("orders"))
    return found.orderBy(F.desc("avg_balance"), "segment").limit(5)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000 AND n_chars <= 3000")
def doc_filter_numeric(spark, d):
    return read(spark, d, "documents").filter(vector.predicate(n_chars__gte=1000, n_chars__lte=3000)).select("doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4')")
def doc_filter_in(spark, d):
    return read(spark, d, "documents").filter(vector.predicate(source=["src1", "src4"])).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND n_chars <= 2000 AND source = 'src3'")
def doc_filter_and(spark, d):
    return read(spark, d, "documents").filter(vector.predicate(lang="fr", n_chars__lte=2000, source=["src3"], doc_id=None)).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 50")
def doc_min_text(spark, d):
    return read(spark, d, "documents").filter(F.char_length(text.strip(F.col("text"))) >= 50).select("doc_id")


def vector_of(spark, d, vec_id: int) -> list[float]:
    return read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


_SCORED = "SELECT vec_id, label, round({}(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS distance FROM embeddings"


@query(_SCORED.format("list_cosine_distance") + " ORDER BY distance, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return vector.top_k(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10).select("vec_id", "label", "distance")


@query(_SCORED.format("list_cosine_distance") + " WHERE label = 1 OR label = 2 ORDER BY distance, vec_id LIMIT 10")
def cosine_topk_filtered(spark, d):
    return vector.top_k(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10, where=vector.predicate(label=[1, 2])).select("vec_id", "label", "distance")


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) * (embedding[i]::DOUBLE - q[i]::DOUBLE))), 6) AS distance
          FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY distance, vec_id LIMIT 10""")
def l2_topk(spark, d):
    return vector.top_k(read(spark, d, "embeddings"), vector_of(spark, d, 0), 10, metric="l2").select("vec_id", "distance")


@query("""SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM
          (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 6""")
def multi_query_topk(spark, d):
    own = read(spark, d, "embeddings")
    return vector.multi_top_k(own, own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 6)


@query(f"""WITH t AS (SELECT vec_id, text, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 6) AS distance FROM embeddings JOIN documents ON vec_id = doc_id ORDER BY distance, vec_id LIMIT 20),
          b AS (SELECT *, round(0.12 * len(list_filter(['combat', 'thing', 'inea'], lambda k: contains(lower(text), k))), 6) AS boost FROM t)
          SELECT vec_id, distance, boost, round(distance - boost, 6) AS final_score FROM b ORDER BY final_score, distance, vec_id LIMIT 8""")
def oversample_boost_topk(spark, d):
    rows = read(spark, d, "embeddings").join(read(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    found = vector.top_k(rows, vector_of(spark, d, 3), vector.oversampled(8))
    return vector.boosted(found, F.lit("Combat the thing, under inea?"), 8).select("vec_id", "distance", "boost", "final_score")


@query("""SELECT vec_id, label AS priority, round(coalesce(CASE WHEN vec_id % 3 > 0 THEN x END, 0.5) + 0.05 * label, 6) AS combined FROM
          (SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 6) AS x FROM embeddings) ORDER BY combined, vec_id LIMIT 25""")
def priority_rerank(spark, d):
    q = F.lit(list(map(float, vector_of(spark, d, 1))))
    rows = read(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("pos"), F.col("label").alias("priority"), F.when(F.col("vec_id") % 3 > 0, F.round(vector.cosine_distance(F.col("embedding"), q), 6)).alias("distance"))
    return retrieval.priority_rerank(rows).limit(25).select("vec_id", "priority", "combined")


_DEDUPE = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substring(text, 1, {}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1"


@query(_DEDUPE.format(200))
def prefix_dedupe_200(spark, d):
    return retrieval.without_repeats(read(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("pos")), 200).select("doc_id")


@query(_DEDUPE.format(100))
def prefix_dedupe_100(spark, d):
    return retrieval.without_repeats(read(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("pos")), 100).select("doc_id")


_RULES = r"""r AS (SELECT p_partkey, concat(CAST(1 + p_partkey % 29 AS VARCHAR), '.', CAST(p_partkey % 90 + 1 AS VARCHAR), ' ', upper(p_name), chr(10), 'see ', CAST(1 + p_partkey % 7 AS VARCHAR), '.', CAST(p_partkey % 11 + 1 AS VARCHAR), ' or [', CAST(1 + p_partkey % 5 AS VARCHAR), '.', CAST(p_partkey % 13 + 1 AS VARCHAR), ']', CASE WHEN p_partkey % 4 = 0 THEN concat(chr(10), 'Q. ', p_name) WHEN p_partkey % 9 = 0 THEN concat(chr(10), 'VARIANT: ', p_name) ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN concat(chr(10), 'Scenario ', chr(CAST(65 + p_partkey % 11 AS INTEGER))) ELSE '' END) AS text FROM part)"""


def rules(spark, d) -> DataFrame:
    """A corpus of rules: p_partkey and text."""
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    body = F.concat(s(1 + k % 29), F.lit("."), s(k % 90 + 1), F.lit(" "), F.upper("p_name"), F.lit("\nsee "), s(1 + k % 7), F.lit("."), s(k % 11 + 1), F.lit(" or ["), s(1 + k % 5), F.lit("."), s(k % 13 + 1), F.lit("]"))
    body = F.concat(body, F.when(k % 4 == 0, F.concat(F.lit("\nQ. "), "p_name")).when(k % 9 == 0, F.concat(F.lit("\nVARIANT: "), "p_name")).otherwise(""))
    body = F.concat(body, F.when(k % 6 == 0, F.concat(F.lit("\nScenario "), F.char(65 + k % 11))).otherwise(""))
    return read(spark, d, "part").select("p_partkey", body.alias("text"))


@query(f"WITH {_RULES} SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS rules FROM (SELECT p_partkey, regexp_extract_all(text, '(?m)(?:^|\\n)\\s*(\\d{{1,2}}\\.\\d{{1,3}}(?:\\.\\d{{1,2}})?)\\b', 1) AS list_distinct_in_order FROM r)")
def rule_extract(spark, d):
    return rules(spark, d).select("p_partkey", F.array_join(text.rule_numbers(F.col("text")), ",").alias("rules"))


@query(rf"""WITH {_RULES}, x AS (SELECT p_partkey, list_concat(regexp_extract_all(text, '\[(\d+\.\d+)\]', 1), regexp_extract_all(text, 'see (\d+\.\d+)', 1)) AS l FROM r)
           SELECT p_partkey, array_to_string(list_sort(list_distinct(l)), ',') AS refs FROM x""")
def xref_extract(spark, d):
    return rules(spark, d).select("p_partkey", F.array_join(F.array_sort(text.cross_references(F.col("text"))), ",").alias("refs"))


_TYPED = "CASE p_partkey % 7 WHEN 0 THEN concat(p_name, chr(10), ' Q. why?') WHEN 1 THEN concat('Clarification: no', chr(10), 'CLARIFICATION: yes, a variant: too') WHEN 2 THEN concat('A. so', chr(10), 'VARIANT: b') WHEN 3 THEN concat('B. ', p_name) WHEN 4 THEN concat('a VARIANT: ', p_name) WHEN 5 THEN concat('Z: ', p_name) ELSE p_name END"


@query(rf"""WITH t AS (SELECT p_partkey, {_TYPED} AS text FROM part), q AS (SELECT *, regexp_matches(text, '(?m)(?:^|\n)\s*(?:Q\.|A\.|CLARIFICATION:|VARIANT:)') AS question FROM t)
          SELECT p_partkey, CASE WHEN question AND contains(upper(text), 'CLARIFICATION:') THEN 'clarification' WHEN question AND contains(upper(text), 'VARIANT:') THEN 'variant' WHEN question THEN 'qa' WHEN regexp_matches(text, '^\s*[A-K][.:]\s+') THEN 'scenario_rule' ELSE 'rule' END AS content_type FROM q""")
def content_type(spark, d):
    return read(spark, d, "part").select("p_partkey", text.content_type(F.expr(_TYPED)).alias("content_type"))


@query(rf"WITH {_RULES} SELECT p_partkey, nullif(regexp_extract(text, 'Scenario ([A-K])', 1), '') AS scenario FROM r")
def scenario_detect(spark, d):
    return rules(spark, d).select("p_partkey", F.array_join(text.scenarios(F.col("text")), ",").alias("scenario"))


_SPACED = "CASE p_partkey % 6 WHEN 0 THEN 'M O V E S  A N D   F I R E' WHEN 1 THEN 'A  B  C' WHEN 2 THEN 'A b  C' WHEN 3 THEN '  A  B' WHEN 4 THEN concat('F I R E', chr(10), p_name, chr(10), 'X') ELSE p_name END"


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'MOVES AND FIRE' WHEN 1 THEN 'A B C' WHEN 2 THEN 'A b  C' WHEN 3 THEN '  A  B' WHEN 4 THEN concat('FIRE', chr(10), p_name, chr(10), 'X') ELSE p_name END AS once, CASE p_partkey % 6 WHEN 0 THEN 'MOVES AND FIRE' WHEN 1 THEN 'ABC' WHEN 2 THEN 'A b  C' WHEN 3 THEN '  A  B' WHEN 4 THEN concat('FIRE', chr(10), p_name, chr(10), 'X') ELSE p_name END AS twice FROM part")
def ocr_collapse(spark, d):
    once = text.collapse_spaced_letters(F.expr(_SPACED))
    return read(spark, d, "part").select("p_partkey", once.alias("once"), text.collapse_spaced_letters(once).alias("twice"))


_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS_RULES)


@query(f"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS kept FROM benchmark")
def keyword_extract(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(text.keywords(F.col("text")), " ").alias("kept"))


@query("SELECT doc_id, len(list_filter(['thing', 'eau', 'sch', 'ción'], lambda k: contains(lower(text), k))) AS hits FROM documents")
def keyword_hits(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.keywords_in(F.col("text"), F.array(*map(F.lit, ["Thing", "eau", "SCH", "ción"])), ignore_case=True)).cast("bigint").alias("hits"))


@query("SELECT DISTINCT concat(upper(substring(p_name, 1, 3)), ': Big Thing ', upper(substring(p_name, 1, 1)), 'x', p_partkey % 4) AS candidate FROM part")
def acronym_candidates(spark, d):
    """All four forms of definition; a number tells them apart."""
    short, long = F.upper(F.substring("p_name", 1, 3)), F.concat(F.lit("Big Thing "), F.upper(F.substring("p_name", 1, 1)), F.lit("x"))
    forms = F.array(F.concat(long, F.lit(" ("), short, F.lit(")")), F.concat(short, F.lit(" ("), long, F.lit(")")), F.concat(long, F.lit(" ["), short, F.lit("]")), F.concat(F.lit("see "), short, F.lit(": "), long))
    form = F.col("p_partkey") % 4
    found = read(spark, d, "part").select(form.alias("form"), F.explode(text.acronyms(F.get(forms, form.cast("int")))).alias("c"))
    return found.select(F.concat("c", F.col("form").cast("string")).alias("candidate")).distinct()


@query(rf"""WITH {_RULES} SELECT 'chapter_decimal' AS name, 0 AS ord, CAST(coalesce(sum(len(regexp_extract_all(text, '(?m)(?:^|\s)([A-Z]\d{{1,2}}\.\d{{1,4}})\b'))), 0) AS BIGINT) AS hits FROM r
           UNION ALL SELECT 'numeric_decimal', 1, CAST(coalesce(sum(len(regexp_extract_all(text, '(?m)(?:^|\n)\s*(\d{{1,2}}\.\d{{1,3}}(?:\.\d{{1,2}})?)\b'))), 0) AS BIGINT) FROM r
           UNION ALL SELECT 'outline_parenthetical', 2, CAST(coalesce(sum(len(regexp_extract_all(text, '\(([A-Z]\d{{1,2}}\.\d{{1,3}})\)'))), 0) AS BIGINT) FROM r
           UNION ALL SELECT 'keyword_header', 3, CAST(coalesce(sum(len(regexp_extract_all(text, '(?m)(?:^|\n)([A-Z\s]{{4,}})\n'))), 0) AS BIGINT) FROM r""")
def schema_vote(spark, d):
    return profile.rule_schema(rules(spark, d))


@query(rf"""WITH {_RULES}, n AS (SELECT sum(len(regexp_extract_all(text, '(?im)Scenario\s+[A-K]\b|^[A-K][.:]\s+[A-Z]'))) AS a, sum(len(regexp_extract_all(text, '(?im)ASL\s+\d+|Scenario\s+\d+|^(?:Scenario\s+)?\d+[.:]'))) AS b, sum(len(regexp_extract_all(text, '(?im)SCENARIO\s+DESIGN|Special\s+Scenario\s+Rules|SSR'))) AS c FROM r)
           SELECT name, ord, CAST(hits AS BIGINT) AS hits, round(hits / greatest(a + b + c, 1), 6) AS confidence FROM (SELECT 'letter' AS name, 0 AS ord, a AS hits, a, b, c FROM n UNION ALL SELECT 'numeric', 1, b, a, b, c FROM n UNION ALL SELECT 'named', 2, c, a, b, c FROM n)""")
def scenario_vote(spark, d):
    return profile.scenario_format(rules(spark, d))


_NAME = "CASE p_partkey % 7 WHEN 0 THEN 'Rules_Errata.pdf' WHEN 1 THEN 'Game Journal 5.pdf' WHEN 2 THEN 'codex.pdf' WHEN 3 THEN 'ScenarioB.pdf' WHEN 4 THEN '2nd_Edition.pdf' WHEN 5 THEN 'plain.pdf' ELSE 'tables 9e.pdf' END"


def files(spark, d) -> DataFrame:
    name = F.expr(_NAME)
    title = F.when(F.col("p_partkey") % 7 == 5, "The Published Errata, 3rd edition").otherwise("nothing")
    return read(spark, d, "part").select("p_partkey", name.alias("source_file"), title.alias("title"))


def first_rule(name: str, title: str, what: int) -> str:
    """The type (1) or priority (2) by the first rule that a name, or else a title, meets."""
    cases = [(name, r) for r in fixed.FILE_NAME_RULES] + [(title, r) for r in fixed.CONTENT_RULES]
    return "CASE " + " ".join(f"WHEN regexp_matches({text_}, '{r[0]}') THEN " + (f"'{r[1]}'" if what == 1 else str(r[2])) for text_, r in cases) + f" ELSE {chr(39) + 'unknown' + chr(39) if what == 1 else 9} END"


@query(rf"""WITH f AS (SELECT p_partkey, regexp_replace(lower({_NAME}), '\.[a-z0-9]+$', '') AS name, CASE WHEN p_partkey % 7 = 5 THEN 'the published errata, 3rd edition' ELSE 'nothing' END AS title FROM part)
           SELECT p_partkey, {first_rule('name', 'title', 1)} AS doc_type, CAST({first_rule('name', 'title', 2)} AS INTEGER) AS priority,
           CAST(coalesce(nullif(regexp_extract(name, '(\d+)(?:st|nd|rd|th|e)?\s*(?:edition|ed|e\b)', 1), ''), nullif(regexp_extract(title, '(\d+)(?:st|nd|rd|th|e)?\s*(?:edition|ed)', 1), '')) AS INTEGER) AS edition FROM f""")
def file_classify(spark, d):
    return profile.classified(files(spark, d)).select("p_partkey", "doc_type", "priority", "edition")


@query("SELECT p_partkey, CASE WHEN 2 * p_size > 50 AND p_brand LIKE '%1%' THEN 0 WHEN 2 * p_size > 15 AND p_brand LIKE '%2%' AND p_brand NOT LIKE '%1%' THEN 80 END AS max_pages FROM part")
def page_cap(spark, d):
    kind = F.when(F.col("p_brand").contains("1"), "journal_").when(F.col("p_brand").contains("2"), "scenarios").otherwise("qa")
    kind = F.when((kind == "journal_") & (F.col("p_size") > 25), "journal").otherwise(kind)
    return read(spark, d, "part").select("p_partkey", profile.page_cap(2 * F.col("p_size"), kind).alias("max_pages"))


@query(r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def line_explode(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("source_file"), "text")
    return tables.lines(docs).select(F.col("source_file").alias("doc_id"), "line_no", "line")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN turn * 10 END AS mark FROM conversations)
          SELECT conv_id, turn, CAST(coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS page FROM m""")
def page_carry(spark, d):
    marker = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("--- PAGE "), (F.col("turn") * 10).cast("string"), F.lit(" ---\n"))).otherwise("")
    one = F.concat(marker, F.lit("turn "), F.col("turn").cast("string"))
    docs = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return tables.lines(docs.withColumnRenamed("conv_id", "source_file")).select(F.col("source_file").alias("conv_id"), F.expr("cast(substring(line, 6) as bigint)").alias("turn"), "page")


#: A rule of a book with the page marker or section header before it, and a long stretch after one of them.
_LINE = "concat(CASE WHEN p_partkey % 10 = 0 THEN concat('--- PAGE ', CAST(CAST(floor(p_partkey % 40 / 10) AS INT) + 2 AS STRING), ' ---', chr(10)) ELSE '' END, CASE WHEN p_partkey % 20 = 5 THEN concat(CAST(p_partkey % 29 AS STRING), '. MOVES AND FIRE', chr(10)) WHEN p_partkey % 20 = 9 THEN concat(CASE WHEN p_partkey % 40 = 9 THEN 'B. The farm' ELSE 'C: The mill' END, chr(10)) ELSE '' END, text, CASE WHEN p_partkey % 40 = 31 THEN concat(repeat(concat(chr(10), 'a plain line of some words that says little'), 40), chr(10), chr(8226), '.....', chr(10), 'Q. Is it so?', repeat(concat(chr(10), 'another plain line that says as much'), 75)) ELSE '' END)"
_KINDS = ["integrated_rules", "core_rules", "errata", "scenarios", "primer"]


def books(spark, d) -> DataFrame:
    """Rule books: the rules of 40 parts each, on pages of 10, of five types."""
    book = F.floor(F.col("p_partkey") / 40)
    rows = rules(spark, d).withColumn("text", F.expr(_LINE.replace("chr(8226)", "'\u2022'"))).groupBy(book.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n").alias("text"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("b") % 5 + 1).cast("int"))
    return rows.select(F.concat(F.lit("book "), F.col("b").cast("string")).alias("source_file"), "text", kind.alias("doc_type"), (F.col("b") % 4 + 1).cast("int").alias("priority"))


BOOKS_SQL = f"""{_RULES}, books AS (SELECT concat('book ', p_partkey // 40) AS source_file, string_agg({_LINE}, chr(10) ORDER BY p_partkey) AS text, list_extract({_KINDS}, CAST(p_partkey // 40 % 5 + 1 AS INTEGER)) AS doc_type, CAST(p_partkey // 40 % 4 + 1 AS INTEGER) AS priority FROM r GROUP BY p_partkey // 40)"""


def chunks_of_books(spark, d) -> DataFrame:
    return chunking.built(chunking.folded(books(spark, d)))


@query(rf"""WITH {_RULES}, c AS (SELECT p_partkey, p_partkey % 4 + 1 AS priority, regexp_extract(text, '^(\d+\.\d+)', 1) AS own FROM r),
            e AS (SELECT own AS rule, p_partkey, priority, false AS secondary FROM c UNION ALL SELECT concat(CAST(1 + p_partkey % 29 AS VARCHAR), '.', CAST(p_partkey % 90 + 2 AS VARCHAR)), p_partkey, priority, true FROM c)
            SELECT rule, p_partkey AS chunk_id, secondary, CAST(row_number() OVER (PARTITION BY rule ORDER BY priority, p_partkey, secondary) AS INTEGER) AS rank FROM e""")
def rule_index_build(spark, d):
    return own_index(spark, d).select("rule", F.col("chunk_id").cast("bigint").alias("chunk_id"), "secondary", "rank")


def own_index(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    number = F.get(text.rule_numbers(F.col("text")), F.lit(0))
    other = F.concat((1 + k % 29).cast("string"), F.lit("."), (k % 90 + 2).cast("string"))
    rows = rules(spark, d).select(k.cast("string").alias("chunk_id"), number.alias("rule_number"), F.array(other, number).alias("all_rule_numbers"), F.lit("core_rules").alias("doc_type"), (k % 4 + 1).cast("int").alias("priority"), F.lit("f").alias("source_file"), F.lit("rule").alias("content_type"), k.alias("seq"))
    return rule_index.rule_index(rows)


@query(rf"""WITH {_RULES}, c AS (SELECT p_partkey, p_partkey % 4 + 1 AS priority, regexp_extract(text, '^(\d+\.\d+)', 1) AS own FROM r),
            e AS (SELECT own AS rule, p_partkey, priority, false AS secondary FROM c UNION ALL SELECT concat(CAST(1 + p_partkey % 29 AS VARCHAR), '.', CAST(p_partkey % 90 + 2 AS VARCHAR)), p_partkey, priority, true FROM c),
            i AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY priority, p_partkey, secondary) AS rank FROM e),
            w AS (SELECT * FROM (VALUES ('5.5', 0), ('3.3', 1), ('9.10', 2)) t(rule, ord)),
            f AS (SELECT p_partkey, min(ord * 1000000 + rank) AS spot FROM i JOIN w USING (rule) WHERE rank <= 10 GROUP BY 1)
            SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CAST(row_number() OVER (ORDER BY spot, CAST(p_partkey AS VARCHAR)) AS INTEGER) AS pos FROM f ORDER BY pos LIMIT 20""")
def rule_lookup(spark, d):
    wanted = spark.createDataFrame([("5.5", 0), ("3.3", 1), ("9.10", 2)], "rule string, ord int")
    return rule_index.lookup(own_index(spark, d), wanted, each=10, limit=20)


@query(rf"""WITH {_RULES}, c AS (SELECT p_partkey, p_partkey % 4 + 1 AS priority, regexp_extract(text, '^(\d+\.\d+)', 1) AS own FROM r),
            e AS (SELECT own AS rule, p_partkey, priority, false AS secondary FROM c UNION ALL SELECT concat(CAST(1 + p_partkey % 29 AS VARCHAR), '.', CAST(p_partkey % 90 + 2 AS VARCHAR)), p_partkey, priority, true FROM c),
            i AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY priority, p_partkey, secondary) AS rank FROM e),
            q AS (SELECT p_partkey, text FROM r),
            x AS (SELECT regexp_extract(text, '\[(\d+\.\d+)\]', 1) AS ref, p_partkey * 10 AS spot FROM q UNION ALL SELECT regexp_extract(text, 'see (\d+\.\d+)', 1), p_partkey * 10 + 1 FROM q),
            n AS (SELECT ref, min(spot) AS spot FROM x WHERE ref NOT IN ('1.10') GROUP BY ref ORDER BY spot, ref LIMIT 5)
            SELECT ref, CAST(p_partkey AS VARCHAR) AS chunk_id FROM n JOIN i ON i.rule = n.ref WHERE rank = 1""")
def xref_chase(spark, d):
    docs = rules(spark, d).select(F.concat(F.lit("[Rule: 1.10]\n"), "text").alias("text"), F.col("p_partkey").alias("pos"))
    return rule_index.chase(docs, own_index(spark, d), fixed.CHASED_REFERENCE, fixed.RULE_TAG).select("ref", "chunk_id")


@query("""WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS rule_number, CASE WHEN s_suppkey % 3 = 0 THEN 'errata' ELSE 'core_rules' END AS doc_type, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 1 END AS priority FROM supplier)
          SELECT rule_number, 'core_rules' AS doc_type, 1 AS priority, count(*) - 1 AS n_others FROM s GROUP BY 1 HAVING count(DISTINCT doc_type) > 1""")
def conflict_detect(spark, d):
    odd = F.col("s_suppkey") % 3 == 0
    docs = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("rule_number"), F.when(odd, "errata").otherwise("core_rules").alias("doc_type"), F.when(odd, 3).otherwise(1).alias("priority"), F.col("s_suppkey").alias("pos"))
    return rule_index.conflicts(docs).select("rule_number", "doc_type", "priority", F.size(F.split("others", ", ")).cast("bigint").alias("n_others"))


@query("""SELECT c.conv_id, c.turn, md5(concat_ws(chr(10), p.text, c.text, n.text)) AS expanded FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
          LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def neighbour_window(spark, d):
    rows = read(spark, d, "conversations").withColumn("chunk_id", F.concat_ws("_chunk_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return retrieval.neighbours(rows, rows).select("conv_id", "turn", F.md5("expanded").alias("expanded"))


_EVENTS = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {0}, event_id {0}) AS n FROM events) WHERE n = 1"


def keyed_events(spark, d) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))


@query(_EVENTS.format("DESC"))
def upsert_last_wins(spark, d):
    rows = keyed_events(spark, d)
    return tables.upserted(rows.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "o"), "o").alias("x")).select("user_id", "x.*"), rows, "user_id", "o").select("user_id", "event_id", "event_type")


@query(_EVENTS.format("ASC"))
def insert_keep_first(spark, d):
    rows = keyed_events(spark, d)
    return tables.inserted(rows.limit(0), rows, "user_id", "o").select("user_id", "event_id", "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    reply = F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))
    return read(spark, d, "events").select("event_id", F.get_json_object(text.json_object(reply), "$.k").cast("bigint").alias("k"))


@query("""SELECT coalesce(lang, 'OVERALL') AS category, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS perfect
          FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def eval_rollup(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").withColumnRenamed("lang", "category")
    return evaluation.by_category(rows, {"good": F.col("quality") == 1, "perfect": (F.col("toxic") == 0) & (F.col("quality") == 1)})


_GRADE = "CASE WHEN doc_id % 10 < 6 THEN 'EXACT' WHEN doc_id % 10 < 8 THEN 'FAITHFUL' WHEN quality = 1 THEN 'CITED' ELSE 'FAIL' END"


@query(f"""WITH g AS (SELECT source AS system, {_GRADE} AS grade FROM labels JOIN documents USING (doc_id)),
          c AS (SELECT coalesce(system, 'OVERALL') AS system, count(*) AS total, count(*) FILTER (WHERE grade = 'EXACT') AS "EXACT", count(*) FILTER (WHERE grade = 'FAITHFUL') AS "FAITHFUL", count(*) FILTER (WHERE grade = 'CITED') AS "CITED", count(*) FILTER (WHERE grade = 'FAIL') AS "FAIL" FROM g GROUP BY ROLLUP (system))
          SELECT *, round(100 * ("EXACT" + "FAITHFUL" + "CITED") / total, 4) AS pass_rate, round(100 * ("EXACT" + "FAITHFUL" + "CITED") / total, 4) >= 95 AS gate FROM c""")
def grade_pivot(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return evaluation.grades(rows.select(F.col("source").alias("system"), F.expr(_GRADE).alias("grade")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return evaluation.unfinished(read(spark, d, "documents").select(F.col("doc_id").alias("id")), read(spark, d, "labels").select(F.col("doc_id").alias("id")))


def spans(spark, d) -> DataFrame:
    """Layout spans: suppliers as texts on sheets of one nation."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 560).cast("double"), (20 + k * 13 % 240).cast("double")
    body = F.when(k % 3 == 0, (k % 90).cast("string")).when(k % 17 == 1, "Type: ship").otherwise(F.col("s_name"))
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), k.alias("seq"), body.alias("text"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 8).alias("y1"))


_SPANS = "s AS (SELECT s_nationkey AS doc, s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 90 AS VARCHAR) WHEN s_suppkey % 17 = 1 THEN 'Type: ship' ELSE s_name END AS text, CAST(s_suppkey * 37 % 560 AS DOUBLE) AS x0, CAST(20 + s_suppkey * 13 % 240 AS DOUBLE) AS y0, s_suppkey * 37 % 560 + 10 AS xc, 24 + s_suppkey * 13 % 240 AS yc FROM supplier WHERE 28 + s_suppkey * 13 % 240 < 265)"


@query(f"""WITH {_SPANS}, f AS (SELECT * FROM (VALUES ('Turret Armor', 60, 135), ('Stern Armor', 140, 215), ('Left Armor', 220, 295), ('Front Armor', 305, 380), ('Right Armor', 385, 460), ('Bottom Armor', 470, 545)) t(facing, a, b)),
          n AS (SELECT doc, facing, arg_min(CAST(text AS INTEGER), seq) AS sf FROM s JOIN f ON xc BETWEEN a AND b WHERE regexp_matches(text, '^[0-9]+$') AND y0 > 15 AND y0 < 35 GROUP BY 1, 2)
          SELECT d.doc, f.facing, coalesce(sf, 0) AS sf FROM (SELECT DISTINCT doc FROM s) d CROSS JOIN f LEFT JOIN n ON n.doc = d.doc AND n.facing = f.facing""")
def armour_range_join(spark, d):
    return layout.armour(layout.first_unit(spans(spark, d)))


@query(f"""WITH {_SPANS}, i AS (SELECT * FROM s WHERE yc > 115 AND yc < 200 AND NOT regexp_matches(text, '^[0-9]+$') AND xc BETWEEN 50 AND 140),
          c AS (SELECT doc, yc, seq, text, unnest(range(least(greatest(CAST(trunc((x0 - 60) / 7) AS BIGINT), 0), 9), greatest(least(CAST(trunc((x0 + 20 - 60) / 7) AS BIGINT), 9), least(greatest(CAST(trunc((x0 - 60) / 7) AS BIGINT), 0), 9)) + 1)) AS col FROM i),
          g AS (SELECT doc, col, count(*) AS n, string_agg(text, '|' ORDER BY yc, seq) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc, col ORDER BY yc, seq) AS k FROM c) WHERE k <= 10 GROUP BY 1, 2),
          e AS (SELECT doc, unnest(range(0, 10)) AS col FROM (SELECT DISTINCT doc FROM s))
          SELECT e.doc, CAST(e.col AS INTEGER) AS "column", concat(coalesce(t, ''), CASE WHEN n IS NULL OR n < 10 THEN concat(CASE WHEN n IS NULL THEN '' ELSE '|' END, array_to_string(list_transform(range(0, 10 - coalesce(n, 0)), lambda x: 'Empty'), '|')) ELSE '' END) AS cells
          FROM e LEFT JOIN g ON g.doc = e.doc AND g.col = e.col""")
def grid_fill(spark, d):
    name, a, b, width = fixed.GRIDS[0]
    return layout.grid(layout.first_unit(spans(spark, d)), a, b, width).withColumn("cells", F.array_join("cells", "|"))


@query("""SELECT s_suppkey, concat(s_name, ' is a ship unit.', chr(10), 'Attributes:', chr(10), '- Nation: ', s_nationkey, chr(10), 'Armor and Grids:', chr(10), '- Front has SF (Size Factor) ', s_suppkey % 9, '.', chr(10), '- Hull is 10 columns wide.', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('Weapons:', chr(10), '- Gun mounted on Unknown (Damage: 5, Range: N/A)', chr(10), '- Weapon mounted on Bow (Damage: N/A, Range: 3)', chr(10)) ELSE '' END, 'Missiles:', chr(10), '- ', s_suppkey % 4, 'x TVLG') AS text FROM supplier""")
def entity_render(spark, d):
    s = lambda c: F.col(c).cast("string")
    grids = F.create_map(F.lit("Front"), F.struct((F.col("s_suppkey") % 9).alias("SF"), F.lit(10).alias("Width")), F.lit("Hull"), F.struct(F.lit(None).cast("bigint").alias("SF"), F.lit(10).alias("Width")))
    kind = "array<struct<Name:string,Location:string,Damage:string,Range:string>>"
    guns = F.from_json(F.lit('[{"Name": "Gun", "Damage": "5"}, {"Location": "Bow", "Range": "3"}]'), kind)
    arms = F.when(F.col("s_suppkey") % 2 == 0, guns).otherwise(F.array().cast(kind))
    rockets = F.array(F.struct(F.lit("TVLG").alias("Type"), (F.col("s_suppkey") % 4).alias("Count")))
    return read(spark, d, "supplier").select("s_suppkey", layout.entity_text(F.col("s_name"), F.lit("ship"), F.create_map(F.lit("Nation"), s("s_nationkey")), grids, arms, rockets).alias("text"))


@query("SELECT order_key, price_max, rating_min FROM (SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 300 AS DOUBLE) END AS price_max, CASE WHEN o_orderkey % 3 = 0 THEN 4.5 END AS rating_min FROM orders)")
def listing_filters(spark, d):
    k = F.col("o_orderkey")
    asked = F.concat(F.lit("A place"), F.when(k % 2 == 0, F.concat(F.lit(" under $"), (k % 300).cast("string"))).otherwise(""), F.when(k % 3 == 0, " with a rating of at least 4.5").otherwise(""))
    return read(spark, d, "orders").select(k.alias("order_key"), providers.listing_filters(asked).alias("f")).select("order_key", "f.*")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return ingest.windowed_counts(read(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def answer_documents(spark, d):
    """The whole way from books to the documents of an answer, without a model, by way of a collection of chunks and one of
    the index, which further questions can read."""
    held = collections.Collections(spark, fresh_path(spark, "corpus"))
    chunks = held.recreate("chunks", providers.embedded(chunks_of_books(spark, d)))
    index = held.recreate("index", rule_index.rule_index(chunks))
    question = "What does rule 5.5 say about moves?"
    embed = lambda q: providers.HashingEmbedder()([q])[0].tolist()
    found = retrieval.answer_context(chunks, index, question, embed, providers.classified(question))
    return found["documents"].select("chunk_id", "rule_number", "pos")


_COPY = {
    "k": "p_partkey",
    "a": "concat('--- PAGE 1 ---', chr(10), repeat(concat(p_name, ' and ', p_type, ' '), 8), chr(10), '--- PAGE 2 ---', chr(10), 'end')",
    "b": "CASE p_partkey % 6 WHEN 0 THEN upper(concat('--- PAGE 1 ---', chr(10), chr(10), repeat(concat(p_name, '  and ', p_type, chr(9)), 8), '--- PAGE 2 ---  end')) WHEN 1 THEN concat('--- PAGE 1 ---', chr(10), repeat(concat(p_name, ' and ', p_type, ' '), 7), p_name, ' but ', p_type, chr(10), '--- PAGE 2 ---', chr(10), 'end') WHEN 2 THEN concat('--- PAGE 1 ---', repeat('something else, 0123456789', 8)) WHEN 3 THEN NULL WHEN 4 THEN '' ELSE concat('--- PAGE 1 ---', chr(10), 'end') END",
}


@query("SELECT p_partkey AS k, p_partkey % 6 < 2 AS same FROM part")
def duplicate_check(spark, d):
    """Whether two texts are nearly the same on their first three pages."""
    # a fixed number of parts: the work of a row is far more than its bytes say
    rows = read(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").selectExpr(*(f"{sql} AS {name}" for name, sql in _COPY.items()))
    a, b = (providers.first_pages(F.concat(c, F.lit("\n--- PAGE 3 --- x\n--- PAGE 4 ---\n"), F.repeat(c, 3))) for c in ("a", "b"))
    some = F.col("b") != ""
    return rows.select("k", providers.similar_text(F.when(some, a).otherwise(F.col("a")), F.when(some, b).otherwise(F.col("b"))).alias("same"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return oversample_boost_topk(spark, d)


from . import batches, details, folds, laid_out, searches  # noqa: E402, F401  they register their queries
