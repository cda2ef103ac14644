"""Queries that take each operator through all of its branches, on inputs made from the test tables.

Inputs are written as SQL that both engines read alike; what comes out is stated by the SQL beside each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, models, providers, text
from ..operators import evaluation, layout, profile, retrieval, rule_index, vector
from ..sources import catalog, collections, merged, rule_table, scans, shared, tables
from .queries import _RULES, own_index, query, read, rules, vector_of


def made(spark, d, table: str, columns: dict[str, str]) -> DataFrame:
    """Columns of a table by the SQL of each."""
    return read(spark, d, table).selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def select(table: str, columns: dict[str, str]) -> str:
    """The same for the other engine."""
    return f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM {table}"


_K = "CAST(p_partkey AS STRING)"
_TEXTS = {
    "k": "p_partkey",
    "number": "CAST(p_partkey % 9 AS STRING)",
    "name": "CASE WHEN p_partkey % 2 = 0 THEN concat('  ', p_name, chr(9)) ELSE p_name END",
    "sub": f"CASE WHEN p_partkey % 3 = 0 THEN concat({_K}, '.1') ELSE '' END",
    "tagged": "CASE WHEN p_partkey % 2 = 0 THEN concat('[Carrier: ', p_brand, '] ', p_name) ELSE p_name END",
    "thought": "concat('<thinking>', p_name, chr(10), 'is it?</thinking>  ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN '<thinking></thinking>' ELSE '' END)",
    "foreign": "concat('é', p_name, 'ß', CASE WHEN p_partkey % 2 = 0 THEN ' 5 €' ELSE '' END)",
    "rule": "CASE p_partkey % 3 WHEN 0 THEN '5.5' WHEN 1 THEN '' ELSE NULL END",
    "scenario": "CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN '' ELSE NULL END",
    "section": "CASE WHEN p_partkey % 5 > 0 THEN p_type END",
    "reply": "CASE p_partkey % 3 WHEN 0 THEN concat('FAITHFULNESS: Yes', chr(10), 'Relevancy: no') WHEN 1 THEN 'relevancy: YES, citation: yes' ELSE 'none' END",
}


@query(f"""WITH t AS ({select('part', _TEXTS | {'p_name': 'p_name', 'p_brand': 'p_brand', 'p_type': 'p_type'})})
          SELECT k, concat(number, '. ', p_name, CASE WHEN sub <> '' THEN concat(' > ', sub) ELSE '' END) AS section_path, concat(number, ' ', p_name) AS datasheet, p_name AS bare, p_brand AS unthought,
          trim(substring(regexp_replace(lower(p_type), '[^a-z0-9]', '_', 'g'), 1, 20), '_') AS slug, concat('?', p_name, '?', CASE WHEN k % 2 = 0 THEN ' 5 ?' ELSE '' END) AS ascii,
          concat('[Doc: errata] [Section: ', coalesce(section, 'None'), ']', CASE WHEN k % 3 = 0 THEN ' [Rule: 5.5]' ELSE '' END, CASE WHEN k % 4 = 0 THEN ' [Scenario: B]' ELSE '' END) AS header,
          concat('qa_', regexp_replace(substring(lower(p_brand), 1, 40), '[^a-z0-9]', '_', 'g'), '_', k) AS chunk, concat(p_brand, '_chunk_', k) AS policy, concat('entity_', p_name) AS entity,
          CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS faithfulness, CASE WHEN k % 3 = 1 THEN 'Yes' ELSE 'No' END AS relevancy, CASE WHEN k % 3 = 1 THEN 'Yes' ELSE 'No' END AS citation FROM t""")
def text_functions(spark, d):
    t = made(spark, d, "part", _TEXTS | {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type"})
    c = F.col
    said = models.verdicts(c("reply"))
    chunk = F.regexp_replace(text.chunk_id(F.lit("qa"), c("p_brand"), c("k")), "_[0-9A-F]{8}_", "_")
    return t.select("k", text.section_path(c("number"), c("name"), c("sub")).alias("section_path"), text.datasheet(F.array("number", "p_name")).alias("datasheet"), text.without_carrier(c("tagged")).alias("bare"), text.without_thinking(c("thought")).alias("unthought"), text.slug(c("p_type")).alias("slug"), text.ascii_only(c("foreign")).alias("ascii"), text.chunk_header(F.lit("errata"), c("section"), c("rule"), c("scenario")).alias("header"), chunk.alias("chunk"), text.policy_chunk_id(c("p_brand"), c("k")).alias("policy"), text.entity_id(F.concat("p_name", F.lit(".json"))).alias("entity"), *(said[a].alias(a) for a in fixed.ASPECTS))


_N = lambda x: f"CAST({x} AS STRING)"
_CHAPTER = f"concat('A', {_N('1 + p_partkey % 9')}, '.', {_N('p_partkey % 50')}, ' Moves (B', {_N('p_partkey % 7')}, '.', {_N('p_partkey % 13')}, ') see C', {_N('p_partkey % 5')}, '.1 and [EXC: D', {_N('p_partkey % 3')}, '.2 only] 5.5', chr(10), ' E1.', {_N('p_partkey % 20')}, chr(10), 'A', {_N('1 + p_partkey % 9')}, '.', {_N('p_partkey % 50')})"


@query(f"""SELECT p_partkey AS k, concat('A', 1 + p_partkey % 9, '.', p_partkey % 50, ',C', p_partkey % 5, '.1,D', p_partkey % 3, '.2,E1.', p_partkey % 20) AS rules,
          concat('B', p_partkey % 7, '.', p_partkey % 13, ',D', p_partkey % 3, '.2,C', p_partkey % 5, '.1') AS refs,
          concat('A', 1 + p_partkey % 9, '.', p_partkey % 50, ',C', p_partkey % 5, '.1,D', p_partkey % 3, '.2,E1.', p_partkey % 20) AS fallback, len({_CHAPTER}) AS n FROM part""")
def profile_patterns(spark, d):
    """A profile's own patterns; one of its patterns that can't be compiled gives way to the other."""
    _, rule, reference = fixed.RULE_SCHEMAS[0]
    good = text.checked_patterns(spark, {"rule_pattern": rule, "cross_ref_pattern": reference})
    odd = text.checked_patterns(spark, {"rule_pattern": rule, "cross_ref_pattern": "([unclosed"})
    t = made(spark, d, "part", {"k": "p_partkey", "t": _CHAPTER})
    joined = lambda f, p: F.array_join(f(F.col("t"), p), ",")
    return t.select("k", joined(text.rule_numbers, good["rule_pattern"]).alias("rules"), joined(text.cross_references, good["cross_ref_pattern"]).alias("refs"), joined(text.cross_references, odd["cross_ref_pattern"]).alias("fallback"), F.char_length("t").cast("bigint").alias("n"))


_REPLY = "CASE p_partkey % 5 WHEN 0 THEN concat('Sure: {\"query_type\": \"direct_rule\", \"rule_numbers\": [\"', CAST(p_partkey AS STRING), '.1\"], \"scenario\": \"\", \"sub_queries\": []} - done') WHEN 1 THEN '{\"query_type\": \"poem\", \"scenario\": \"B\"}' WHEN 2 THEN 'no json' WHEN 3 THEN NULL ELSE '{\"query_type\": \"scenario\", \"scenario\": \"C\", \"sub_queries\": [\"a\", \"b\"]}' END"
_TYPE_REPLY = "CASE p_partkey % 4 WHEN 0 THEN 'It is {\"doc_type\": \"errata\", \"priority\": 4, \"description\": \"x\"}.' WHEN 1 THEN '{\"doc_type\": \"codex\"}' WHEN 2 THEN 'none' ELSE '{\"doc_type\": \"novel\"}' END"
_GLOSSARY_REPLY = "CASE WHEN p_partkey % 2 = 0 THEN concat('{\"MP\": \"', p_name, '\"}') ELSE 'none of them' END"


@query(rf"""WITH t AS (SELECT p_partkey AS k, regexp_extract({_REPLY}, '(?s)\{{.*\}}') AS r, regexp_extract({_TYPE_REPLY}, '\{{[^}}]+\}}') AS kind, regexp_extract({_GLOSSARY_REPLY}, '(?s)\{{.*\}}') AS g, p_partkey FROM part),
          j AS (SELECT k, CASE WHEN json_valid(r) THEN r END AS r, CASE WHEN json_valid(kind) THEN kind END AS kind, CASE WHEN json_valid(g) THEN g END AS g,
                CASE k % 3 WHEN 0 THEN '{{"attributes": {{"Thrust": "1", "Speed": "2"}}, "grids": {{}}, "collections": {{"Weapon": "[]"}}}}' WHEN 2 THEN '{{"grids": {{"Front": "1", "Hull": "2"}}}}' END AS entity, CASE k % 3 WHEN 0 THEN 'Exact and cited' WHEN 1 THEN 'It is cited.' ELSE '' END AS said FROM t),
          n AS (SELECT *, coalesce(json_extract_string(kind, '$.doc_type'), 'unknown') AS doc_type FROM j)
          SELECT k, CASE WHEN json_extract_string(r, '$.query_type') IN ({', '.join(f"'{x}'" for x in fixed.QUERY_TYPES)}) THEN json_extract_string(r, '$.query_type') ELSE 'concept' END AS query_type, coalesce(array_to_string(CAST(json_extract(r, '$.rule_numbers') AS VARCHAR[]), ','), '') AS rules,
                 nullif(json_extract_string(r, '$.scenario'), '') AS scenario, CAST(coalesce(json_array_length(r, '$.sub_queries'), 0) AS INTEGER) AS parts, doc_type,
                 CAST(coalesce(CAST(json_extract(kind, '$.priority') AS INTEGER), CASE doc_type {' '.join(f"WHEN '{x}' THEN {y}" for x, y in fixed.PRIORITIES.items())} END, 9) AS INTEGER) AS priority,
                 CASE WHEN g IS NULL THEN concat('FP=Fire Power,MP=Move ', k) ELSE concat('MP=', json_extract_string(g, '$.MP')) END AS glossary,
                 array_to_string(list_sort(list_concat(list_filter(coalesce(json_keys(entity, '$.attributes'), []), lambda x: x <> 'Thrust'), list_filter(coalesce(json_keys(entity, '$.grids'), []), lambda x: x <> 'Front'), list_filter(coalesce(json_keys(entity, '$.collections'), []), lambda x: x <> 'Missile'))), ',') AS odd,
                 CASE WHEN contains(upper(said), 'EXACT') THEN 'EXACT' WHEN contains(upper(said), 'FAITHFUL') THEN 'FAITHFUL' WHEN contains(upper(said), 'CITED') THEN 'CITED' ELSE 'FAIL' END AS grade FROM n""")
def model_replies(spark, d):
    """What is read from a model's replies, whatever it says."""
    t = made(spark, d, "part", {"k": "p_partkey", "r": _REPLY, "kind": _TYPE_REPLY, "g": _GLOSSARY_REPLY, "own": "array('FP: Fire Power', concat('MP: Move ', CAST(p_partkey AS STRING)))"})
    names = models.ontology(F.lit('Here: {"attributes": ["Thrust"], "grids": ["Front"], "collections": ["Missile"]}'))
    entity = F.when(F.col("k") % 3 == 0, '{"attributes": {"Thrust": "1", "Speed": "2"}, "grids": {}, "collections": {"Weapon": "[]"}}').when(F.col("k") % 3 == 1, "not JSON").otherwise('{"grids": {"Front": "1", "Hull": "2"}}')
    grade = models.grade(F.when(F.col("k") % 3 == 0, "Exact and cited").when(F.col("k") % 3 == 1, "It is cited."))
    q, c = models.query_class(F.col("r")), models.document_class(F.col("kind"))
    entries = F.array_sort(F.transform(F.map_entries(models.glossary(F.col("g"), F.col("own"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t.select("k", q["query_type"].alias("query_type"), F.array_join(q["rule_numbers"], ",").alias("rules"), q["scenario"].alias("scenario"), F.size(q["sub_queries"]).alias("parts"), c["doc_type"].alias("doc_type"), c["priority"].alias("priority"), F.array_join(entries, ",").alias("glossary"), F.array_join(models.odd_names(entity, names), ",").alias("odd"), grade.alias("grade"))


@query("""WITH t AS (SELECT conv_id, turn, text, split_part(text, chr(10), 1) AS first FROM conversations)
          SELECT conv_id, turn, CASE WHEN trim(first) <> '' THEN concat(first, ' [1]') END AS answer, CASE WHEN trim(first) <> '' THEN 'Yes' END AS faithfulness, CASE WHEN trim(first) <> '' THEN 'Yes' END AS citation FROM t""")
def model_answers(spark, d):
    """Prompts to replies of the stand-ins for a model that answers and one that judges, by the batch."""
    rows = read(spark, d, "conversations").withColumn("first", F.split_part("text", F.lit("\n"), F.lit(1)))
    prompt = F.when(F.trim("first") != "", models.answer_prompt("talks", F.lit("What is said?"), F.col("text")))
    answered = models.asked(rows, prompt, models.first_source, "answer")
    judged = models.asked(answered, models.judge_prompt(F.lit("What is said?"), F.col("answer"), F.col("text")), models.lenient_judge, "reply")
    said = models.verdicts(F.col("reply"))
    return judged.select("conv_id", "turn", "answer", *(F.when(F.col("reply").isNotNull(), said[a]).alias(a) for a in ("faithfulness", "citation")))


_PAGES = {"source_file": "CAST(conv_id % 40 AS STRING)", "page": "CAST(row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) AS INT)", "text": "CASE WHEN turn % 3 = 0 THEN substring(text, 1, 30) ELSE concat(text, text, text, text, text, text, text, text, text, text, text, text) END"}


@query(f"""WITH p AS ({select('conversations', _PAGES)}), n AS (SELECT source_file, max(page) AS n FROM p GROUP BY 1)
          SELECT p.source_file, page, md5(substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 2000)) AS cut FROM p JOIN n ON p.source_file = n.source_file
          WHERE page IN (1, 2, 3, 4, least(11, n), n // 4 + 1, n // 2 + 1)""")
def page_samples(spark, d):
    return profile.sampled_pages(made(spark, d, "conversations", _PAGES)).select("source_file", "page", F.md5("text").alias("cut"))


@query(f"WITH p AS ({select('conversations', _PAGES)}) SELECT source_file, md5(substring(arg_min(text, page), 1, 1500)) AS title FROM p WHERE length(text) > 50 GROUP BY 1")
def page_titles(spark, d):
    return profile.titles(made(spark, d, "conversations", _PAGES)).select("source_file", F.md5("title").alias("title"))


_NATIVE = "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, 20) ELSE NULL END"
_SCANNED = "CASE WHEN turn % 4 < 2 THEN text ELSE '  ' END"


@query(f"""WITH p AS (SELECT conv_id, trim(coalesce({_NATIVE}, '')) AS n, trim(coalesce({_SCANNED}, '')) AS s FROM conversations),
          k AS (SELECT conv_id, CASE WHEN length(n) >= 50 THEN 'native' WHEN s <> '' THEN 'ocr' ELSE 'empty' END AS kind, CASE WHEN length(n) >= 50 THEN n ELSE s END AS t FROM p)
          SELECT conv_id, count(*) FILTER (WHERE kind = 'native') AS native, count(*) FILTER (WHERE kind = 'ocr') AS ocr, count(*) FILTER (WHERE kind = 'empty') AS empty, CAST(sum(length(t)) AS BIGINT) AS chars FROM k GROUP BY 1""")
def page_kinds(spark, d):
    t = made(spark, d, "conversations", {"source_file": "conv_id", "native": _NATIVE, "scanned": _SCANNED})
    return tables.page_statistics(t.select("source_file", tables.page_text(F.col("native"), F.col("scanned")).alias("p"))).withColumnRenamed("source_file", "conv_id")


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN substring(text, 1, 5) ELSE text END AS t FROM conversations), f AS (SELECT conv_id, coalesce(sum(length(t)), 0) AS n, bool_or(conv_id % 2 = 0) AS image FROM p WHERE turn <= 5 GROUP BY 1)
          SELECT conv_id, CASE WHEN n > 100 THEN 'TEXT' WHEN image THEN 'SCANNED/IMAGE' ELSE 'EMPTY' END AS kind FROM f""")
def page_triage(spark, d):
    t = made(spark, d, "conversations", {"source_file": "conv_id", "page": "turn", "text": "CASE WHEN conv_id % 3 = 0 THEN substring(text, 1, 5) ELSE text END", "has_image": "conv_id % 2 = 0"})
    return tables.triage(t).withColumnRenamed("source_file", "conv_id")


@query("""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, text, turn % 3 = 2 AS picture FROM conversations),
          k AS (SELECT *, CASE WHEN NOT picture AND length(trim(text)) >= 50 THEN 'native' WHEN picture AND trim(text) <> '' THEN 'ocr' ELSE 'empty' END AS kind FROM p),
          m AS (SELECT conv_id, page, concat('--- PAGE ', page, CASE kind WHEN 'ocr' THEN ' [OCR]' WHEN 'empty' THEN ' [EMPTY]' ELSE '' END, ' ---', chr(10), CASE WHEN kind = 'empty' THEN '' ELSE trim(text) END) AS t FROM k)
          SELECT concat('f', conv_id, '.pdf') AS source_file, md5(string_agg(t, chr(10) ORDER BY page)) AS hash FROM m
          WHERE conv_id % 5 > 0 AND CASE conv_id % 4 WHEN 0 THEN page <= 2 WHEN 1 THEN page <= 0 ELSE true END GROUP BY conv_id""")
def scanned_files(spark, d):
    """Files of native pages and pictures to page-marked texts: those done before are left out, and pages beyond a cap."""
    body = F.concat(F.when(F.col("turn") % 3 == 2, scans.PICTURE.decode()).otherwise(""), "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]), "\f")
    files = read(spark, d, "conversations").groupBy("conv_id").agg(whole.cast("binary").alias("content")).withColumn("path", F.concat(F.lit("file:/in/f"), F.col("conv_id").cast("string"), F.lit(".pdf")))
    done = files.filter("conv_id % 5 = 0").select(F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("source_file"))
    caps = files.select(F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.when(F.col("conv_id") % 4 == 0, 2).when(F.col("conv_id") % 4 == 1, 0).alias("max_pages"))
    return scans.marked_texts(scans.page_texts(scans.unread(files, done)), caps).select("source_file", F.md5("text").alias("hash"))


_LISTING = {"id": "CAST(o_orderkey AS INT)", "neighborhood": "concat('area, ', CAST(o_orderkey % 7 AS STRING))", "room_type": "CASE WHEN o_orderkey % 3 = 0 THEN 'Entire home/apt' ELSE 'Private \"room\"' END", "price": "CAST(o_orderkey % 750 AS DECIMAL(10,2))", "rating": "CAST(o_orderkey % 5 AS DECIMAL(3,1))", "review_text": "o_orderpriority"}


@query(f"SELECT id, neighborhood, room_type, CAST(price AS DOUBLE) AS price, CAST(rating AS DOUBLE) AS rating, review_text FROM ({select('orders', _LISTING)}) ORDER BY id LIMIT 500")
def listings_csv(spark, d):
    """The first 500 rows, by id, of a CSV file."""
    path = shared.fresh_path(spark, "listings")
    made(spark, d, "orders", _LISTING).write.csv(path, header=True, quote='"', escape='"')
    return tables.listings(spark, path).withColumns({"price": F.col("price").cast("double"), "rating": F.col("rating").cast("double")})


@query("SELECT CAST(count(*) AS INTEGER) AS n, 6 AS areas, 3 AS rooms, 8 AS reviews, true AS in_bounds, 1 AS first_id, CAST(count(*) AS INTEGER) AS last_id FROM customer")
def made_up_listings(spark, d):
    """A listing for each customer."""
    rows = tables.made_up_listings(spark, read(spark, d, "customer").count())
    within = F.bool_and(F.col("price").between(50, 800) & F.col("rating").between(2.5, 5.0) & F.col("neighborhood").isin(tables.NEIGHBOURHOODS) & F.col("room_type").isin(tables.ROOMS) & F.col("review_text").isin(tables.REVIEWS))
    return rows.agg(F.count("*").cast("int").alias("n"), F.count_distinct("neighborhood").cast("int").alias("areas"), F.count_distinct("room_type").cast("int").alias("rooms"), F.count_distinct("review_text").cast("int").alias("reviews"), within.alias("in_bounds"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 5 > 1")
def entity_files(spark, d):
    """Entities of a folder of JSON files; broken files and those without a name are skipped."""
    path = shared.fresh_path(spark, "entities")
    body = F.when(F.col("n_nationkey") % 5 == 0, '{"name": "broken').when(F.col("n_nationkey") % 5 == 1, '{"region": 1}').otherwise(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    read(spark, d, "nation").select("n_nationkey", body.alias("value")).write.partitionBy("n_nationkey").text(path)
    return tables.entities(spark, path, "*.txt").select("name", F.col("region").cast("int").alias("region"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'errata' ELSE 'unknown' END AS doc_type, CASE WHEN p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 4 = 1 THEN 5 ELSE 9 END AS priority, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'none' END AS description FROM part""")
def catalog_patch(spark, d):
    """A catalog with overrides by file name: only for names that it has, and only what they state."""
    catalog = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_file"), F.lit("unknown").alias("doc_type"), F.lit(9).alias("priority"), F.lit("none").alias("description"))
    own = read(spark, d, "part").filter("p_partkey % 4 < 2")
    full = F.col("p_partkey") % 4 == 0
    overrides = own.select(F.col("p_partkey").cast("string").alias("source_file"), F.when(full, "errata").alias("doc_type"), F.when(full, 3).otherwise(5).alias("priority"), F.when(full, F.col("p_name")).alias("description"))
    overrides = overrides.unionByName(spark.createDataFrame([("absent", "qa", 6, "x")], overrides.schema))
    return profile.patched(catalog, overrides).select(F.col("source_file").cast("bigint").alias("k"), "doc_type", "priority", "description")


@query("""SELECT event_id, event_type, 'old' AS origin FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0 AND event_id % 7 > 0 UNION ALL SELECT event_id, event_type, 'new' FROM events WHERE event_id % 3 = 0 AND event_id % 7 > 0
          UNION ALL SELECT event_id, 'inserted', 'late' FROM events WHERE event_id % 5 = 0 AND (event_id % 7 = 0 OR event_id % 2 = 1 AND event_id % 3 > 0)""")
def merged_collection(spark, d):
    """A table by key that is merged on reading: a base, an upsert, tombstones, an insert, compaction in between."""
    held = merged.Merged(spark, shared.fresh_path(spark, "merged"))
    rows = read(spark, d, "events").select("event_id", "event_type", F.col("event_id").alias("seq"))
    held.create(rows.filter("event_id % 2 = 0").withColumn("origin", F.lit("old")), "event_id")
    held.upsert(rows.filter("event_id % 3 = 0").withColumn("origin", F.lit("new")), "seq")
    held.compact()
    held.delete(rows.filter("event_id % 7 = 0"))
    held.insert(rows.filter("event_id % 5 = 0").select("event_id", F.lit("inserted").alias("event_type"), "seq", F.lit("late").alias("origin")), "seq")
    return held.get().select("event_id", "event_type", "origin")


@query("""SELECT c.conv_id, c.turn, md5(concat_ws(chr(10), p.text, c.text, n.text)) AS expanded FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
          LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def catalog_neighbours(spark, d):
    """Neighbours from a table of the catalog that was made on first use and inserted into twice; the second time changes
    nothing, for its keys are there."""
    rows = read(spark, d, "conversations").withColumn("chunk_id", F.concat_ws("_chunk_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    path = shared.fresh_path(spark, "chunks")
    name = f"millrace_{path.rsplit('-', 1)[-1]}"
    for _ in range(2):
        catalog.create(spark, name, "chunk_id string, conv_id bigint, turn bigint, role string, text string", "chunk_id", 8, path)
    catalog.insert_ignore(spark, name, rows, "chunk_id", "turn")
    chunks = catalog.insert_ignore(spark, name, rows.withColumn("text", F.lit("again")), "chunk_id", "turn")
    found = shared.saved(retrieval.neighbours(chunks, chunks).select("conv_id", "turn", F.md5("expanded").alias("expanded")))
    catalog.drop(spark, name)
    return found


_HOT = {"chunk_id": "CAST(p_partkey AS STRING)", "rule_number": "CASE WHEN p_partkey % 2 = 0 THEN '1.1' ELSE concat(1 + p_partkey % 29, '.', p_partkey % 90) END", "other": "concat(1 + p_partkey % 7, '.', p_partkey % 11)", "doc_type": "p_brand", "priority": "CAST(p_size % 4 AS INT)", "source_file": "p_type", "content_type": "'rule'", "seq": "p_partkey"}
_HOT_INDEX = f"""h AS ({select('part', _HOT)}), e AS (SELECT rule_number AS rule, false AS secondary, chunk_id, priority, seq FROM h UNION ALL SELECT other, true, chunk_id, priority, seq FROM h WHERE other <> rule_number),
          r AS (SELECT rule, chunk_id, CAST(row_number() OVER (PARTITION BY rule ORDER BY priority, seq, secondary, chunk_id) AS INTEGER) AS rank FROM e)"""


def hot_chunks(spark, d) -> DataFrame:
    """Chunks of which half are about one rule."""
    return made(spark, d, "part", _HOT).withColumn("all_rule_numbers", F.array("other", "rule_number")).drop("other")


@query(f"WITH {_HOT_INDEX} SELECT * FROM r")
def rule_index_ranged(spark, d):
    """Ranks of all entries, with one rule that half of all chunks have, cut into pieces."""
    return rule_table.ranked(hot_chunks(spark, d), 8).select("rule", "chunk_id", "rank")


@query(f"WITH {_HOT_INDEX} SELECT * FROM r WHERE rule IN ('1.1', '3.2', '30.1', '99.9') AND rank <= 6")
def rule_lookup_stored(spark, d):
    """The first entries of a few rules from a stored table, of which few files are read."""
    path = shared.fresh_path(spark, "index")
    rule_table.write(hot_chunks(spark, d), path, 8)
    return rule_table.lookup(spark, path, ["1.1", "3.2", "30.1", "99.9"], 6).select("rule", "chunk_id", "rank")


@query("""SELECT event_id, event_type, 'old' AS origin FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0 UNION ALL SELECT event_id, event_type, 'new' FROM events WHERE event_id % 3 = 0
          UNION ALL SELECT event_id, 'inserted', 'late' FROM events WHERE event_id % 2 = 1 AND event_id % 3 > 0 AND event_id % 5 = 0""")
def collection_merges(spark, d):
    """A collection made anew, merged into by key, and inserted into; another that is made on first use."""
    held = collections.Collections(spark, shared.fresh_path(spark, "collections"))
    rows = read(spark, d, "events").select("event_id", "event_type", F.col("event_id").alias("seq"))
    held.recreate("events", rows.limit(0).withColumn("origin", F.lit("x")))
    held.recreate("events", rows.filter("event_id % 2 = 0").withColumn("origin", F.lit("old")))
    held.upsert("events", rows.filter("event_id % 3 = 0").withColumn("origin", F.lit("new")), "event_id", "seq")
    late = rows.filter("event_id % 5 = 0").select("event_id", F.lit("inserted").alias("event_type"), "seq", F.lit("late").alias("origin"))
    held.insert("events", late, "event_id", "seq")
    if held.exists("others") or held.get_or_create("others", "id int").count():
        raise AssertionError("a new collection is empty")
    try:
        held.get("absent")
        raise AssertionError("a missing collection is an error")
    except collections.Missing:
        return held.get("events").select("event_id", "event_type", "origin")


@query("SELECT vec_id, label, 'id' AS how FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT vec_id, label, 'label' FROM embeddings WHERE label = 2")
def collection_points(spark, d):
    """Rows of a collection by ids and by a condition."""
    held = collections.Collections(spark, shared.fresh_path(spark, "collections"))
    rows = held.recreate("vectors", read(spark, d, "embeddings"))
    ids = rows.filter("vec_id % 10 = 3").select("vec_id").unionByName(spark.createDataFrame([(-5,)], "vec_id long"))
    found = held.by_ids("vectors", ids, "vec_id").select("vec_id", "label", F.lit("id").alias("how"))
    return found.unionByName(held.where("vectors", vector.predicate(label=2)).select("vec_id", "label", F.lit("label").alias("how")))


_INDEX = rf"""WITH {_RULES}, c AS (SELECT p_partkey, p_partkey % 4 + 1 AS priority, regexp_extract(text, '^(\d+\.\d+)', 1) AS own FROM r),
            e AS (SELECT own AS rule, p_partkey, priority, false AS secondary FROM c UNION ALL SELECT concat(CAST(1 + p_partkey % 29 AS VARCHAR), '.', CAST(p_partkey % 90 + 2 AS VARCHAR)), p_partkey, priority, true FROM c),
            i AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY priority, p_partkey, secondary) AS rank FROM e)"""


@query(_INDEX + " SELECT rule, CAST(p_partkey AS VARCHAR) AS chunk_id, secondary, CAST(rank AS INTEGER) AS rank, CAST(priority AS INTEGER) AS priority FROM i")
def index_files(spark, d):
    """The index written as JSON and read again, and one that isn't there."""
    path = shared.fresh_path(spark, "index")
    collections.write_index(rule_index.nested(own_index(spark, d)), path)
    absent = collections.read_index(spark, path + "-absent")
    return collections.read_index(spark, path).unionByName(absent).select("rule", "chunk_id", "secondary", "rank", "priority")


def _looked_up(wanted: str, each: int | None, limit: int | None) -> str:
    return _INDEX + f""", w AS (SELECT * FROM (VALUES {wanted}) t(rule, ord)), f AS (SELECT p_partkey, min(ord * 1000000 + rank) AS spot FROM i JOIN w USING (rule) {f'WHERE rank <= {each}' if each else ''} GROUP BY 1)
            SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CAST(row_number() OVER (ORDER BY spot, CAST(p_partkey AS VARCHAR)) AS INTEGER) AS pos FROM f ORDER BY pos {f'LIMIT {limit}' if limit else ''}"""


@query(_looked_up("('5.5', 0), ('99.9', 1), ('3.3', 2), ('9.10', 3)", 3, None))
def rule_lookup_each3(spark, d):
    wanted = spark.createDataFrame([("5.5", 0), ("99.9", 1), ("3.3", 2), ("9.10", 3)], "rule string, ord int")
    return rule_index.lookup(own_index(spark, d), wanted, each=3)


@query(_looked_up("('5.5', 0), ('3.3', 1), ('2.2', 2)", None, 20))
def rule_lookup_first20(spark, d):
    wanted = spark.createDataFrame([("5.5", 0), ("3.3", 1), ("2.2", 2)], "rule string, ord int")
    return rule_index.lookup(own_index(spark, d), wanted, limit=20)


_CARRIER = ", ".join(f"('{k}', '{v}')" for k, v in fixed.CARRIERS.items())
_FILE = f"CASE WHEN s_suppkey % 3 = 0 THEN concat('Own_', CAST(s_suppkey AS STRING), '.pdf') ELSE element_at(array({', '.join(repr(k) for k in fixed.CARRIERS)}), CAST(1 + s_suppkey % 8 AS INT)) END"


@query(f"""WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN concat('Own_', s_suppkey, '.pdf') ELSE list_extract([{', '.join(repr(k) for k in fixed.CARRIERS)}], 1 + s_suppkey % 8) END AS file FROM supplier)
          SELECT k, coalesce(c, upper(replace(file, '.pdf', ''))) AS carrier FROM f LEFT JOIN (VALUES {_CARRIER}) t(n, c) ON n = file""")
def carrier_names(spark, d):
    return made(spark, d, "supplier", {"k": "s_suppkey", "file": _FILE}).select("k", profile.carrier(F.col("file")).alias("carrier"))


@query(f"""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE list_extract([{', '.join(repr(x[0]) for x in fixed.DOCUMENTS)}], 1 + p_partkey % 10) END AS file FROM part)
          SELECT k, t AS doc_type, CAST(p AS INTEGER) AS priority FROM f LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c, _ in fixed.DOCUMENTS)}) x(n, t, p) ON n = file""")
def known_documents(spark, d):
    names = ", ".join(repr(x[0]) for x in fixed.DOCUMENTS)
    files = made(spark, d, "part", {"k": "p_partkey", "source_file": f"CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE element_at(array({names}), CAST(1 + p_partkey % 10 AS INT)) END"})
    return profile.known_documents(files).select("k", "doc_type", "priority")


#: Names and titles that reach each rule of the two tables, and what they say: type, priority, edition.
_CASES = [
    ("Rules_Errata.pdf", "", "errata", 3, None), ("hasl errata.pdf", "", "errata", 3, None), ("Scenario balance.pdf", "", "scenario_balance", 5, None), ("Version tracker.txt", "", "version_tracker", 2, None),
    ("my q&a.pdf", "", "qa", 6, None), ("Journal 5.pdf", "", "journal", 6, None), ("House of rules.pdf", "", "variant", 7, None), ("Tournament.pdf", "", "tournament", 7, None), ("codex.pdf", "", "codex", 2, None),
    ("What is it.pdf", "", "primer", 9, None), ("ScenarioB.pdf", "", "scenarios", 8, None), ("scenarioab12.pdf", "", "scenarios", 8, None), ("ap12 x.pdf", "", "scenarios", 8, None), ("pp3.pdf", "", "scenarios", 8, None),
    ("scenariot1.pdf", "", "scenarios", 8, None), ("Scenarios pack 3 more.pdf", "", "scenarios", 8, None), ("1st edition.pdf", "", "core_rules_v1", 9, 1), ("2nd ed book.pdf", "", "core_rules", 1, 2), ("Replacement pages.pdf", "", "errata", 3, None),
    ("bookvb.pdf", "", "errata", 3, None), ("plain1.pdf", "The Published Errata, 3rd edition", "errata", 3, 3), ("plain2.pdf", "Balance Errata", "scenario_balance", 5, None), ("plain3.pdf", "Scenario A errata", "scenario_errata", 4, None),
    ("plain4.pdf", "Questions and Answers", "qa", 6, None), ("plain5.pdf", "Clarifications and errata", "qa", 6, None), ("plain6.pdf", "Version Tracker", "version_tracker", 2, None), ("plain7.pdf", "The 2nd Edition of the rules", "core_rules", 1, 2),
    ("plain8.pdf", "All rules of the 1st book", "core_rules_v1", 9, None), ("plain9.pdf", "Introduction to the 1st", "core_rules", 1, None), ("plain10.pdf", "ASL Scenario AP12", "scenarios", 8, None), ("plain11.pdf", "Turn Record Chart", "scenarios", 8, None),
    ("plain12.pdf", "ASL Journal", "journal", 6, None), ("plain13.pdf", "The codex", "codex", 2, None), ("plain14.pdf", "An optional rule", "variant", 7, None), ("plain15.pdf", "A replacement page", "errata", 3, None), ("plain16.pdf", "model", "supplement", 8, None), ("plain17.pdf", "nothing", "unknown", 9, None),
]


@query(f"""WITH c(i, t, p, e) AS (VALUES {', '.join(f"({i}, '{t}', {p}, {'NULL' if e is None else e})" for i, (_, _, t, p, e) in enumerate(_CASES))})
          SELECT p_partkey AS k, t AS doc_type, CAST(p AS INTEGER) AS priority, CAST(e AS INTEGER) AS edition FROM part JOIN c ON p_partkey % {len(_CASES)} = i""")
def file_classes(spark, d):
    """Files by each rule for names, each rule for contents, a model, and nothing."""
    cases = spark.createDataFrame([(i, n, t) for i, (n, t, *_) in enumerate(_CASES)], "i int, source_file string, title string")
    files = read(spark, d, "part").join(F.broadcast(cases), F.col("p_partkey") % len(_CASES) == F.col("i"))
    model = F.when(F.col("title") == "model", models.document_class(F.lit('{"doc_type": "supplement"}')))
    return profile.classified(files, model).select(F.col("p_partkey").alias("k"), "doc_type", "priority", "edition")
