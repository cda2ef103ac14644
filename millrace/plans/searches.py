"""Whole retrievals, sheets of layout spans and evaluations as queries; embeddings come from the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..operators import chunking, codes, evaluation, layout, profile, retrieval, rule_index, vector
from ..sources import collections, shared
from .details import made, select
from .queries import _RULES, query, read, rules, vector_of

_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = {})::DOUBLE[]"


def searched(table: str, vec_id: int, words: list[str], n: int, where: str = "true", key: str = "chunk_id") -> str:
    """The rows of a semantic search, with pos from 1."""
    boost = f"round(0.12 * len(list_filter({words!r}::VARCHAR[], lambda w: contains(lower(text), w))), 6)"
    near = f"SELECT *, round(list_cosine_distance(embedding::DOUBLE[], {_VECTOR.format(vec_id)}), 6) AS distance FROM {table} WHERE {where} ORDER BY distance, {key} LIMIT {int(2.5 * n)}"
    return f"(SELECT *, row_number() OVER (ORDER BY round(distance - {boost}, 6), distance, {key}) AS pos FROM ({near}) QUALIFY pos <= {n})"


def corpus(spark, d) -> DataFrame:
    """The rules of part as chunks with embeddings."""
    k = F.col("p_partkey")
    own = F.regexp_extract("text", r"^(\d+\.\d+)", 1)
    kind = F.when(k % 5 == 0, "errata").when(k % 5 == 1, "variant").otherwise("core_rules")
    other = F.concat((1 + k % 29).cast("string"), F.lit("."), (k % 90 + 2).cast("string"))
    rows = rules(spark, d).join(read(spark, d, "embeddings"), k == F.col("vec_id"))
    return rows.select(F.lpad(k.cast("string"), 7, "0").alias("chunk_id"), F.concat(F.lit("[Rule: "), own, F.lit("]\n"), "text").alias("text"), "embedding", own.alias("rule_number"), F.array(other, own).alias("all_rule_numbers"), kind.alias("doc_type"), (k % 4 + 1).cast("int").alias("priority"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("source_file"), F.lit("rule").alias("content_type"), F.when(k % 6 == 0, F.char(65 + k % 11)).alias("scenario"), (k % 50).cast("int").alias("page"), k.alias("seq"))


_CORPUS = rf"""{_RULES}, ch AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS chunk_id, p_partkey AS seq, concat('[Rule: ', regexp_extract(text, '^(\d+\.\d+)', 1), ']', chr(10), text) AS text, embedding, regexp_extract(text, '^(\d+\.\d+)', 1) AS rule_number,
          concat(1 + p_partkey % 29, '.', p_partkey % 90 + 2) AS other, CASE p_partkey % 5 WHEN 0 THEN 'errata' WHEN 1 THEN 'variant' ELSE 'core_rules' END AS doc_type, p_partkey % 4 + 1 AS priority, concat('f', p_partkey % 3) AS source_file,
          CASE WHEN p_partkey % 6 = 0 THEN chr(CAST(65 + p_partkey % 11 AS INTEGER)) END AS scenario, p_partkey % 50 AS page FROM r JOIN embeddings ON vec_id = p_partkey),
          ix AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY priority, seq, secondary) AS rank FROM (SELECT rule_number AS rule, chunk_id, priority, seq, false AS secondary FROM ch UNION ALL SELECT other, chunk_id, priority, seq, true FROM ch))"""

_ASKED = "Which blue gear or ring does it take?"
_WORDS = ["blue", "gear", "ring", "take"]  # what text.keywords keeps of it; "take?" loses its mark


def looked_up(numbers: list[str], each: int | None, limit: int | None) -> str:
    wanted = ", ".join(f"('{r}', {i})" for i, r in enumerate(numbers))
    first = f"SELECT chunk_id, min(ord * 1000000 + rank) AS spot FROM ix JOIN (VALUES {wanted}) w(rule, ord) USING (rule) {f'WHERE rank <= {each}' if each else ''} GROUP BY 1"
    return f"(SELECT ch.*, NULL::DOUBLE AS distance, row_number() OVER (ORDER BY spot, ch.chunk_id) AS pos FROM ch JOIN ({first}) USING (chunk_id) {f'QUALIFY pos <= {limit}' if limit else ''})"


def routed(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT chunk_id, seq, text, rule_number, doc_type, priority, source_file, page, distance, pos + {1000 * i} AS pos FROM {p}" for i, p in enumerate(parts))


_NUMBERS = ["5.5", "3.3", "9.10"]
_ROUTES = {
    "direct_rule": [looked_up(_NUMBERS, None, 20), searched("ch", 0, _WORDS, 4)],
    "scenario": [searched("ch", 0, _WORDS, 10, "scenario = 'A'"), searched("ch", 0, _WORDS, 4)],
    "comparison": [looked_up(_NUMBERS, 10, None), searched("ch", 0, _WORDS, 4)],
    "variant": [searched("ch", 0, _WORDS, 6, "doc_type = 'variant'"), searched("ch", 0, _WORDS, 4)],
    "situation": [searched("ch", 0, _WORDS, 10)],
    "concept": [searched("ch", 3, ["blue", "bolt"], 6), searched("ch", 0, _WORDS, 8)],
}


def embedder(spark, d):
    """Embeddings of the two questions that are asked here."""
    return lambda q: vector_of(spark, d, 3 if q == "blue bolt" else 0)


@query(f"WITH {_CORPUS} SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{k}' AS kind, chunk_id, CAST(pos AS INTEGER) AS pos FROM ({routed(p)})''' for k, p in _ROUTES.items())})")
def route_kinds(spark, d):
    """The hits of each type of question, branch by branch."""
    chunks = corpus(spark, d)
    index, found = rule_index.rule_index(chunks), None
    for kind in _ROUTES:
        rows = retrieval.route(chunks, index, _ASKED, embedder(spark, d), kind, _NUMBERS, "A", ["blue bolt"] if kind == "concept" else [])
        rows = rows.select(F.lit(kind).alias("kind"), "chunk_id", F.col("pos").cast("int").alias("pos"))
        found = rows if found is None else found.unionByName(rows)
    return found


_FIRST = {n: f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY substring(text, 1, {n}) ORDER BY pos) AS k FROM hits) WHERE k = 1" for n in (200, 100)}
_REFERENCES = r"""SELECT ref, min(spot) AS spot FROM (SELECT regexp_extract(text, '\[(\d+\.\d+)\]', 1) AS ref, pos * 10 AS spot FROM {docs} UNION ALL SELECT regexp_extract(text, 'see (\d+\.\d+)', 1), pos * 10 + 1 FROM {docs}) WHERE ref <> '' {but} GROUP BY ref ORDER BY spot, ref LIMIT 5"""
_HEAD = "concat('[Source: ', source_file, ' | Type: ', doc_type, ' | Rule: ', rule_number, ' | Page: ', page, ']', chr(10), text)"


def answered(kind: str, preset: str) -> str:
    prefix, entries = (200, 1) if preset == "rules" else (100, 2)
    order = "round(coalesce(distance, 0.5) + 0.05 * priority, 6), pos" if preset == "rules" else "priority, pos"
    few = "" if preset == "rules" else "QUALIFY n <= 12"
    but = "AND ref NOT IN (SELECT rule_number FROM docs)" if preset == "rules" else ""
    docs = "docs" if preset == "rules" else "(SELECT * FROM docs WHERE pos <= 10)"
    return f"""WITH {_CORPUS}, hits AS ({routed(_ROUTES[kind])}), docs AS (SELECT * EXCLUDE (pos, n), n AS pos FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM ({_FIRST[prefix]}) {few})),
          refs AS ({_REFERENCES.format(docs=docs, but=but)}),
          chased AS (SELECT ch.*, 10000 + row_number() OVER (ORDER BY spot, refs.ref, rank, chunk_id) AS pos FROM refs JOIN ix ON ix.rule = refs.ref AND ix.rank <= {entries} JOIN ch USING (chunk_id) {'' if preset == 'rules' else 'QUALIFY pos <= 10004'}),
          every AS (SELECT chunk_id, text, rule_number, doc_type, priority, source_file, page, pos FROM docs UNION ALL SELECT chunk_id, text, rule_number, doc_type, priority, source_file, page, pos FROM chased),
          odd AS (SELECT rule_number, list(doc_type ORDER BY priority, pos, doc_type) AS t, min(priority) AS p FROM every GROUP BY 1 HAVING count(DISTINCT doc_type) > 1),
          said AS (SELECT string_agg({_HEAD}, concat(chr(10), '---', chr(10)) ORDER BY pos) AS c FROM (SELECT * FROM every ORDER BY pos LIMIT 30))
          SELECT 'document' AS part, chunk_id AS what, CAST(pos AS VARCHAR) AS value FROM docs UNION ALL SELECT 'reference', chunk_id, CAST(pos AS VARCHAR) FROM chased UNION ALL SELECT 'conflict', rule_number, concat('CONFLICT ON RULE ', rule_number, ': Multiple sources found. The authoritative version is from ''', t[1], ''' (priority ', p, '). Other versions from: ', array_to_string(t[2:], ', '), '.') FROM odd
          UNION ALL SELECT 'context', 'md5', md5(c) FROM said"""


def whole_answer(spark, d, kind: str, preset: str) -> DataFrame:
    chunks = shared.saved(corpus(spark, d), "chunks")  # each branch reads them and their index again
    index = shared.saved(rule_index.rule_index(chunks), "index")
    asked = {"query_type": kind, "rule_numbers": _NUMBERS, "scenario": "A", "sub_queries": ["blue bolt"] if kind == "concept" else []}
    found = retrieval.answer_context(chunks, index, _ASKED, embedder(spark, d), asked, preset=preset)
    row = lambda part, what, value: [F.lit(part).alias("part"), F.col(what).alias("what"), value.cast("string").alias("value")]
    rows = found["documents"].select(*row("document", "chunk_id", F.col("pos")))
    rows = rows.unionByName(found["references"].select(*row("reference", "chunk_id", F.col("pos"))))
    rows = rows.unionByName(found["conflicts"].select(*row("conflict", "rule_number", F.col("note"))))
    return rows.unionByName(found["context"].select(F.lit("context").alias("part"), F.lit("md5").alias("what"), F.md5("context").alias("value")))


@query(answered("comparison", "rules"))
def answer_rules(spark, d):
    """Documents, chased references, conflicts and context of a question about rules."""
    return whole_answer(spark, d, "comparison", "rules")


@query(answered("concept", "profile"))
def answer_profile(spark, d):
    """The same by a profile: order by priority, 12 documents and 4 references."""
    return whole_answer(spark, d, "concept", "profile")


_POLICY = {"carrier": "source", "n": "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT)", "doc_id": "doc_id", "section": "CASE WHEN lang <> 'de' THEN lang END", "page": "CAST(doc_id % 7 AS INT)", "source": "concat(source, '.pdf')", "text": "concat('[Carrier: ', source, '] ', coalesce(text, ''), ' see page ', CAST(doc_id % 5 AS STRING), ' and Pages 3')"}
_POLICIES = f"p AS ({select('documents', _POLICY)}), ch AS (SELECT concat(carrier, '_chunk_', n) AS chunk_id, p.*, n AS seq, embedding FROM p JOIN embeddings ON vec_id = doc_id)"
_FOUND = searched("ch", 0, ["thing", "combat"], 4, "carrier IN ('src1', 'src4')")


def policies(spark, d) -> DataFrame:
    rows = made(spark, d, "documents", _POLICY)
    return rows.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(F.concat("carrier", F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), "carrier", "source", "section", "page", "text", "embedding", F.col("n").alias("seq"))


_WIDE = f"""WITH {_POLICIES}, hits AS {_FOUND}, bare AS (SELECT carrier, n, regexp_replace(text, '^\\[Carrier:.*?\\]\\s*', '') AS t FROM ch),
          wide AS (SELECT h.* EXCLUDE (embedding), concat_ws(chr(10), b.t, h.text, a.t) AS expanded, min(pos) OVER (PARTITION BY h.carrier) AS carrier_pos FROM hits h LEFT JOIN bare b ON b.carrier = h.carrier AND b.n = h.n - 1 LEFT JOIN bare a ON a.carrier = h.carrier AND a.n = h.n + 1)"""


def policy_hits(spark, d, chunks: DataFrame) -> DataFrame:
    return retrieval.search_policies(chunks, "Which thing is the combat coverage?", vector_of(spark, d, 0), ["src1", "src4"])


@query(_WIDE + " SELECT carrier, chunk_id, md5(expanded) AS expanded, CAST(pos AS INTEGER) AS pos, CAST(carrier_pos AS INTEGER) AS carrier_pos FROM wide")
def policy_search(spark, d):
    """Hits of two carriers, four for both, with their neighbours' texts."""
    found = policy_hits(spark, d, policies(spark, d))
    return found.select("carrier", "chunk_id", F.md5("expanded").alias("expanded"), "pos", "carrier_pos")


@query(_WIDE + r""", said AS (SELECT chunk_id, carrier, source, carrier_pos, pos, i - 1 AS ord, CAST(list_extract(l, i) AS INTEGER) AS ref FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, regexp_extract_all(expanded, '(?i)(?:page|pages)\s+(\d+)', 1) AS l FROM wide))),
          new AS (SELECT carrier, ref, arg_min(source, (carrier_pos, pos, ord)) AS source, min((carrier_pos, pos, ord)) AS spot FROM said s WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.carrier = s.carrier AND w.page = s.ref) GROUP BY 1, 2),
          body AS (SELECT new.carrier, ref, spot, concat('=== CROSS-REFERENCE: ', new.carrier, ' Page ', ref, ' (from ', new.source, ') ===', chr(10), string_agg(text, chr(10) ORDER BY seq, text), chr(10)) AS t FROM new JOIN ch ON ch.carrier = new.carrier AND ch.page = new.ref GROUP BY new.carrier, ref, spot, new.source),
          items AS (SELECT row_number() OVER (ORDER BY is_reference, spot, carrier) AS n, * FROM (SELECT carrier, false AS is_reference, (carrier_pos, pos, 0) AS spot, concat('--- ', carrier, ' | Section: ', coalesce(section, ''), ' | Page ', page, ' ---', chr(10), expanded) AS t FROM wide UNION ALL SELECT carrier, true, spot, t FROM body)),
          kept AS (SELECT *, coalesce(sum(length(t)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items)
          SELECT CAST(n AS INTEGER) AS n, carrier, is_reference, md5(t) AS hash FROM kept WHERE NOT is_reference OR before <= 9000""")
def policy_context(spark, d):
    """Hits, then the pages that they refer to, within a budget of characters."""
    chunks = policies(spark, d)
    found = retrieval.policy_context(policy_hits(spark, d, chunks), chunks, 9000)["items"]
    return found.select("n", "carrier", "is_reference", F.md5("text").alias("hash"))


_ROOM = {"id": "vec_id", "neighborhood": "concat('area ', CAST(vec_id % 6 AS STRING))", "room_type": "CASE WHEN vec_id % 2 = 0 THEN 'Entire home/apt' ELSE 'Shared room' END", "price": "CAST(vec_id % 300 AS INT)", "rating": "CAST(vec_id % 6 AS INT)", "review_text": "concat('label ', CAST(label AS STRING))", "embedding": "embedding"}


@query(f"""WITH l AS ({select('embeddings', _ROOM)}), s AS (SELECT *, round(list_cosine_distance(embedding::DOUBLE[], {_VECTOR.format(0)}), 6) AS distance FROM l)
          SELECT how, id, concat('- Listing ', id, ' in ', neighborhood, ': ', room_type, ' at $', price, ' (Rating: ', rating, '). Review: ', review_text) AS line FROM
          (SELECT * FROM (SELECT 'both' AS how, * FROM s WHERE price <= 150 AND rating >= 4 ORDER BY distance, id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'none' AS how, * FROM s ORDER BY distance, id LIMIT 3)
           UNION ALL SELECT * FROM (SELECT 'ten' AS how, * FROM s WHERE price <= 150 ORDER BY distance, id LIMIT 10))""")
def listing_search(spark, d):
    """The three nearest listings within the bounds of a question, and of one without; ten below a price; none at $0."""
    rows = made(spark, d, "embeddings", _ROOM)
    embed = lambda q: vector_of(spark, d, 0)
    both = retrieval.answer_listings(rows, "A quiet place under $150 with a rating of at least 4", embed)["listings"]
    none = retrieval.answer_listings(rows, "A quiet place", embed)["listings"]
    empty = retrieval.answer_listings(rows, "A place up to $0 with a rating of at least 9", embed)
    if empty["context"] != fixed.NOTHING_FOUND["listings"]:
        raise AssertionError(empty["context"])
    ten = retrieval.search_listings(rows, vector_of(spark, d, 0), price_max=150, k=10)
    named = lambda how, df: df.select(F.lit(how).alias("how"), "id", "line")
    return named("both", both).unionByName(named("none", none)).unionByName(named("ten", ten)).unionByName(named("empty", empty["listings"]))


@query(f"SELECT md5(string_agg(text, concat(chr(10), chr(10)) ORDER BY distance, doc_id)) AS context FROM (SELECT doc_id, coalesce(text, '') AS text, round(list_cosine_distance(embedding::DOUBLE[], {_VECTOR.format(5)}), 6) AS distance FROM embeddings JOIN documents ON vec_id = doc_id ORDER BY distance, doc_id LIMIT 20)")
def ontology_context(spark, d):
    """The texts of the 20 chunks nearest to a fixed question, as one: what an ontology is made from."""
    rows = read(spark, d, "embeddings").join(read(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    few = vector.top_k(rows, vector_of(spark, d, 5), 20)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("distance", "vec_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return few.agg(F.md5(F.array_join(lines, "\n\n")).alias("context"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 END, 9), doc_id) AS n FROM documents) WHERE n <= 50")
def priority_order(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 9).alias("priority"))
    return retrieval.priority_order(rows).limit(50).select("doc_id")


@query("SELECT c_custkey AS k, CAST(CASE WHEN n = 0 THEN 5 WHEN n <= 2 THEN 4 ELSE 6 END AS INTEGER) AS n FROM (SELECT c_custkey, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def result_counts(spark, d):
    """How many results a question gets that names so many carriers: for each customer, the kinds of its orders."""
    asked = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count_distinct("o_orderpriority").alias("carriers"))
    return asked.select(F.col("c_custkey").alias("k"), retrieval.result_counts(F.col("carriers")).cast("int").alias("n"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0)
          SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def coded_topk(spark, d):
    """The ten nearest rows of every hundredth row by stored product codes: all rows that the codes don't rule out are ranked."""
    rows = read(spark, d, "embeddings")
    book, path = codes.fit(rows), shared.fresh_path(spark, "codes")
    codes.encoded(rows, book).write.parquet(path)
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = codes.exact_top_k(spark.read.parquet(path), book, rows, asked, 10)
    return found.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


_HINT = {"k": "p_partkey", "sources": "array(concat('The_', p_brand), p_name, p_type, 'x', 'y', 'HINT')", "hint": "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'hint' ELSE '_brand' END"}


@query(f"SELECT k, len(list_filter(sources[1:5], lambda s: contains(lower(s), lower(hint)))) > 0 AS hit FROM ({select('part', _HINT).replace('array(', 'list_value(')})")
def source_hints(spark, d):
    return made(spark, d, "part", _HINT).select("k", evaluation.hint_in_top(F.col("sources"), F.col("hint")).alias("hit"))


@query("SELECT CAST(sum(quality) AS BIGINT) AS found, CAST(sum(quality + toxic) AS BIGINT) AS expected, round(sum(quality) / greatest(sum(quality + toxic), 1), 6) AS recall FROM labels")
def keyword_recall(spark, d):
    words = lambda c: F.when(F.col(c) == 1, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return evaluation.keyword_recall(read(spark, d, "labels").select(words("quality").alias("keywords_found"), words("toxic").alias("keywords_missing")))


@query("SELECT * FROM (VALUES ('broken', 'FAILED', NULL), ('labels', 'PASSED', (SELECT count(*) FROM labels)), ('documents', 'PASSED', (SELECT count(*) FROM documents))) t(suite, status, cases)")
def suites(spark, d):
    """A run of suites: one that fails doesn't stop the others."""
    def broken():
        raise ValueError("no such table")

    found = evaluation.run_suites(spark, {"broken": broken, "labels": lambda: read(spark, d, "labels"), "documents": lambda: read(spark, d, "documents")})
    return found.select("suite", "status", "cases")


#: A sheet's spans by their number on it: text, left, top, right, bottom. {g}: the sheet's number.
_ROLES = [
    ("CASE WHEN {g} % 5 > 0 THEN 'Type: ship' ELSE 'Kind' END", 10, 10, 40, 18), ("p_name", 60, 12, 90, 19), ("'far right'", 200, 12, 240, 19), ("CASE WHEN {g} % 3 > 0 THEN 'Maximum' ELSE 'Least' END", 100, 100, 120, 108), ("CAST(p_partkey % 9 AS STRING)", 540, 170, 548, 178),
    ("CASE WHEN {g} % 4 > 0 THEN p_brand ELSE '77' END", 20, 220, 50, 228), ("'Front'", 60, 220, 70, 228), ("CAST(p_size AS STRING)", 100, 220, 110, 228), ("'12-15'", 150, 220, 160, 228), ("concat(' ', p_type, ' ')", 195, 220, 220, 228),
    ("'Left'", 250, 220, 260, 228), ("'6'", 300, 220, 310, 228), ("CAST(p_size AS STRING)", 90, 20, 99, 28), ("CAST(p_size % 7 AS STRING)", 330, 25, 340, 33), ("'TVLG Missile'", 20, 60, 50, 68),
    ("'SMLM Missile'", 20, 80, 50, 88), ("'Engine'", 70, 130, 95, 138), ("p_type", 150, 150, 300, 158), ("'99'", 540, 400, 548, 408), ("'   '", 100, 20, 110, 28),
]
_G = "CAST(floor(p_partkey / 20) AS BIGINT)"
_PLACE = lambda i: "CASE p_partkey % 20 " + " ".join(f"WHEN {k} THEN {r[i]}" for k, r in enumerate(_ROLES)) + " END"
_SHEET = {"doc": _G, "seq": "p_partkey", "text": _PLACE(0).replace("{g}", _G), **{c: f"CAST({_PLACE(i + 1)} AS DOUBLE)" for i, c in enumerate(("x0", "y0", "x1", "y1"))}}
_UNIT = f"s AS (SELECT doc, seq, trim(text) AS text, x0, y0, x1, y1, (x0 + x1) / 2 AS xc, (y0 + y1) / 2 AS yc FROM ({select('part', _SHEET)}) WHERE trim(text) <> '' AND y1 < 265)"


def sheets(spark, d) -> DataFrame:
    return layout.first_unit(made(spark, d, "part", _SHEET))


_NAMED = "n AS (SELECT s.doc, arg_min(s.text, (s.x0, s.seq)) AS name FROM s JOIN (SELECT doc, arg_min(x1, seq) AS x, arg_min(yc, seq) AS y FROM s WHERE contains(text, 'Type:') GROUP BY 1) t ON s.doc = t.doc WHERE abs(s.yc - t.y) < 10 AND s.x0 > t.x GROUP BY 1)"
_THRUST = r"t AS (SELECT doc, arg_min(TRY_CAST(text AS INTEGER), seq) FILTER (WHERE regexp_matches(text, '^\d+$') AND x0 > 530 AND y0 > 160) AS max_thrust FROM s GROUP BY 1 HAVING bool_or(contains(text, 'Maximum') OR contains(text, 'Thrust') AND x0 > 500) AND max_thrust IS NOT NULL)"


@query(f"WITH {_UNIT}, {_NAMED} SELECT * FROM n")
def sheet_names(spark, d):
    return layout.names(sheets(spark, d))


@query(f"WITH {_UNIT}, {_THRUST} SELECT * FROM t")
def sheet_thrust(spark, d):
    return layout.thrust(sheets(spark, d))


_ARMED = r"""w AS (SELECT doc, CAST(round_even(yc / 5, 0) * 5 AS INTEGER) AS row, CASE WHEN xc < 190 THEN 1 WHEN xc > 190 AND xc < 340 THEN 2 END AS half, text, x0, seq FROM s WHERE y0 > 215 AND y0 < 265),
          g AS (SELECT doc, row FROM w GROUP BY 1, 2 HAVING count(*) >= 3), h AS (SELECT doc, row, half, list(text ORDER BY x0, seq) AS l FROM w JOIN g USING (doc, row) WHERE half IS NOT NULL GROUP BY 1, 2, 3),
          a AS (SELECT doc, row, CAST(half AS INTEGER) AS half, l[1] AS name, l[2] AS location, l[3] AS damage, coalesce(l[4], 'N/A') AS range FROM h WHERE len(l) >= 3 AND NOT regexp_matches(l[1], '^\d+$'))"""


@query(f"WITH {_UNIT}, {_ARMED} SELECT * FROM a")
def sheet_weapons(spark, d):
    return layout.weapons(sheets(spark, d))


_ROCKETS = "m AS (SELECT DISTINCT doc, trim(replace(text, 'Missile', '')) AS type, CAST(CASE WHEN contains(text, 'TVLG') THEN 4 ELSE 1 END AS INTEGER) AS count FROM s WHERE x0 < 60 AND y0 > 30 AND y0 < 150 AND trim(replace(text, 'Missile', '')) <> '')"


@query(f"WITH {_UNIT}, {_ROCKETS} SELECT * FROM m")
def sheet_missiles(spark, d):
    return layout.missiles(sheets(spark, d))


def gridded(a: int, b: int, width: int) -> str:
    step = f"({b - a} / {width}::DOUBLE)"
    first = f"least(greatest(CAST(trunc((x0 - {a}) / {step}) AS BIGINT), 0), {width - 1})"
    return rf"""(SELECT e.doc, e.c AS "column", list_resize(coalesce(l, []), 10, 'Empty') AS cells FROM (SELECT DISTINCT doc, unnest(range(0, {width})) AS c FROM s) e LEFT JOIN
          (SELECT doc, c, list(text ORDER BY yc, seq, text) AS l FROM (SELECT *, unnest(range({first}, greatest(least(CAST(trunc((x1 - {a}) / {step}) AS BIGINT), {width - 1}), {first}) + 1)) AS c FROM s
           WHERE yc > 115 AND yc < 200 AND NOT regexp_matches(text, '^\d+$') AND xc BETWEEN {a - 10} AND {b + 10}) GROUP BY 1, 2) x ON x.doc = e.doc AND x.c = e.c)"""


@query(f"WITH {_UNIT} " + " UNION ALL ".join(f"""SELECT '{n}' AS grid, doc, CAST("column" AS INTEGER) AS "column", array_to_string(cells, '|') AS cells FROM {gridded(a, b, w)}""" for n, a, b, w in fixed.GRIDS))
def sheet_grids(spark, d):
    own, found = sheets(spark, d), None
    for name, a, b, width in fixed.GRIDS:
        rows = layout.grid(own, a, b, width).select(F.lit(name).alias("grid"), "doc", "column", F.array_join("cells", "|").alias("cells"))
        found = rows if found is None else found.unionByName(rows)
    return found


_WHOLE_SHEETS = rf"""WITH {_UNIT}, {_NAMED}, {_THRUST}, {_ARMED}, {_ROCKETS}, f AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in fixed.FACINGS)}) x(facing, lo, hi)),
          v AS (SELECT doc, facing, arg_min(CAST(text AS INTEGER), seq) AS sf FROM s JOIN f ON xc BETWEEN lo AND hi WHERE regexp_matches(text, '^\d+$') AND y0 > 15 AND y0 < 35 GROUP BY 1, 2)
          SELECT e.doc, 'vehicle' AS entity_type, coalesce(n.name, 'Unknown') AS name, CAST(max_thrust AS VARCHAR) AS thrust, CAST(9 AS INTEGER) AS n_grids,
          (SELECT string_agg(concat(f.facing, '=', coalesce(v.sf, 0)), ',' ORDER BY f.facing) FROM f LEFT JOIN v ON v.facing = f.facing AND v.doc = e.doc) AS armour,
          coalesce((SELECT string_agg(concat_ws('/', a.name, location, damage, range), ',' ORDER BY row, half, a.name) FROM a WHERE a.doc = e.doc), '') AS weapons, coalesce((SELECT string_agg(concat(type, 'x', count), ',' ORDER BY type) FROM m WHERE m.doc = e.doc), '') AS missiles
          FROM (SELECT DISTINCT doc FROM s) e LEFT JOIN n USING (doc) LEFT JOIN t USING (doc)"""


def shown(back: DataFrame) -> DataFrame:
    """Entities as flat rows."""
    weapons = F.array_join(F.transform(F.col("collections.Weapons"), lambda w: F.concat_ws("/", w["Name"], w["Location"], w["Damage"], w["Range"])), ",")
    missiles = F.array_join(F.transform(F.col("collections.Missiles"), lambda m: F.concat(m["Type"], F.lit("x"), m["Count"].cast("string"))), ",")
    shields = F.array_sort(F.transform(F.filter(F.map_entries("grids"), lambda e: e["value"]["SF"].isNotNull()), lambda e: F.concat(e["key"], F.lit("="), e["value"]["SF"].cast("string"))))
    return back.select("doc", "entity_type", "name", F.col("attributes")["Maximum Thrust"].alias("thrust"), F.size("grids").alias("n_grids"), F.array_join(shields, ",").alias("armour"), weapons.alias("weapons"), missiles.alias("missiles"))


@query(_WHOLE_SHEETS)
def sheet_entities(spark, d):
    """Whole entities, written as JSON and read again."""
    path = shared.fresh_path(spark, "entities")
    made_ = layout.entities(made(spark, d, "part", _SHEET))
    collections.write_json(made_, path)
    back = spark.read.schema(made_.schema).json(path)
    return shown(back)


_FONT = {"doc": "CAST(s_nationkey AS STRING)", "page": "CAST(s_suppkey % 30 AS INT)", "size": "8 + (s_suppkey % 4) / 2.04", "text": "s_name"}


@query(f"WITH f AS ({select('supplier', _FONT)}), g AS (SELECT doc, round_even(CAST(size AS DOUBLE), 1) AS s, sum(length(text)) AS n FROM f WHERE page <= 15 GROUP BY 1, 2) SELECT d.doc, coalesce(arg_max(s, (n, -s)), 10.0) AS body_size FROM (SELECT DISTINCT doc FROM f) d LEFT JOIN g ON g.doc = d.doc GROUP BY d.doc")
def body_sizes(spark, d):
    return chunking.body_size(made(spark, d, "supplier", _FONT | {"size": "CAST(8 + (s_suppkey % 4) / 2.04 AS DOUBLE)"}))


_BOOK = {"source_file": "concat(CASE p_partkey % 4 WHEN 0 THEN 'Errata ' WHEN 1 THEN 'codex ' WHEN 2 THEN 'plain ' ELSE 'Journal ' END, CAST(p_partkey % 8 AS STRING), '.pdf')", "page": "CAST(floor(p_partkey / 8) AS INT) + 1", "text": f"CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(1 + p_partkey % 20 AS STRING), '.', CAST(p_partkey % 90 AS STRING), ' ', p_name) WHEN p_partkey % 3 = 1 THEN 'Scenario B. The Fire Power (FP) is known, and that is long enough for a title' ELSE 'SSR' END"}


@query(rf"""WITH p AS ({select('part', _BOOK)}), n AS (SELECT source_file, max(page) AS n FROM p GROUP BY 1), m AS (SELECT p.* FROM p JOIN n USING (source_file) WHERE page IN (1, 2, 3, 4, least(11, n), n // 4 + 1, n // 2 + 1)),
          v AS (SELECT sum(len(regexp_extract_all(text, '(?m)(?:^|\n)\s*(\d{{1,2}}\.\d{{1,3}}(?:\.\d{{1,2}})?)\b'))) AS numeric, sum(len(regexp_extract_all(text, '(?im)Scenario\s+[A-K]\b|^[A-K][.:]\s+[A-Z]'))) AS a, sum(len(regexp_extract_all(text, '(?im)ASL\s+\d+|Scenario\s+\d+|^(?:Scenario\s+)?\d+[.:]'))) AS b, sum(len(regexp_extract_all(text, '(?im)SCENARIO\s+DESIGN|Special\s+Scenario\s+Rules|SSR'))) AS c FROM m)
          SELECT DISTINCT 'the_books' AS game_id, CASE WHEN numeric > 0 THEN 'numeric_decimal' ELSE 'chapter_decimal' END AS rule_schema, CASE WHEN a >= b AND a >= c THEN 'letter' WHEN b >= c THEN 'numeric' ELSE 'named' END AS scenario_format, CAST(numeric AS BIGINT) AS hits,
          source_file, CASE WHEN contains(source_file, 'Errata') THEN 'errata' WHEN contains(source_file, 'codex') THEN 'codex' WHEN contains(source_file, 'Journal') THEN 'journal' ELSE 'unknown' END AS doc_type,
          CASE WHEN contains(source_file, 'Errata') THEN 3 WHEN contains(source_file, 'codex') THEN 2 WHEN contains(source_file, 'Journal') THEN 6 ELSE 9 END AS priority, 'FP: The Fire Power' AS glossary FROM p, v""")
def profile_files(spark, d):
    """A corpus's profile, written as JSON and read again."""
    path = shared.fresh_path(spark, "profile")
    found = profile.discovered(made(spark, d, "part", _BOOK), "The Books!")
    collections.write_json(profile.profile_row(found), path)
    read_ = collections.read_profile(spark, path)
    rows = spark.createDataFrame([(x["source_file"], x["doc_type"], x["priority"]) for x in read_["documents"]], "source_file string, doc_type string, priority int")
    glossary = ",".join(x for x in read_["glossary"] if x.startswith("FP: "))
    return rows.select(F.lit(read_["game_id"]).alias("game_id"), F.lit(read_["rule_schema"]).alias("rule_schema"), F.lit(read_["scenario_format"]).alias("scenario_format"), F.lit(read_["schema_detection_scores"][read_["rule_schema"]]).cast("bigint").alias("hits"), "source_file", "doc_type", "priority", F.lit(glossary).alias("glossary"))
