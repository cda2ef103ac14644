"""Tables of questions as queries: every item of `benchmark` is routed, retrieved for, answered and judged in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, models
from ..operators import questions as asked
from ..operators import rule_index
from ..sources.replies import Replies
from ..sources.shared import fresh_path, saved
from .details import made, select
from .queries import _STOP, query, read
from .searches import _CORPUS, _HEAD, corpus

_KINDS = ["direct_rule", "scenario", "comparison", "variant", "situation", "concept"]


def items(spark, d) -> DataFrame:
    """The items of benchmark as questions: embeddings are those of the rows of their number, kinds take turns."""
    k = F.col("item_id")
    vectors = read(spark, d, "embeddings")
    rows = read(spark, d, "benchmark").join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    rows = rows.join(vectors.select((F.col("vec_id") - 1).alias("item_id"), F.col("embedding").alias("next")), "item_id").join(read(spark, d, "part").select((F.col("p_partkey") - 1).alias("item_id"), "p_name"), "item_id")
    number = lambda j: F.concat((1 + (k + j) % 29).cast("string"), F.lit("."), ((k + j) % 90 + 1).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int"))
    sub = F.array(F.struct(F.col("p_name").alias("query"), F.col("next").cast("array<double>").alias("embedding")))
    return rows.select(k.alias("question_id"), F.concat_ws(" ", "text", "p_name").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"), kind.alias("query_type"), F.when(k % 7 > 0, F.array(number(1), number(4), number(1), F.lit("9.10"))).alias("rule_numbers"), F.when(k % 4 > 0, F.char(65 + k % 11)).alias("scenario"), F.when(kind == "concept", sub).alias("sub_queries"))


_ITEMS = rf"""{_CORPUS},
    q AS (SELECT item_id, concat_ws(' ', b.text, p_name) AS query, p_name, e.embedding::DOUBLE[] AS embedding, n.embedding::DOUBLE[] AS next, ['{"', '".join(_KINDS)}'][CAST(item_id % 6 + 1 AS INTEGER)] AS kind, item_id % 7 > 0 AS numbered,
                 [concat(1 + (item_id + 1) % 29, '.', (item_id + 1) % 90 + 1), concat(1 + (item_id + 4) % 29, '.', (item_id + 4) % 90 + 1), '9.10'] AS rules, CASE WHEN item_id % 4 > 0 THEN chr(CAST(65 + item_id % 11 AS INTEGER)) END AS scenario
          FROM benchmark b JOIN embeddings e ON e.vec_id = item_id JOIN embeddings n ON n.vec_id = item_id + 1 JOIN part ON p_partkey = item_id + 1),
    br AS (SELECT item_id, 0 AS branch, 'search' AS how, 6 AS n, NULL AS what, NULL AS value, p_name AS query, next AS embedding FROM q WHERE kind = 'concept'
           UNION ALL SELECT item_id, CASE WHEN kind = 'concept' THEN 1 ELSE 0 END, CASE WHEN kind = 'direct_rule' AND numbered THEN 'lookup' WHEN kind = 'comparison' AND numbered THEN 'each' ELSE 'search' END,
                CASE WHEN kind = 'direct_rule' AND numbered THEN 20 WHEN kind = 'scenario' AND scenario IS NOT NULL OR kind = 'comparison' AND numbered OR kind = 'situation' THEN 10 WHEN kind = 'variant' THEN 6 ELSE 8 END,
                CASE WHEN kind = 'scenario' AND scenario IS NOT NULL THEN 'scenario' WHEN kind = 'variant' THEN 'doc_type' END, CASE WHEN kind = 'variant' THEN 'variant' ELSE scenario END, query, embedding FROM q
           UNION ALL SELECT item_id, 1, 'search', 4, NULL, NULL, query, embedding FROM q WHERE kind IN ('direct_rule', 'comparison') AND numbered OR kind = 'variant' OR kind = 'scenario' AND scenario IS NOT NULL),
    kw AS (SELECT item_id, branch, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', '', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS words FROM br),
    near AS (SELECT br.item_id, branch, n, chunk_id, round(list_cosine_distance(ch.embedding::DOUBLE[], br.embedding), 6) AS distance, ch.text FROM br JOIN ch ON how = 'search' AND (what IS NULL OR what = 'scenario' AND ch.scenario = value OR what = 'doc_type' AND ch.doc_type = value)
             QUALIFY row_number() OVER (PARTITION BY br.item_id, branch ORDER BY distance, chunk_id) <= floor(2.5 * n)),
    found AS (SELECT near.item_id, branch, chunk_id, distance, row_number() OVER (PARTITION BY near.item_id, branch ORDER BY round(distance - round({fixed.KEYWORD_WEIGHT} * len(list_filter(words, lambda w: contains(lower(text), w))), 6), 6), distance, chunk_id) AS pos, n FROM near JOIN kw USING (item_id, branch) QUALIFY pos <= n),
    wanted AS (SELECT item_id, branch, how, n, rules[i] AS rule, i FROM br JOIN (SELECT item_id, rules FROM q) USING (item_id), range(1, 4) t(i) WHERE how <> 'search'),
    got AS (SELECT item_id, branch, how, n, chunk_id, min((i, rank)) AS spot FROM wanted JOIN ix USING (rule) WHERE how = 'lookup' OR rank <= n GROUP BY ALL),
    hits AS (SELECT item_id, branch, chunk_id, distance, pos FROM found UNION ALL SELECT item_id, branch, chunk_id, NULL, row_number() OVER (PARTITION BY item_id, branch ORDER BY spot, chunk_id) AS pos FROM got QUALIFY how = 'each' OR pos <= n)"""


@query(f"WITH {_ITEMS} SELECT item_id, chunk_id, CAST(1000 * branch + pos AS INTEGER) AS pos FROM hits")
def question_routes(spark, d):
    """The hits of every item, branch by branch."""
    chunks = saved(corpus(spark, d), "chunks")
    found = asked.route(chunks, saved(rule_index.rule_index(chunks), "index"), items(spark, d))
    return found.select(F.col("question_id").alias("item_id"), "chunk_id", F.col("pos").cast("int").alias("pos"))


@query(rf"""WITH {_ITEMS},
    once AS (SELECT item_id, ch.*, distance, 1000 * branch + pos AS pos FROM hits JOIN ch USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY item_id, substring(text, 1, 200) ORDER BY 1000 * branch + pos) = 1),
    docs AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(distance, 0.5) + 0.05 * priority, 6), pos) AS pos FROM once),
    refs AS (SELECT item_id, ref, min(spot) AS spot FROM (SELECT item_id, regexp_extract(text, '\[(\d+\.\d+)\]', 1) AS ref, pos * 10 AS spot FROM docs UNION ALL SELECT item_id, regexp_extract(text, 'see (\d+\.\d+)', 1), pos * 10 + 1 FROM docs) r
             WHERE ref <> '' AND NOT EXISTS (SELECT 1 FROM docs k WHERE k.item_id = r.item_id AND k.rule_number = ref) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(spot), ref) <= 5),
    chased AS (SELECT item_id, ch.*, 10000 + row_number() OVER (PARTITION BY item_id ORDER BY spot, rank, chunk_id) AS pos FROM refs JOIN ix ON ix.rule = ref AND rank <= 1 JOIN ch USING (chunk_id)),
    every AS (SELECT item_id, chunk_id, text, rule_number, doc_type, priority, source_file, page, pos FROM docs UNION ALL SELECT item_id, chunk_id, text, rule_number, doc_type, priority, source_file, page, pos FROM chased),
    odd AS (SELECT item_id, rule_number, list(doc_type ORDER BY priority, pos, doc_type) AS t, min(priority) AS p FROM every GROUP BY 1, 2 HAVING count(DISTINCT doc_type) > 1),
    notes AS (SELECT item_id, string_agg(concat('CONFLICT ON RULE ', rule_number, ': Multiple sources found. The authoritative version is from ''', t[1], ''' (priority ', p, '). Other versions from: ', array_to_string(t[2:], ', '), '.'), chr(10) ORDER BY rule_number) AS notes FROM odd GROUP BY 1),
    said AS (SELECT item_id, string_agg({_HEAD}, concat(chr(10), '---', chr(10)) ORDER BY pos) AS c FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 30) GROUP BY 1),
    told AS (SELECT q.item_id, query, c, CASE WHEN c IS NULL THEN '{fixed.NOTHING_FOUND["rules"]}' ELSE concat(split_part(c, chr(10), 1), ' [1]') END AS answer FROM q LEFT JOIN said USING (item_id))
    SELECT item_id, md5(c) AS context, coalesce(md5(notes), '') AS conflicts, answer, CASE WHEN c IS NULL THEN 'No' ELSE 'Yes' END AS faithfulness, CASE WHEN c IS NULL THEN 'No' ELSE 'Yes' END AS citation,
           CASE WHEN c IS NOT NULL AND len(list_intersect(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: length(w) > 3), regexp_split_to_array(lower(answer), '\s+'))) > 0 THEN 'Yes' ELSE 'No' END AS relevancy
    FROM told LEFT JOIN notes USING (item_id)""")
def question_answers(spark, d):
    """Context, conflicts, answer and verdicts of every item; the models are stand-ins, their replies are stored."""
    chunks, every = saved(corpus(spark, d), "chunks"), items(spark, d)
    found = asked.retrieved(chunks, saved(rule_index.rule_index(chunks), "index"), every)
    said = asked.answered(every, found, Replies(spark, fresh_path(spark, "replies")), models.first_source, models.lenient_judge)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_number", "note"))), lambda x: x["note"]), "\n")
    notes = found["conflicts"].groupBy("question_id").agg(F.md5(lines).alias("conflicts"))
    whole = said.join(notes, "question_id", "left")
    return whole.select(F.col("question_id").alias("item_id"), F.md5("context").alias("context"), F.coalesce("conflicts", F.lit("")).alias("conflicts"), "answer", *(F.col("verdicts")[a].alias(a) for a in fixed.ASPECTS))


_ASKED = {"k": "p_partkey", "query": "CASE p_partkey % 5 WHEN 0 THEN concat('What is rule ', CAST(1 + p_partkey % 29 AS STRING), '.', CAST(p_partkey % 90 AS STRING), ' of the ', p_name, '?') WHEN 1 THEN concat('Compare 3.1 with the ', p_name, ' of 2.', CAST(p_partkey % 8 AS STRING)) WHEN 2 THEN concat('Who wins scenario ', CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'H' END, ' with a ', p_name, '?') WHEN 3 THEN concat('Can my ', p_name, ' cross?') ELSE concat('Tell of the ', p_name) END"}

def told_by_patterns(prompts: list[str]) -> list[str]:
    """A stand-in for a model that classifies the question at the end of each prompt."""
    import json

    from ..functions import providers

    found = [providers.classified(p.rsplit("Question: ", 1)[1]) for p in prompts]
    return [f"It is so: {json.dumps(f)}" if f["query_type"] != "concept" else "I can't say." for f in found]


@query(f"""WITH q AS ({select('part', _ASKED)})
          SELECT k, CASE k % 5 WHEN 0 THEN 'direct_rule' WHEN 1 THEN 'comparison' WHEN 2 THEN 'scenario' WHEN 3 THEN 'situation' ELSE 'concept' END AS kind, array_to_string(list_distinct_in_order, ',') AS rules, CASE WHEN k % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN 'C' ELSE 'H' END END AS scenario, true AS asked
          FROM (SELECT k, CASE WHEN k % 5 < 2 THEN regexp_extract_all(query, '[0-9]+[.][0-9]+') ELSE [] END AS list_distinct_in_order FROM q)""")
def question_classes(spark, d):
    """Questions about all parts, put into classes by a stand-in for a model that is sent the prompt of a classification;
    what it can't say is a concept."""
    rows = made(spark, d, "part", _ASKED)
    prompt = models.classification_prompt("the books", F.col("query"), {"FP": "Fire Power"})
    said = Replies(spark, fresh_path(spark, "replies")).asked(rows.withColumn("asked", prompt.contains("Fire Power") & prompt.endswith(F.col("query"))), prompt, told_by_patterns)
    c = models.query_class(F.col("reply"))
    return said.select("k", c["query_type"].alias("kind"), F.array_join(c["rule_numbers"], ",").alias("rules"), c["scenario"].alias("scenario"), "asked")
