"""The operators as queries over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import conversations, decontamination, language, minhash, packing, pii, substring_dedup, suffix_dedup, token_counts, topk, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=1024)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.summary(conversations.damaged(table(spark, sf_dir, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.drop("lang"), language.train(docs))
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, size: int = 8) -> str:
    """Lloyd's rounds as one expression after another: a is the assignment and b the codebooks of each round."""
    steps = [f"""
        k AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        v AS (SELECT vec_id, label, p, x[p * {size} + 1:(p + 1) * {size}] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v QUALIFY e < {entries})"""]
    nearest = "min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {n} + e)"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, v.p, x, {nearest.format(n=entries)} AS de FROM v JOIN b{r} ON v.p = b{r}.p GROUP BY vec_id, label, v.p, x)")
        if r < rounds:
            each = ", ".join(f"CAST((sum(x[{j}]) - (sum(x[{j}]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, size + 1))
            steps.append(f"""m{r} AS (SELECT p, de % {entries} AS e, [{each}] AS c FROM a{r} GROUP BY p, de % {entries}),
        b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
        WITH {", ".join(steps)},
        f AS (SELECT vec_id, label, string_agg(printf('%02x', de % {entries}), '' ORDER BY p) AS code, CAST(sum(de // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h
    """


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_suffixes": op5_suffixes,
    "op6_topk": op6_topk,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_minhash": op10_minhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL = {
    "op13_conversations": r"""
        WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 20 AS kind FROM conversations, crc),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
        f AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
        g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
        s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                     count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last,
                     list(struct_pack(role := role, text := text, initial := initial, fault := fault) ORDER BY i) AS rows FROM g GROUP BY conv_id),
        -- states: 0 nothing yet, 1 after the system's, 2 the user's, 3 the assistant's turn; up to two rows inserted before a row
        ins AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) AS x(a, b, audit)),
        own AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS x(a, b, role)),
        moves AS (SELECT ins.a, own.b, ins.audit, 3 * len(ins.audit) AS cost, own.role FROM ins JOIN own ON ins.b = own.a),
        best AS (SELECT conv_id, 0 AS i, 0 AS state, '000000000' AS value FROM s
            UNION ALL
            SELECT conv_id, i + 1, b, min(value) FROM (
                SELECT p.conv_id, p.i, m.b, printf('%09d', CAST(left(p.value, 9) AS BIGINT) + m.cost + m.more) || substr(p.value, 10) || m.audit AS value
                FROM best p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i < s.last,
                LATERAL (SELECT p.state AS b, 4 AS cost, 'D' AS audit, 0 AS more
                         UNION ALL SELECT b, cost, audit || 'K', CASE WHEN rows[p.i + 1].fault = 'truncated' THEN 3 ELSE 0 END FROM moves WHERE a = p.state AND role = rows[p.i + 1].initial AND rows[p.i + 1].fault NOT IN ('blank', 'duplicate')
                         UNION ALL SELECT b, cost + 3, audit || 'R', CASE WHEN rows[p.i + 1].fault = 'truncated' THEN 3 ELSE 0 END FROM moves WHERE a = p.state AND role <> 's' AND rows[p.i + 1].fault NOT IN ('blank', 'duplicate')) m)
            GROUP BY conv_id, i, b),
        e AS (SELECT conv_id, min(printf('%09d', CAST(left(value, 9) AS BIGINT) + 3 * len(more)) || substr(value, 10) || more) AS value
              FROM (SELECT s.conv_id, value, CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS more FROM best JOIN s ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = s.last) GROUP BY conv_id),
        a AS (SELECT s.conv_id, rows, CAST(left(value, 9) AS BIGINT) AS cost, substr(value, 10) AS audit FROM e JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id),
        t AS (SELECT conv_id, rows, k, audit[k] AS edit, k - (len(left(audit, k)) - len(replace(left(audit, k), 'I', ''))) AS r, k - (len(left(audit, k)) - len(replace(left(audit, k), 'D', ''))) AS place FROM a, LATERAL (SELECT unnest(range(1, len(audit) + 1)) AS k)),
        w AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND rows[r].initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS headed FROM t),
        o AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN rows[r].role ELSE CASE WHEN (place + headed) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE rows[r].text END, chr(10) ORDER BY k) AS whole
              FROM w WHERE edit <> 'D' GROUP BY conv_id)
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op11_vector_codes": lloyd_sql(),
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM m
    """,
    "op4_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, n, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM h) WHERE doc_id > first_id),
        g AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM r GROUP BY doc_id),
        c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 50)))) AS gone FROM g),
        k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                     CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END AS kept
              FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op10_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
        k AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN k ON k.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        l AS (SELECT DISTINCT n FROM q),
        s AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS k FROM d, l WHERE len(w) >= l.n)),
        h AS (SELECT s.doc_id, s.k, s.n, q.item_id FROM s JOIN q ON s.t = q.t AND s.n = q.n),
        g AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
        j AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN j ON d.doc_id = j.doc_id
    """,
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
