"""Files as queries: chunks by headings of larger type, entities of sheets, and texts that are nearly those of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import similar
from ..sources import spans
from ..sources.shared import saved
from .details import made, select
from .queries import query, read
from .searches import _SHEET, _WHOLE_SHEETS, shown


def files(rows: DataFrame, broken: str) -> DataFrame:
    """path and content of a file for each doc of span rows; docs that meet `broken` end in a line that is no span."""
    line = F.to_json(F.struct("page", "block", "line", "text", "size", "x0", "y0", "x1", "y1"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("j")))), lambda s: s["j"]), "\n")
    whole = F.when(F.expr(broken), F.concat("body", F.lit("\n{broken"))).otherwise(F.col("body"))
    return rows.groupBy("doc").agg(body.alias("body")).select(F.concat(F.lit("file:/in/"), F.col("doc").cast("string"), F.lit(".pdf")).alias("path"), whole.cast("binary").alias("content"))


_N = "o_orderkey % 60"
#: Documents of 60 lines: headings of two sizes, one known by its first word, small print, blanks, and bodies of any length.
_LINES = {
    "doc": "CAST(floor(o_orderkey / 60) AS BIGINT)",
    "n": f"CAST({_N} AS INT)",
    "page": f"CAST(1 + floor({_N} / 30) AS INT)",
    "block": f"CAST(floor(({_N}) / 5) AS INT)",
    "a": f"CASE o_orderkey % 20 WHEN 0 THEN 'Chapter ' WHEN 5 THEN 'Of what ' WHEN 10 THEN 'Section 8 ' WHEN 13 THEN 'a footnote ' WHEN 17 THEN '  ' ELSE repeat(concat(o_orderpriority, ' text '), CAST(o_orderkey * 7 % 25 AS INT)) END",
    "b": "CASE o_orderkey % 20 WHEN 17 THEN '' WHEN 13 THEN 'in small print' ELSE concat(o_orderstatus, CAST(o_custkey AS STRING)) END",
    "size": "CAST(CASE o_orderkey % 20 WHEN 0 THEN 15 WHEN 5 THEN 12 WHEN 13 THEN 6 ELSE CASE WHEN floor(o_orderkey / 60) % 9 = 4 THEN 8 ELSE 10 END END AS DOUBLE)",
}
#: Blocks of a page are drawn from the last to the first, so their tops, not their numbers, are the order.
_TOP = "CAST((20 - block) * 100 + n % 5 * 12 AS DOUBLE)"
_CHUNK = "STRUCT(t VARCHAR, section VARCHAR, subsection VARCHAR, page INTEGER)"


@query(f"""WITH RECURSIVE p AS ({select('orders', _LINES)}),
          z AS (SELECT doc, round_even(s, 1) AS s, sum(c) AS c FROM (SELECT doc, size AS s, length(a) AS c FROM p UNION ALL SELECT doc, size - 0.5, length(b) FROM p) GROUP BY 1, 2),
          body AS (SELECT doc, arg_max(s, (c, -s)) AS body FROM z GROUP BY 1),
          t AS (SELECT p.doc, n, block, page, size, body, trim(concat(a, b)) AS line FROM p JOIN body USING (doc) WHERE p.doc % 11 <> 7),
          k AS (SELECT *, CASE WHEN size >= body * 1.15 AND length(line) < 120 THEN CASE WHEN size >= body * 1.4 THEN 1 ELSE 2 END WHEN length(line) < 40 AND (starts_with(upper(line), 'SECTION ') OR starts_with(upper(line), 'PART ')) THEN 1 ELSE 0 END AS level FROM t WHERE line <> '' AND size >= 7),
          l AS (SELECT doc, line, level, page, row_number() OVER (PARTITION BY doc ORDER BY page, block DESC, n) AS i FROM k),
          f(doc, i, own, section, sub, size, page, e) AS (SELECT DISTINCT doc, CAST(0 AS BIGINT), []::VARCHAR[], 'Introduction', '', CAST(0 AS BIGINT), 1, CAST(NULL AS {_CHUNK}) FROM l
            UNION ALL (WITH s AS (SELECT f.doc, l.i, f.own, f.section, f.sub, f.size, f.page, l.line, l.level, l.page AS here, list_append(f.own, l.line) AS more, f.size + length(l.line) AS n FROM f JOIN l ON l.doc = f.doc AND l.i = f.i + 1)
              SELECT doc, i, CASE WHEN level > 0 AND size >= 150 THEN []::VARCHAR[] WHEN level > 0 THEN own WHEN n >= 2500 THEN more[greatest(len(more) - 1, 1):] ELSE more END,
              CASE WHEN level = 1 THEN line ELSE section END, CASE level WHEN 1 THEN '' WHEN 2 THEN line ELSE sub END,
              CAST(CASE WHEN level > 0 AND size >= 150 THEN 0 WHEN level > 0 THEN size WHEN n >= 2500 THEN length(line) + CASE WHEN len(more) > 1 THEN length(more[len(more) - 1]) ELSE 0 END ELSE n END AS BIGINT),
              CASE WHEN level > 0 OR n >= 2500 THEN here ELSE page END,
              CASE WHEN level > 0 AND size >= 150 THEN {{'t': array_to_string(own, chr(10)), 'section': section, 'subsection': sub, 'page': page}} WHEN level = 0 AND n >= 2500 THEN {{'t': array_to_string(more, chr(10)), 'section': section, 'subsection': sub, 'page': page}} END FROM s)),
          o AS (SELECT doc, i, e FROM f WHERE e IS NOT NULL UNION ALL SELECT doc, i + 1, {{'t': array_to_string(own, chr(10)), 'section': section, 'subsection': sub, 'page': page}} FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc ORDER BY i DESC) = 1) WHERE len(own) > 0)
          SELECT CAST(doc AS VARCHAR) AS doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY i) AS INTEGER) AS n, e.section AS section, e.subsection AS subsection, e.page AS page,
          md5(concat('[Carrier: c', doc % 3, '] [Section: ', e.section, '] [Subsection: ', e.subsection, '] ', e.t)) AS hash FROM o""")
def chunk_by_font(spark, d):
    """Files of spans to lines in reading order, to chunks split at headings by font size; broken files are left out."""
    rows = made(spark, d, "orders", _LINES).withColumn("y0", F.expr(_TOP))
    piece = lambda k, body, size: F.struct((F.col("n") * 2 + k).alias("seq"), F.col(body).alias("text"), (F.col("size") - size).alias("size"), F.lit(50.0 + 200 * k).alias("x0"), F.lit(250.0 + 200 * k).alias("x1"))
    each = rows.select("doc", "page", "block", F.col("n").alias("line"), "y0", (F.col("y0") + 10).alias("y1"), F.explode(F.array(piece(0, "a", 0.0), piece(1, "b", 0.5))).alias("s")).select("*", "s.*")
    found = spans.section_chunks(saved(spans.file_spans(files(each, "doc % 11 = 7"))), F.concat(F.lit("c"), (F.col("doc").cast("bigint") % 3).cast("string")))
    return found.select("doc", "n", "section", "subsection", "page", F.md5("text").alias("hash"))


@query(f"SELECT * REPLACE (CAST(doc AS VARCHAR) AS doc) FROM ({_WHOLE_SHEETS}) WHERE doc % 7 <> 3")
def sheet_files(spark, d):
    """Entities of the first pages of files of sheets; a second page is not read, nor are files that are broken."""
    first = made(spark, d, "part", _SHEET).withColumns({"page": F.lit(1), "block": F.col("seq") % 4, "line": F.lit(0), "size": F.lit(9.0)})
    both = first.unionByName(first.withColumns({"page": F.lit(2), "seq": F.col("seq") + 10_000_000, "text": F.concat(F.lit("9"), "text")}))
    return shown(spans.sheets(saved(spans.file_spans(files(both, "doc % 7 = 3")))))


@query()
def near_copies(spark, d):
    """The documents that are nearly the same, on their first three pages, as one whose id is divisible by 100."""
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("key"), providers.even_text(providers.first_pages(F.col("text"))).alias("text"))
    found = similar.near_texts(pages.filter("key % 100 = 0").withColumnRenamed("key", "query_id"), pages)
    return found.filter("query_id <> key").select("query_id", F.col("key").alias("doc_id"), F.round("ratio", 6).alias("ratio"))
