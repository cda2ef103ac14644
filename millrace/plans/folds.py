"""Chunkers as queries, each beside the same fold as a recursive query that takes one line of every document at a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chunking
from .details import made, select
from .queries import BOOKS_SQL, books, chunks_of_books, query, read

_STRUCT = "STRUCT(t VARCHAR, section VARCHAR, subsection VARCHAR, rule VARCHAR, scenario VARCHAR, page INTEGER)"
_SIZE = "(coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0) + greatest(len({a}) - 1, 0))"
_SEPARATOR = "regexp_matches({a}[i + 1], '[•·]\\.{{4,}}')"


def chunk(lines: str, join: str, section: str, state: int, page: str = "page") -> str:
    return f"{{'t': array_to_string({lines}, {join}), 'section': {section}, 'subsection': sub{state}, 'rule': rule{state}, 'scenario': scen{state}, 'page': {page}}}"


def folded(docs: str, start: str, cap: int, tail: int, bounds: list[dict] = (), natural: bool = False, force: bool = True, join: str = "chr(10)", last: str = "section0", line: str = "x") -> str:
    """The chunks of docs (source_file, text, doc_type, priority) with seq. A bound has `find` (over line and bare), `least`,
    `needs`, `section` (of what it flushes) and `enter` (what it sets)."""
    stages, acc, n = [], "acc0", 0
    for b in bounds:
        e = b["enter"]
        stages.append(
            f"hit{n} AS (SELECT *, mark = '' AND ({b['find']}) AS h{n}, h{n} AND len({acc}) > 0 AND {_SIZE.format(a=acc)} >= {b.get('least', 0)} AND {b.get('needs', 'true').format(n=n)} AS f{n}, "
            f"CASE WHEN f{n} THEN [{chunk(acc, join, b.get('section', 'section{n}').format(n=n), n)}] ELSE []::{_STRUCT}[] END AS e{n}, CASE WHEN f{n} THEN []::VARCHAR[] ELSE {acc} END AS acc{n + 1}, "
            + ", ".join(f"CASE WHEN h{n} THEN {e[k]} ELSE {k}{n} END AS {k}{n + 1}" if k in e else f"{k}{n} AS {k}{n + 1}" for k in ("section", "sub", "rule", "scen"))
            + f" FROM {'s' if n == 0 else f'hit{n - 1}'})"
        )
        n += 1
        acc = f"acc{n}"
    mid = f"(len(acca) // 2)"
    point = f"coalesce(list_min(list_filter(range({mid}, len(acca)), lambda i: {_SEPARATOR.format(a='acca')} OR (i > {mid} AND regexp_matches(acca[i + 1], '^\\s*(Q\\.|A\\.)')))), list_max(list_filter(range(greatest({mid} - 10, 0) + 1, {mid}), lambda i: {_SEPARATOR.format(a='acca')})), -1)" if natural else "-1"
    before = f"hit{n - 1}" if n else "s"
    forced = f"WHEN big THEN [{chunk('acca', 'chr(10)', f'section{n}', n)}]" if force else ""
    kept = "WHEN big THEN acca[greatest(len(acca) - 1, 1):]" if force else ""
    emitted = " || ".join([*(f"e{k}" for k in range(n)), "ecap"])
    step = f"""WITH s AS (SELECT f.source_file, f.i + 1 AS i, acc AS acc0, section AS section0, sub AS sub0, rule AS rule0, scen AS scen0, f.page, line, trim(line, ' ' || chr(9)) AS bare, regexp_extract(line, '^--- PAGE (\\d+)', 1) AS mark FROM f JOIN l ON l.source_file = f.source_file AND l.i = f.i + 1),
        {''.join(x + ', ' for x in stages)}
        a AS (SELECT *, CASE WHEN mark = '' AND bare <> '' THEN list_append({acc}, bare) ELSE {acc} END AS acca FROM {before}),
        c AS (SELECT *, mark = '' AND {_SIZE.format(a='acca')} > {cap} AS big, CASE WHEN mark = '' AND {_SIZE.format(a='acca')} > {cap} THEN {point} ELSE -1 END AS spot, CASE WHEN big AND spot > 0 THEN [{chunk('acca[1:spot]', 'chr(10)', f'section{n}', n)}] {forced} ELSE []::{_STRUCT}[] END AS ecap FROM a)
        SELECT source_file, i, CASE WHEN big AND spot > 0 THEN acca[greatest(spot - 2, 0) + 1:] {kept} ELSE acca END, section{n}, sub{n}, rule{n}, scen{n}, CASE WHEN mark <> '' THEN CAST(mark AS INTEGER) ELSE page END, {emitted} FROM c"""
    end = f"SELECT source_file, i + 1 AS i, [{chunk('acc0', 'chr(10)', last, 0)}] AS e FROM (SELECT source_file, i, acc AS acc0, section AS section0, sub AS sub0, rule AS rule0, scen AS scen0, page FROM f QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY i DESC) = 1) WHERE len(acc0) > 0 AND {_SIZE.format(a='acc0')} >= {tail}"
    return f"""(WITH RECURSIVE l AS (SELECT source_file, i, {line.replace('x', 't[i]') if line == 'x' else line.replace('$', 't[i]')} AS line FROM (SELECT source_file, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT source_file, string_split(text, chr(10)) AS t FROM {docs}))),
        f(source_file, i, acc, section, sub, rule, scen, page, e) AS (SELECT source_file, CAST(0 AS BIGINT), []::VARCHAR[], {start}, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 1, []::{_STRUCT}[] FROM {docs} UNION ALL ({step})),
        out AS (SELECT source_file, i, e FROM f WHERE len(e) > 0 UNION ALL {end}),
        each AS (SELECT source_file, i, k, e[k] AS c FROM (SELECT *, unnest(range(1, len(e) + 1)) AS k FROM out))
        SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY i, k) - 1 AS INTEGER) AS seq, c.t AS text, c.section AS section, c.subsection AS subsection, c.rule AS rule, c.scenario AS scenario, c.page AS page FROM each)"""


_G = lambda p, g, x="line": f"regexp_extract({x}, '{p}', {g})"
_SECTION = r"(?:^|\n)\s*(\d{1,2})\.\s+([A-Z][A-Z\s&\-]+)"
_HEADER = {"find": f"regexp_matches(line, '^{_SECTION}')", "least": 100, "enter": {"section": f"concat({_G('^' + _SECTION, 1)}, '. ', trim({_G('^' + _SECTION, 2)}, ' ' || chr(10)))", "sub": "''", "rule": f"concat({_G('^' + _SECTION, 1)}, '.0')"}}
_RULE = r"^\s*(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\s"
_NUMBER = {"find": f"regexp_matches(line, '{_RULE}')", "least": 80, "enter": {"sub": _G(_RULE, 1), "rule": _G(_RULE, 1)}}
_ERRATUM = r"^\s*\*?(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\s"
_LETTER = r"^\s*([A-K])[.:]\s*(.*)"


def typed(kind: str) -> str:
    return f"(SELECT * FROM books WHERE doc_type = '{kind}')"


_FOLDS = {
    "integrated_rules": folded(typed("integrated_rules"), "'Introduction'", 3000, 50, [_HEADER, _NUMBER], natural=True),
    "core_rules": folded(typed("core_rules"), "'Introduction'", 2500, 50, [_HEADER, _NUMBER]),
    "errata": folded(typed("errata"), "'Errata for Rule None'", 2500, 0, [{"find": f"regexp_matches(line, '{_ERRATUM}')", "needs": "rule{n} IS NOT NULL", "enter": {"section": f"concat('Errata for Rule ', {_G(_ERRATUM, 1)})", "sub": _G(_ERRATUM, 1), "rule": _G(_ERRATUM, 1)}}], last="CASE WHEN rule0 IS NULL THEN 'Errata' ELSE section0 END"),
    "scenarios": folded(typed("scenarios"), "'Scenarios'", 2500, 0, [{"find": f"regexp_matches(line, '{_LETTER}')", "needs": "scen{n} IS NOT NULL", "section": "concat('Scenario ', scen{n})", "enter": {"section": f"concat('Scenario ', {_G(_LETTER, 1)}, ': ', trim({_G(_LETTER, 2)}))", "sub": _G(_LETTER, 1), "scen": _G(_LETTER, 1)}}]),
    "primer": folded(typed("primer"), "'Primer'", 2000, 50),
}
_IN_ORDER = "list_filter({l}, lambda x, i: x <> '' AND list_position({l}, x) = i)"


def _all(pattern: str, groups: int) -> str:
    """The groups' catches in `text`, group by group."""
    return "list_concat(" + ", ".join(f"regexp_extract_all(text, '(?m){pattern}', {g})" for g in range(1, groups + 1)) + ")" if groups > 1 else f"regexp_extract_all(text, '(?m){pattern}', 1)"


@query(rf"""WITH {BOOKS_SQL}, f AS ({' UNION ALL '.join(f'SELECT * FROM {x}' for x in _FOLDS.values())}),
          x AS (SELECT f.*, doc_type, priority, {_all(fixed.RULE_NUMBER, 1)} AS n, {_all(fixed.CROSS_REFERENCE, 4)} AS c, list_concat(regexp_extract_all(text, '{fixed.SCENARIO_LETTER}', 1), regexp_extract_all(text, '{fixed.SCENARIO_NAMED}', 1)) AS s, regexp_matches(text, '(?m){fixed.QUESTION_MARK}') AS q FROM f JOIN (SELECT source_file, doc_type, priority FROM books) b USING (source_file)),
          y AS (SELECT *, {_IN_ORDER.format(l='n')} AS own, coalesce(nullif(rule, ''), list_extract({_IN_ORDER.format(l='n')}, 1)) AS r, coalesce(nullif(scenario, ''), list_min(s)) AS sc FROM x)
          SELECT concat(doc_type, '_', replace(source_file, ' ', '_'), '_', seq) AS chunk_id, concat('[Doc: ', doc_type, '] [Section: ', coalesce(section, 'None'), ']', CASE WHEN r <> '' THEN concat(' [Rule: ', r, ']') ELSE '' END, CASE WHEN sc <> '' THEN concat(' [Scenario: ', sc, ']') ELSE '' END, chr(10), text) AS text, doc_type, source_file, coalesce(section, '') AS section_path, nullif(subsection, '') AS subsection,
          CASE WHEN q AND contains(upper(text), 'CLARIFICATION:') THEN 'clarification' WHEN q AND contains(upper(text), 'VARIANT:') THEN 'variant' WHEN q THEN 'qa' WHEN regexp_matches(text, '^\s*[A-K][.:]\s+') THEN 'scenario_rule' ELSE 'rule' END AS content_type,
          page, priority, r AS rule_number, sc AS scenario, array_to_string(list_filter({_IN_ORDER.format(l='c')}, lambda z: z IS DISTINCT FROM r), ',') AS cross_refs, array_to_string(own, ',') AS all_rule_numbers, seq FROM y""")
def chunk_books(spark, d):
    """Books of five types by their chunkers, with all columns of a chunk."""
    found = chunks_of_books(spark, d).withColumns({"cross_refs": F.array_join("cross_refs", ","), "all_rule_numbers": F.array_join("all_rule_numbers", ",")})
    return found.withColumn("chunk_id", F.regexp_replace("chunk_id", "_[0-9A-F]{8}_", "_"))


_DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS source_file, text FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT CAST(source_file AS BIGINT) AS doc_id, seq AS n, length(text) AS n_chars, md5(text) AS hash, page FROM {folded(_DOCS, repr('x'), 2000, 50)}")
def chunk_generic_2000(spark, d):
    """All documents by size alone."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text", F.lit("unknown").alias("doc_type"), F.lit(9).alias("priority"))
    return chunking.folded(docs).select(F.col("source_file").cast("bigint").alias("doc_id"), F.col("seq").alias("n"), F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("hash"), "page")


@query(f"WITH {BOOKS_SQL} SELECT source_file, seq, md5(text) AS hash, page FROM {folded('books', repr('x'), 2000, 50)}")
def chunk_in_the_jvm(spark, d):
    """The size-only fold as one expression, over books with page markers."""
    return books(spark, d).select("source_file", F.posexplode(chunking.sized_chunks(F.col("text"))).alias("seq", "c")).select("source_file", "seq", F.md5("c.text").alias("hash"), F.col("c.page").alias("page"))


_PLAIN = r"^([A-Z]?\d{1,2}\.\d{1,4}(?:\.\d{1,2})?)\s"
_CODEX = {"find": f"regexp_matches(bare, '^{fixed.RULE_NUMBER}') OR regexp_matches(bare, '{_PLAIN}')", "least": 80, "enter": {k: f"coalesce(nullif({_G('^' + fixed.RULE_NUMBER, 1, 'bare')}, ''), {_G(_PLAIN, 1, 'bare')})" for k in ("section", "sub", "rule")}}
_COLUMNS = "source_file, seq, md5(text) AS hash, section, subsection, rule, scenario, page"


def hashed(found: DataFrame) -> DataFrame:
    return found.select("source_file", "seq", F.md5("text").alias("hash"), "section", "subsection", "rule", "scenario", "page")


@query(f"WITH {BOOKS_SQL} SELECT {_COLUMNS} FROM {folded('books', repr('Codex'), 2500, 50, [_CODEX], natural=True)}")
def chunk_by_pattern(spark, d):
    """All books as rules of a profile's pattern."""
    return hashed(chunking.folded(books(spark, d).withColumn("doc_type", F.lit("codex")), {"rule_schema": "numeric_decimal", "rule_pattern": fixed.RULE_NUMBER}))


_FIELDS = {"source_file": "concat('f', CAST(floor(p_partkey / 20) AS BIGINT))", "k": "p_partkey", "t": "CASE p_partkey % 20 WHEN 0 THEN concat('A. Over the hill', chr(10), p_name) WHEN 3 THEN '--- PAGE 4 ---' WHEN 5 THEN concat('Scenario AP', CAST(p_partkey AS STRING), ' begins') WHEN 8 THEN concat('TURN RECORD CHART', chr(10), 'B. Under the bridge ', p_type) WHEN 11 THEN concat('3. Third ', p_brand) WHEN 13 THEN concat('C. ', repeat('a long line is no header ', 5)) WHEN 15 THEN repeat(concat('some words of the field by ', p_name, chr(10)), 90) ELSE concat('  ', p_name, ' goes ', p_type) END"}
_FIELD_DOCS = f"(SELECT source_file, string_agg(t, chr(10) ORDER BY k) AS text FROM ({select('part', _FIELDS)}) GROUP BY 1)"


def field(header: str, first: str) -> dict:
    return {"find": f"length(bare) < 80 AND regexp_matches(bare, '{header}')", "needs": "scen{n} IS NOT NULL", "section": "concat('Scenario ', scen{n})", "enter": {"section": f"concat('Scenario: ', {first})", "sub": first, "scen": first}}


_FORMATS = {
    "letter": field(r"^([A-K])[.:\s]+([A-Z])", _G(r"^([A-K])[.:\s]+([A-Z])", 1, "bare")),
    "numeric": field(r"^(?:(?:ASL\s+SCENARIO\s+|Scenario\s+)?(\w+\d+)\b|(\d+)[.:\s]+[A-Z])", r"coalesce(nullif(regexp_extract(bare, '^(?:ASL\s+SCENARIO\s+|Scenario\s+)?(\w+\d+)\b', 1), ''), substring(bare, 1, 40))"),
    "named": field(r"^(TURN RECORD CHART|END\s+\d+|[A-Z][A-Z\s]{4,}(?:\n|$))", _G(r"^(TURN RECORD CHART|END\s+\d+|[A-Z][A-Z\s]{4,}(?:\n|$))", 1, "bare")),
    "sizes": None,
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS format, {_COLUMNS} FROM {folded(_FIELD_DOCS, repr('Scenarios' if b else 'Qa'), 2000, 50, [b] if b else [])}" for k, b in _FORMATS.items()))
def chunk_by_format(spark, d):
    """Scenarios of each format, and a type that a profile cuts by size."""
    rows = made(spark, d, "part", _FIELDS).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("text"))
    found = None
    for kind in _FORMATS:
        docs = rows.select("source_file", "text", F.lit("qa" if kind == "sizes" else "tournament").alias("doc_type"), F.lit(1).alias("priority"))
        own = hashed(chunking.folded(docs, {"rule_schema": "numeric_decimal", "scenario_format": kind})).select(F.lit(kind).alias("format"), "*")
        found = own if found is None else found.unionByName(own)
    return found


_SPACED = {"source_file": "concat('f', CAST(floor(p_partkey / 40) AS BIGINT))", "k": "p_partkey", "t": "CASE p_partkey % 8 WHEN 0 THEN 'M O V E S  A N D  F I R E' WHEN 1 THEN 'Page of Examples' WHEN 2 THEN concat(upper(substring(p_name, 1, 1)), substring(p_name, 2, 60)) WHEN 3 THEN 'A  B  C' WHEN 5 THEN concat('the ', lower(p_type), ' is used here, see the rest.') WHEN 6 THEN CASE WHEN p_partkey % 40 = 6 THEN concat(repeat(concat('no header, as it ends in a stop, and goes on for a while.', chr(10)), 30), chr(8226), '....', chr(10), repeat(concat('Q. why is that so, and what for, and since when?', chr(10)), 30)) ELSE ' lower case, no header' END ELSE concat(p_name, ' and ', p_brand, ' are two, not one; ', p_name, ' is the first.') END"}


def _collapsed(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array({x}, '  +'), lambda p: trim(p, ' '))"
    return f"CASE WHEN len(list_filter({parts}, lambda p: NOT regexp_full_match(p, '(?:[A-Z] )*[A-Z]'))) = 0 THEN array_to_string(list_transform({parts}, lambda p: replace(p, ' ', '')), ' ') ELSE {x} END"


_SPACED_DOCS = f"(SELECT source_file, string_agg(t, chr(10) ORDER BY k) AS text FROM ({select('part', _SPACED)}) GROUP BY 1)"
_CAPTION = {"find": r"regexp_matches(bare, '^([A-Z][A-Za-z0-9\s&\-]{3,60})$') AND NOT regexp_matches(lower(bare), 'page|continue|example')", "least": 50, "enter": {k: "bare" for k in ("section", "sub", "rule")}}
_ONCE = _collapsed("$")
_TWICE = f"list_transform([{_ONCE}], lambda y: {_collapsed('y')})[1]"


@query(f"""SELECT 'rules' AS kind, {_COLUMNS} FROM {folded(_SPACED_DOCS, repr('Core Rules'), 2500, 50, [_CAPTION], natural=True, force=False, join="' '", line=_TWICE)}
          UNION ALL SELECT 'sizes', {_COLUMNS} FROM {folded(_SPACED_DOCS, repr('Journal'), 2000, 50, line=_ONCE)}""")
def chunk_keyword_header(spark, d):
    """Books without rule numbers, whose headings are captions with spaced letters; and another type of the same profile."""
    rows = made(spark, d, "part", {**_SPACED, "t": _SPACED["t"].replace("chr(8226)", "'•'")}).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("text"))
    found = None
    for kind, doc_type in (("rules", "core_rules"), ("sizes", "journal")):
        docs = rows.select("source_file", "text", F.lit(doc_type).alias("doc_type"), F.lit(1).alias("priority"))
        own = hashed(chunking.folded(docs, {"rule_schema": "keyword_header"})).select(F.lit(kind).alias("kind"), "*")
        found = own if found is None else found.unionByName(own)
    return found
