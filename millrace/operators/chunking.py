"""Chunkers: folds over a document's lines, described by tables, and the columns built from their chunks.

A fold's boundaries depend on the length gathered since the last flush, so no window function is exact for it. Size-only
chunkers run in the JVM (`aggregate`); the others run document by document over Arrow batches, without any shuffle. All
keep the running length instead of joining lines again. Rules, references, types and headers are then plain columns.

Page markers are never part of a chunk; a chunk carries the page at which it was flushed, layout chunks that at which
they began. Null texts give no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

_PAGE = re.compile(fixed.PAGE_MARKER)
_SEPARATOR = re.compile(fixed.ERRATA_SEPARATOR)
_QUESTION = re.compile(r"^\s*(Q\.|A\.)")
#: Documents whose texts and chunks a task holds as Python objects at once.
FOLDED_ROWS = 128


@dataclass
class Context:
    """What the lines so far say about the next chunk."""

    section: str | None
    subsection: str | None = None
    rule: str | None = None
    scenario: str | None = None
    page: int = 1


@dataclass
class Boundary:
    """A line that may end a chunk: `find` gives what it says; a chunk of `least` characters or more, and of a known
    `needs`, is flushed (in the section that `flush_section` names); `enter` then changes the context."""

    find: Callable[[str, str], tuple | None]
    enter: Callable[[Context, tuple], None]
    least: int = 0
    needs: str | None = None
    flush_section: Callable[[Context], str] | None = None


@dataclass
class Chunker:
    """A fold's table. cap: a longer chunk is split; natural: at a separator or question if there is one, and forced
    only if `force`; two lines overlap. tail: the least length of the last chunk. join: how a boundary's chunk is
    joined, the others always by line ends."""

    section: str
    cap: int
    tail: int = 0
    boundaries: list[Boundary] = field(default_factory=list)
    natural: bool = False
    force: bool = True
    join: str = "\n"
    prepare: Callable[[str], str] | None = None
    last_section: Callable[[Context], str | None] | None = None


def split_point(lines: list[str]) -> int:
    """The first separator from the middle on, or question after it; else a separator at most nine lines before; or -1."""
    mid = len(lines) // 2
    for i in range(mid, len(lines)):
        if _SEPARATOR.search(lines[i]) or i > mid and _QUESTION.match(lines[i]):
            return i
    return next((i for i in range(mid - 1, max(0, mid - 10), -1) if _SEPARATOR.search(lines[i])), -1)


def fold(chunker: Chunker, whole: str) -> list[tuple]:
    """(text, section, subsection, rule, scenario, page) of each chunk."""
    if chunker.prepare:
        whole = chunker.prepare(whole)
    now, out, lines, size = Context(chunker.section), [], [], 0

    def emit(own: list[str], join: str = "\n", section: str | None = None) -> None:
        out.append((join.join(own), section if section is not None else now.section, now.subsection, now.rule, now.scenario, now.page))

    length = lambda: size + max(0, len(lines) - 1)
    for line in whole.split("\n"):
        if m := _PAGE.match(line):
            now.page = int(m[1])
            continue
        bare = line.strip()
        for b in chunker.boundaries:
            if (said := b.find(line, bare)) is None:
                continue
            if lines and length() >= b.least and (b.needs is None or getattr(now, b.needs)):
                emit(lines, chunker.join, b.flush_section(now) if b.flush_section else None)
                lines, size = [], 0
            b.enter(now, said)
        if bare:
            lines.append(bare)
            size += len(bare)
        if length() > chunker.cap:
            at = split_point(lines) if chunker.natural else -1
            if at > 0:
                emit(lines[:at])
                lines = lines[max(0, at - 2) :]
            elif chunker.force:
                emit(lines)
                lines = lines[-2:]
            size = sum(map(len, lines))
    if lines and length() >= chunker.tail:
        emit(lines, section=chunker.last_section(now) if chunker.last_section else None)
    return out


def _said(pattern: str, of_bare: bool = False, how: str = "match") -> Callable:
    compiled = re.compile(pattern, re.M)
    return lambda line, bare: m.groups() if (m := getattr(compiled, how)(bare if of_bare else line)) else None


def _enter_section(now: Context, said: tuple) -> None:
    now.section, now.subsection, now.rule = f"{said[0]}. {said[1].strip()}", "", f"{said[0]}.0"


def _enter_rule(now: Context, said: tuple) -> None:
    now.rule = now.subsection = said[0]


_RULE_LINE = r"^\s*(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\s"


def _numbered(cap: int, natural: bool) -> Chunker:
    bounds = [Boundary(_said(fixed.SECTION_HEADER), _enter_section, 100), Boundary(_said(_RULE_LINE), _enter_rule, 80)]
    return Chunker("Introduction", cap, 50, bounds, natural)


def integrated_rules() -> Chunker:
    return _numbered(3000, True)


def core_rules() -> Chunker:
    return _numbered(2500, False)


def errata() -> Chunker:
    def enter(now: Context, said: tuple) -> None:
        _enter_rule(now, said)
        now.section = f"Errata for Rule {said[0]}"

    return Chunker("Errata for Rule None", 2500, 0, [Boundary(_said(r"^\s*\*?(\d{1,2}\.\d{1,3}(?:\.\d{1,2})?)\s"), enter, needs="rule")], last_section=lambda now: now.section if now.rule else "Errata")


def scenarios() -> Chunker:
    def enter(now: Context, said: tuple) -> None:
        now.scenario = now.subsection = said[0]
        now.section = f"Scenario {said[0]}: {said[1].strip()}"

    return Chunker("Scenarios", 2500, 0, [Boundary(_said(r"^\s*([A-K])[.:]\s*(.*)"), enter, needs="scenario", flush_section=lambda now: f"Scenario {now.scenario}")])


def rules_by_pattern(doc_type: str, pattern: str) -> Chunker:
    own, plain = re.compile(pattern, re.M), re.compile(r"^([A-Z]?\d{1,2}\.\d{1,4}(?:\.\d{1,2})?)\s")

    def enter(now: Context, said: tuple) -> None:
        now.rule = now.subsection = now.section = said[0]

    find = lambda line, bare: m.groups() if (m := own.match(bare) or plain.match(bare)) else None
    return Chunker(_title(doc_type), 2500, 50, [Boundary(find, enter, 80)], natural=True)


#: Headers of scenarios by format.
SCENARIO_HEADERS = {
    "letter": r"^([A-K])[.:\s]+([A-Z])",
    "numeric": r"^(?:ASL\s+SCENARIO\s+|Scenario\s+)?(\w+\d+)\b|^(\d+)[.:\s]+[A-Z]",
    "named": r"(?:^|\n)(TURN RECORD CHART|END\s+\d+|[A-Z][A-Z\s]{4,}(?:\n|$))",
}


def scenarios_by_format(kind: str) -> Chunker:
    header = re.compile(SCENARIO_HEADERS.get(kind, SCENARIO_HEADERS["named"]), re.M)

    def find(line: str, bare: str) -> tuple | None:
        m = header.match(bare)
        return (m[1] or bare[:40],) if m and len(bare) < 80 else None

    def enter(now: Context, said: tuple) -> None:
        now.scenario = now.subsection = said[0]
        now.section = f"Scenario: {said[0]}"

    return Chunker("Scenarios", 2000, 50, [Boundary(find, enter, needs="scenario", flush_section=lambda now: f"Scenario {now.scenario}")])


def by_size(doc_type: str) -> Chunker:
    return Chunker(_title(doc_type), 2000, 50)


def collapsed(whole: str) -> str:
    """As functions.text.collapse_spaced_letters, for one text."""
    out = []
    for line in whole.split("\n"):
        parts = [p.strip(" ") for p in re.split("  +", line)]
        spaced = all(re.fullmatch("(?:[A-Z] )*[A-Z]", p) for p in parts)
        out.append(" ".join(p.replace(" ", "") for p in parts) if spaced else line)
    return "\n".join(out)


def keyword_headers(doc_type: str, size: int = 2500) -> Chunker:
    header = re.compile(r"^([A-Z][A-Za-z0-9\s&\-]{3,60})$")

    def find(line: str, bare: str) -> tuple | None:
        return (bare,) if header.match(bare) and not any(x in bare.lower() for x in ("page", "continue", "example")) else None

    def enter(now: Context, said: tuple) -> None:
        now.rule = now.subsection = now.section = said[0]

    return Chunker(_title(doc_type), size, 50, [Boundary(find, enter, 50)], natural=True, force=False, join=" ", prepare=lambda whole: collapsed(collapsed(whole)))  # twice: joined words may be spaced letters again


def _title(doc_type: str) -> str:
    return doc_type.replace("_", " ").title()


def chunker_for(doc_type: str, profile: dict | None = None) -> Chunker:
    """By the profile's rule schema, or, without one, by the fixed table of types."""
    if profile is None:
        fixed_table = {"integrated_rules": integrated_rules, "core_rules": core_rules, "errata": errata, "scenario_errata": errata, "scenarios": scenarios}
        return fixed_table[doc_type]() if doc_type in fixed_table else by_size(doc_type)
    spaced = profile.get("rule_schema") == "keyword_header"  # scanned books: spaced letters are joined in texts of all types
    if doc_type in fixed.RULE_TYPES and spaced:
        return keyword_headers(doc_type, profile.get("chunk_size") or 2500)
    if doc_type in fixed.RULE_TYPES:
        return rules_by_pattern(doc_type, profile.get("rule_pattern") or fixed.RULE_NUMBER)
    found = scenarios_by_format(profile.get("scenario_format") or "named") if doc_type in fixed.SCENARIO_TYPES else by_size(doc_type)
    found.prepare = collapsed if spaced else None
    return found


def folded(docs: DataFrame, profile: dict | None = None) -> DataFrame:
    """The chunks of docs (source_file, text, doc_type, priority), each with its number from 0 within its document."""
    schema = "source_file string, doc_type string, priority int, seq int, text string, section string, subsection string, rule string, scenario string, page int"
    arrow = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        made: dict[str, Chunker] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, FOLDED_ROWS):
                rows = []
                for source, whole, kind, priority in zip(*(c.to_pylist() for c in batch.slice(lo, FOLDED_ROWS).columns)):
                    if whole is not None:
                        if kind not in made:
                            made[kind] = chunker_for(kind, profile)
                        rows += [(source, kind, priority, k, *c) for k, c in enumerate(fold(made[kind], whole))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return docs.select("source_file", "text", "doc_type", F.col("priority").cast("int")).mapInArrow(run, schema)


_CHUNKS = "array<struct<text:string,page:int>>"


def sized_chunks(whole: Column, cap: int = 2000, tail: int = 50) -> Column:
    """Text and page of the chunks of a size-only chunker, as a fold in the JVM."""
    state = f"struct<lines:array<string>,size:int,page:int,out:{_CHUNKS}>"
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("size"), F.lit(1).alias("page"), F.array().cast(_CHUNKS).alias("out")).cast(state)
    chunk = lambda s: F.array(F.struct(F.array_join(s["lines"], "\n").alias("text"), s["page"].alias("page")))
    total = lambda s: s["size"] + F.greatest(F.size(s["lines"]) - 1, F.lit(0))

    def add(s: Column, line: Column) -> Column:
        bare = text.strip(line)
        some = bare != ""
        return F.struct(F.when(some, F.concat(s["lines"], F.array(bare))).otherwise(s["lines"]).alias("lines"), F.when(some, s["size"] + F.char_length(bare)).otherwise(s["size"]).alias("size"), s["page"].alias("page"), s["out"].alias("out")).cast(state)

    def cut(s: Column) -> Column:
        rest = F.slice(s["lines"], F.greatest(F.size(s["lines"]) - 1, F.lit(1)), 2)
        done = F.struct(rest.alias("lines"), F.aggregate(rest, F.lit(0), lambda a, x: a + F.char_length(x)).alias("size"), s["page"].alias("page"), F.concat(s["out"], chunk(s)).alias("out")).cast(state)
        return F.when(total(s) > cap, done).otherwise(s)

    def step(s: Column, line: Column) -> Column:
        page = F.regexp_extract(line, fixed.PAGE_MARKER, 1)
        marked = F.struct(s["lines"].alias("lines"), s["size"].alias("size"), page.try_cast("int").alias("page"), s["out"].alias("out")).cast(state)
        one = F.transform(F.array(add(s, line)), cut)  # binds the grown state, which is used many times
        return F.when(page != "", marked).otherwise(F.element_at(one, 1))

    finish = lambda s: F.when((F.size(s["lines"]) > 0) & (total(s) >= tail), F.concat(s["out"], chunk(s))).otherwise(s["out"])
    return F.aggregate(F.split(whole, "\n"), zero, step, finish)


def built(chunks: DataFrame, rule_pattern: str = fixed.RULE_NUMBER, reference_pattern: str = fixed.CROSS_REFERENCE) -> DataFrame:
    """Folded chunks with id, header, rule, references, type and scenario."""
    body = F.col("text")
    numbers = text.rule_numbers(body, rule_pattern)
    found = chunks.withColumns({"all_rule_numbers": numbers, "n": F.col("seq")})
    rule = F.when(F.coalesce("rule", F.lit("")) != "", F.col("rule")).otherwise(F.get("all_rule_numbers", F.lit(0)))
    found = found.withColumn("rule_number", rule)
    references = text.cross_references(body, reference_pattern)
    found = found.withColumn("cross_refs", F.when(F.col("rule_number").isNull(), references).otherwise(F.array_remove(references, F.col("rule_number"))))
    scenario = F.when(F.coalesce("scenario", F.lit("")) != "", F.col("scenario")).otherwise(F.get(text.scenarios(body), F.lit(0)))
    found = found.withColumns({"scenario": scenario, "content_type": text.content_type(body), "section_path": F.coalesce("section", F.lit("")), "subsection": F.when(F.col("subsection") != "", F.col("subsection"))})
    enriched = F.concat_ws("\n", text.chunk_header(F.col("doc_type"), F.col("section"), F.col("rule_number"), F.col("scenario")), body)
    return found.select(text.chunk_id(F.col("doc_type"), F.col("source_file"), F.col("seq")).alias("chunk_id"), enriched.alias("text"), "doc_type", "source_file", "section_path", "subsection", "content_type", "page", "priority", "rule_number", "scenario", "cross_refs", "all_rule_numbers", "seq")


def body_size(spans: DataFrame, first_pages: int = 15) -> DataFrame:
    """Of each doc, the rounded font size with most characters on its first pages; 10 if there is none."""
    sized = spans.filter(F.col("page") <= first_pages).groupBy("doc", F.bround("size", 1).alias("s")).agg(F.sum(F.char_length("text")).alias("n"))
    best = sized.groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))
    return spans.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def layout_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of layout lines (doc, carrier, seq, page, text, size, body_size), split at headings by font size. A doc's
    lines are one group; it is bounded by the largest doc. A line without a size counts as body text, a doc without a
    carrier as one of `Unknown`, a body without a size as one of 10."""
    schema = "doc string, carrier string, n int, text string, section string, subsection string, page int"

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        out, section, sub, own, size, page = [], "Introduction", "", [], 0, 1

        def emit():
            head = f"[Carrier: {rows[0]['carrier'] or 'Unknown'}] [Section: {section}] [Subsection: {sub}] "
            out.append((rows[0]["doc"], rows[0]["carrier"], len(out) + 1, head + "\n".join(own), section, sub, page))

        for r in rows:
            line = (r["text"] or "").strip()
            body = 10.0 if r["body_size"] is None else r["body_size"]
            font = body if r["size"] is None else r["size"]
            if not line or font < 7.0:
                continue
            level = (1 if font >= body * 1.4 else 2) if font >= body * 1.15 and len(line) < 120 else 0
            if not level and len(line) < 40 and line.upper().startswith(("SECTION ", "PART ")):
                level = 1
            if level:
                if size >= 150:
                    emit()
                    own, size = [], 0
                if level == 1:
                    section, sub = line, ""
                else:
                    sub = line
                page = r["page"]
                continue
            own.append(line)
            size += len(line)
            if size >= 2500:
                emit()
                own = own[-2:]
                size, page = sum(map(len, own)), r["page"]
        if own:
            emit()
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return lines.groupBy("doc").applyInArrow(run, schema)
