"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?[dU]+\)", "", pattern)).groups


def matches(text: Column, pattern: str, whole_if_no_group: bool = True) -> Column:
    """What the groups of all matches caught, group by group; the matches themselves if there is no group."""
    n = _groups(pattern)
    if not n:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if whole_if_no_group else F.array().cast("array<string>")
    caught = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, n + 1)]
    return F.filter(F.concat(*caught), lambda x: x != "")


def rule_numbers(text: Column, pattern: str = fixed.RULE_NUMBER) -> Column:
    """Distinct rule numbers in order of their first place; `^` holds at each line's start."""
    return F.array_distinct(matches(text, f"(?m){pattern}"))


def cross_references(text: Column, pattern: str = fixed.CROSS_REFERENCE) -> Column:
    """Distinct cross references."""
    return F.array_distinct(matches(text, f"(?m){pattern}"))


def content_type(text: Column) -> Column:
    up = F.upper(text)
    question = text.rlike(f"(?m){fixed.QUESTION_MARK}")
    return (
        F.when(question & up.contains("CLARIFICATION:"), "clarification")
        .when(question & up.contains("VARIANT:"), "variant")
        .when(question, "qa")
        .when(text.rlike(r"\A\s*[A-K][.:]\s+"), "scenario_rule")
        .otherwise("rule")
    )


def scenarios(text: Column) -> Column:
    """Scenario letters in order; null if there are none."""
    found = F.array_sort(F.array_distinct(F.concat(matches(text, fixed.SCENARIO_LETTER), matches(text, fixed.SCENARIO_NAMED))))
    return F.when(F.size(found) > 0, found)


def section_path(number: Column, name: Column, sub: Column) -> Column:
    return F.concat_ws(" > ", F.concat(number, F.lit(". "), strip(name)), F.when(sub != "", sub))


def collapse_spaced_letters(text: Column) -> Column:
    """Lines of letters set apart by spaces, words by more, become words; other lines stay."""

    def line(x: Column) -> Column:
        parts = F.transform(F.split(x, "  +"), F.trim)
        joined = F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(" "), F.lit(""))), " ")
        return F.when(F.forall(parts, lambda p: p.rlike("^(?:[A-Z] )*[A-Z]$")), joined).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def keywords(query: Column, stop_words: list[str] = fixed.STOP_WORDS_RULES) -> Column:
    """Words of three letters or more that are no stop words; repeated ones stay."""
    words = F.split(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", ""), r"(?U)\s+")
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(stop_words))


def keywords_in(text: Column, words: Column, ignore_case: bool = False) -> Column:
    """Those of words that are part of the text in lower case."""
    low = F.lower(text)
    return F.filter(words, lambda w: F.instr(low, F.lower(w) if ignore_case else w) > 0)


def without_carrier(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[Carrier:.*?\]\s*", "")


def page_references(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(fixed.PAGE_REFERENCE), F.lit(1)), lambda x: x.try_cast("int"))


def json_object(text: Column, how: str = "greedy") -> Column:
    """The JSON object within a reply: flat (no nested braces), lazy or greedy; null if there is none."""
    pattern = {"flat": r"\{[^}]+\}", "lazy": r"(?s)\{.*?\}", "greedy": r"(?s)\{.*\}"}[how]
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def without_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<thinking>.*?</thinking>", ""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", "_"), 1, 20), "^_+|_+$", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def chunk_header(doc_type: Column, section: Column, rule: Column, scenario: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("[Doc: "), doc_type, F.lit("]")), F.concat(F.lit("[Section: "), F.coalesce(section, F.lit("None")), F.lit("]")), part("Rule", rule), part("Scenario", scenario))


def chunk_id(doc_type: Column, source_file: Column, n: Column) -> Column:
    """Type, cleaned file name, a hash of it (long names may share their first characters) and number."""
    clean = F.regexp_replace(F.substring(F.lower(source_file), 1, 40), "[^a-z0-9]", "_")
    return F.concat_ws("_", doc_type, clean, F.lpad(F.hex(F.crc32(source_file.cast("binary"))), 8, "0"), n.cast("string"))


def entity_id(file_name: Column) -> Column:
    return F.concat(F.lit("entity_"), F.regexp_replace(file_name, r"\.[a-z]+$", ""))


def policy_chunk_id(carrier: Column, n: Column) -> Column:
    return F.concat(carrier, F.lit("_chunk_"), n.cast("string"))


def datasheet(lines: Column) -> Column:
    """A data sheet's lines as one."""
    return F.array_join(lines, " ")


def checked_patterns(spark, profile: dict) -> dict:
    """rule_pattern and cross_ref_pattern of a profile, tried on the driver by both engines that use them, Java's in
    expressions and Python's in the chunkers: a cross-reference pattern that either can't compile gives way to the rule
    pattern; a rule pattern that either can't compile is an error."""

    def compiles(pattern: str) -> bool:
        try:
            re.compile(pattern)
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, Py4JError, PySparkException):
            return False
        return True

    rule, other = profile["rule_pattern"], profile.get("cross_ref_pattern") or profile["rule_pattern"]
    if not compiles(rule):
        raise ValueError(f"not a pattern: {rule}")
    return {"rule_pattern": rule, "cross_ref_pattern": other if compiles(other) else rule}


def acronyms(text: Column) -> Column:
    """Sorted distinct `ACRONYM: meaning`, from four forms of definition."""

    def oriented(pattern: str) -> Column:
        a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))

        def one(x: Column, y: Column) -> Column:
            x, y = strip(x), strip(y)
            is_acronym = lambda c, other: (F.char_length(c) <= 6) & (F.upper(c) == c) & c.rlike("[A-Z]") & (F.char_length(other) > F.char_length(c))
            return F.when(is_acronym(x, y), F.concat_ws(": ", x, y)).when(is_acronym(y, x), F.concat_ws(": ", y, x))

        return F.zip_with(a, b, one)

    return F.array_sort(F.array_distinct(F.filter(F.concat(*map(oriented, fixed.ACRONYMS)), lambda x: x.isNotNull())))


def verdict(text: Column, aspect: str) -> Column:
    return F.when(F.lower(text).contains(f"{aspect.lower()}: yes"), "Yes").otherwise("No")


def first_match(text: Column, rules: list[tuple[str, str, int]]) -> Column:
    """(type, priority) of the first rule whose pattern is found in the text; null if none is."""
    cases = [(text.rlike(p), F.struct(F.lit(t).alias("doc_type"), F.lit(n).alias("priority"))) for p, t, n in rules]
    return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))


def edition(text: Column, letters: str = "edition|ed|e\\b") -> Column:
    found = F.regexp_extract(text, rf"(\d+)(?:st|nd|rd|th|e)?\s*(?:{letters})", 1)
    return F.when(found != "", found.try_cast("int"))
