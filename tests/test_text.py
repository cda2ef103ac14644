"""Text functions on literal cases, held against plain Python where there is a plain form."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed, providers, text


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("5.41 Movement", ["5.41"]),
        ("5.41 a\n6.1 b\n5.41 c\n17.4.2 d", ["5.41", "6.1", "17.4.2"]),
        ("--- PAGE 3 ---\nin 1983 the", []),
        ("text 5.41 within", []),
        (None, None),
        ("", []),
    ],
)
def test_rule_numbers(spark, value, want):
    assert one(spark, text.rule_numbers, value) == want


@pytest.mark.parametrize(("value", "want"), [("[5.61] and see 6.1, rule 3.3; EXC: [6.5]", {"5.61", "6.1", "3.3", "6.5"}), ("see [7.2] SEE 8.1", {"7.2", "8.1"}), ("none", set())])
def test_cross_references(spark, value, want):
    assert set(one(spark, text.cross_references, value)) == want


def test_schemas_do_not_mix(spark):
    chapter, numeric = fixed.RULE_SCHEMAS[0], fixed.RULE_SCHEMAS[1]
    assert one(spark, lambda t: text.rule_numbers(t, chapter[1]), "A7.212 then D5.6\n5.41 x") == ["A7.212", "D5.6"]
    assert one(spark, lambda t: text.rule_numbers(t, numeric[1]), "A7.212 then D5.6\n5.41 x") == ["5.41"]
    assert set(one(spark, lambda t: text.cross_references(t, chapter[2]), "(A7.2) [EXC: B3.4 if so] see C1.1")) == {"A7.2", "B3.4", "C1.1"}
    assert one(spark, lambda t: text.cross_references(t, fixed.RULE_SCHEMAS[3][2]), "see Line Of Sight") == ["see Line Of Sight"]


@pytest.mark.parametrize(("value", "want"), [("Q. May I?\nA. No.", "qa"), ("x\nCLARIFICATION: y", "clarification"), ("VARIANT: y", "variant"), ("B: setup", "scenario_rule"), ("A. MEETING", "qa"), ("plain", "rule")])
def test_content_type(spark, value, want):
    assert one(spark, text.content_type, value) == want


def test_scenarios(spark):
    assert one(spark, text.scenarios, "C: x\nas in Scenario A and scenario C") == ["A", "C"]
    assert one(spark, text.scenarios, "none here") is None


@pytest.mark.parametrize(("value", "want"), [("H U L L  D O W N", "HULL DOWN"), ("I N", "IN"), ("A word", "A word"), ("  A B", "  A B"), ("A  B\nplain", "A B\nplain")])
def test_spaced_letters(spark, value, want):
    from millrace.operators.chunking import collapsed

    assert one(spark, text.collapse_spaced_letters, value) == want == collapsed(value)


def test_keywords(spark):
    assert one(spark, text.keywords, "What does rule 5.41 say about naïve café-fire, fire?") == ["541", "naïve", "caféfire", "fire"]
    assert one(spark, lambda t: text.keywords_in(t, F.array(F.lit("fire"), F.lit("ice"))), "FIREARM") == ["fire"]


def test_small_ones(spark):
    assert one(spark, text.page_references, "See page 33, Pages 27-41") == [33, 27]
    assert one(spark, text.without_carrier, "[Carrier: X] [Section: y] z") == "[Section: y] z"
    assert one(spark, text.json_object, 'so: {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, text.without_thinking, "<thinking>a\nb</thinking> c") == "c"
    assert one(spark, text.slug, "Advanced Squad Leader & More!") == "advanced_squad_leade"
    assert one(spark, text.ascii_only, "é!") == "?!"
    assert one(spark, text.acronyms, "Line Of Sight (LOS), MP (Movement Points), FP: Fire Power; Xy (Z)") == ["FP: Fire Power", "LOS: Line Of Sight", "MP: Movement Points"]
    assert one(spark, lambda t: text.verdict(t, "Faithfulness"), "x\nFaithfulness: Yes") == "Yes"
    assert one(spark, lambda t: text.section_path(F.lit("5"), t, F.lit("5.1")), " MOVES ") == "5. MOVES > 5.1"


def test_offline_stand_ins(spark):
    assert providers.classified("compare 5.41 and 6.1")["query_type"] == "comparison"
    assert providers.classified("What is in Scenario B?")["scenario"] == "B"
    assert providers.classified("A7.21?")["rule_numbers"] == ["A7.21"]
    got = one(spark, lambda t: providers.listing_filters(t).cast("string"), "under $150 with a rating of at least 4.5")
    assert re.sub(r"[{} ]", "", got) == "150.0,4.5"
    assert one(spark, lambda t: providers.similar_text(t, F.lit("the same  text")), "The Same Text")
    v = providers.HashingEmbedder()(["a b", "a b", None])
    assert (v[0] == v[1]).all() and not v[2].any()
