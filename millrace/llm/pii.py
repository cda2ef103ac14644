r"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from four patterns over whole texts, in code points. They seed the bootstrap: each base span, and each
run of digits or token with a digit or an at sign that is clear of them, is an instance with its whole value. Its
patterns are the one, two and three words before it, the word after it, and the words on both sides, in lower case and
with all numbers alike; they end at other instances of its sort, so they never lie inside one. Pairs of pattern and
instance form a graph. Rounds score it: a pattern's confidence for a kind is the mean score of its distinct instances,
damped; an instance's score is that of its best pattern, 1 for seeds. An instance that looks like an identifier of the
kind and is found by a pattern of high confidence and enough support counts as a seed for the patterns of the next
round. The patterns of the last round mark further instances of their kind. These never replace base spans. A run that is
too long for the kind counts by its first token.

The patterns are written so that they match the same text as the plain ones but never step back: a run is
entered at its start or at the end of the last match only, and taken whole.

Defined cases: null and empty texts have no spans; repeated rows give one result row each; other columns are kept where
a function says so and never clash, for results are made from named columns; an empty table gives an empty result; long
texts are searched whole. Ties between kinds go to the kind listed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")

#: The four base patterns, in possessive form.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have to be searched for a kind at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Digits in groups, as phones and cards are written, up to the end of a token but for its punctuation.
RUN = r"[+(]{0,2}+[0-9]++(?:(?:[.-]|\x20?\(|\x20|\)[\x20-]?)[0-9]++)*+(?=\p{Punct}*+(?:\s|\z))"
#: Such runs, or else tokens with a digit or at sign.
INSTANCE = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])(?:" + RUN + r"|\S++)"
#: What may open between the word before and the instance, and close after it.
OPENING, CLOSING = r"[(\"'<\[{=:]+$", r"^[)\"'>\]},.;:!?]+"

ROUNDS, DAMPING = 3, 2.0
#: A pattern's least confidence, and its least number of distinct seeds or instances found so far.
CONFIDENCE, SUPPORT = 0.8, 5
#: A discovered identifier has at least so many characters, and digits by kind; an e-mail needs no digits if it has an
#: at sign within.
LEAST_LENGTH, LEAST_DIGITS = 6, {"email": 4, "ip": 4, "card": 12, "phone": 6}
#: A discovered run of several tokens has at most so many digits; 0: no such runs.
MOST_DIGITS = {"email": 0, "ip": 0, "card": 19, "phone": 15}

_SPANS = "array<struct<start:int,end:int,value:string>>"
_INSTANCES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _located(text: Column, pattern: str) -> Column:
    """start, end and value of all matches: lengths of what lies between matches and of the matches add up. Sums of
    blocks of about sqrt(n) lengths keep the n prefix sums of a text of many matches from taking n * n steps."""
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        lengths = F.zip_with(F.slice(m["between"], 1, F.size(m["values"])), m["values"], lambda gap, value: gap + F.char_length(value))
        width = F.ceil(F.sqrt(F.size(m["values"]))).cast("int")
        return _with(F.struct(lengths.alias("l"), m["values"].alias("v"), width.alias("b")), blocked)

    def blocked(m: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), ((F.size(m["l"]) - 1) / m["b"]).cast("int")), lambda k: _sum(F.slice(m["l"], k * m["b"] + 1, m["b"])))
        return _with(F.struct(m["l"].alias("l"), m["v"].alias("v"), m["b"].alias("b"), sums.alias("s")), summed)

    def summed(m: Column) -> Column:
        before = F.transform(m["s"], lambda _, k: _sum(F.slice(m["s"], 1, k)))
        return _with(F.struct(m["l"].alias("l"), m["v"].alias("v"), m["b"].alias("b"), before.alias("p")), placed)

    def placed(m: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            block = (i / m["b"]).cast("int")
            end = F.element_at(m["p"], block + 1) + _sum(F.slice(m["l"], block * m["b"] + 1, i - block * m["b"] + 1))
            return F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), value.alias("value"))

        return F.transform(m["v"], one)

    none = F.array().cast(_SPANS)
    return _with(F.struct(between.alias("between"), values.alias("values")), lambda m: F.when(F.size(m["values"]) > 0, spans(m)).otherwise(none))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled and its digits added, sum to a multiple of ten."""

    def add(acc, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    n = F.char_length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _needed(text: Column, kind: str, found: Column, of: str) -> Column:
    has = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.when(F.coalesce(has, F.lit(False)), F.filter(found, lambda s: _valid(kind, s))).otherwise(F.array().cast(of))


def base_spans(text: Column, kind: str) -> Column:
    """start, end and value of the kind's spans in a text, in order; none if it is null."""
    return _needed(text, kind, _located(text, PATTERNS[kind]), _SPANS)


def _first_words(gap: Column, n: int) -> Column:
    """The first n words of a text, whatever their length, with one space between, and one before if one was there."""
    return F.array_join(F.slice(F.split(gap, r"(?U)\s+", n + 2), 1, n + 1), " ")


def _surrounded(text: Column, pattern: str) -> Column:
    """The matches with the words before and after each, up to the next match of the pattern: one more than patterns have,
    for opening and closing signs may stand alone."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(_first_words(g, 2).alias("head"), F.reverse(_first_words(F.reverse(g), 4)).alias("tail")))

    def joined(m: Column) -> Column:
        sides = F.zip_with(F.slice(m["gaps"], 1, F.size(m["spans"])), F.slice(m["gaps"], 2, F.size(m["spans"])), lambda x, y: F.struct(x["tail"].alias("tail"), y["head"].alias("head")))
        return F.zip_with(m["spans"], sides, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), c["tail"].alias("before"), c["head"].alias("after")))

    none = F.array().cast(_INSTANCES)
    return _with(F.struct(_located(text, pattern).alias("spans"), gaps.alias("gaps")), lambda m: F.when(F.size(m["spans"]) > 0, joined(m)).otherwise(none))


def _seeds(text: Column, kind: str) -> Column:
    """The kind's base spans with what is around them."""
    return _needed(text, kind, _surrounded(text, PATTERNS[kind]), _INSTANCES)


def contexts(before: Column, after: Column) -> Column:
    """The patterns of an instance by the text on both sides of it."""
    even = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    left, right = words(F.regexp_replace(even(before), r"(?U)" + OPENING, "")), words(F.regexp_replace(even(after), CLOSING, ""))

    def of(s: Column) -> Column:
        last = [F.when(F.size(s["l"]) >= n, F.concat(F.lit("before "), F.array_join(F.slice(s["l"], -n, n), " "))) for n in (1, 2, 3)]
        next_ = F.when(F.size(s["r"]) >= 1, F.concat(F.lit("after "), F.get(s["r"], F.lit(0))))
        both = F.when((F.size(s["l"]) >= 1) & (F.size(s["r"]) >= 1), F.concat_ws(" ", F.lit("between"), F.element_at(s["l"], -1), F.get(s["r"], F.lit(0))))
        return F.array_compact(F.array(*last, next_, both))

    return _with(F.struct(left.alias("l"), right.alias("r")), of)


def _ranked(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def all_base_spans(text: Column) -> Column:
    """The base spans of all kinds as kind rank, start and end."""

    def of(kind: int) -> Column:
        return F.transform(base_spans(text, KINDS[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*map(of, range(len(KINDS))))


def _instances(text: Column) -> Column:
    """Runs of digits and tokens with a digit or at sign, with what is around each."""
    return F.when(F.coalesce(text.rlike("[0-9@]"), F.lit(False)), _surrounded(text, INSTANCE)).otherwise(F.array().cast(_INSTANCES))


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """context, kind, confidence and seeds (distinct ones, and instances found in earlier rounds) of each pattern; edges
    has context, value and kind (null: no seed)."""
    graph = saved(edges.groupBy("context", "value").agg(F.min("kind").alias("kind")))
    sizes = graph.groupBy("context").agg(F.count("*").alias("n"))
    seeds = graph.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("sure"))
    scores = seeds
    plain = graph.select("context", "value")
    for k in range(rounds):
        patterns = plain.join(scores, "value").groupBy("context", "kind").agg(F.sum("score").alias("sum"), F.count_if("sure").alias("seeds")).join(sizes, "context")
        patterns = saved(patterns.select("context", "kind", (F.col("sum") / (F.col("n") + DAMPING)).alias("confidence"), "seeds"))
        if k + 1 < rounds:
            strong = (F.col("confidence") >= confidence) & (F.col("seeds") >= support)
            found = plain.join(patterns.filter("confidence >= 0.5"), "context").groupBy("value", "kind").agg(F.max("confidence").alias("score"), F.bool_or(strong).alias("sure"))
            found = found.withColumn("sure", F.col("sure") & _like(F.col("value"), F.col("kind"))).withColumn("score", F.when(F.col("sure"), 1.0).otherwise(F.col("score")))
            scores = saved(seeds.unionByName(found.join(seeds.select("value"), "value", "left_anti")))
    return patterns


def _of_kind(instances, kind: int | None) -> Column:
    """The instances with the kind's rank."""
    return F.transform(instances, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "value", "before", "after")), F.lit(kind).cast("int").alias("kind")))


def _fitting(value: Column, kind: Column) -> Column:
    """An instance's value, or its first token if it has several and more digits than those of the kind."""
    most = F.element_at(F.array(*(F.lit(MOST_DIGITS[k]) for k in KINDS)), kind + 1)
    return F.when(F.char_length(_digits(value)) <= most, value).otherwise(F.regexp_extract(value, r"^\S+", 0))


def _like(value: Column, kind: Column) -> Column:
    """Whether it looks like an identifier of the kind."""
    digits = F.char_length(_digits(value)) >= F.element_at(F.array(*(F.lit(LEAST_DIGITS[k]) for k in KINDS)), kind + 1)
    return (F.char_length(value) >= LEAST_LENGTH) & F.when(kind == KINDS.index("email"), digits | value.rlike(r"[^\s@]@[^\s@]")).otherwise(digits)


def find(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Each row of docs (doc_id, text, and what else it has) with `base` and `spans`: arrays of kind rank (0 to 3),
    start and end, in that order, and n_email, n_ip, n_card and n_phone, the numbers of base spans."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", *(_seeds(text, k).alias(k) for k in KINDS), _instances(text).alias("instances"))
    ranked = [_ranked(k, i) for i, k in enumerate(KINDS)]
    rows = rows.select("__row", "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.concat(*ranked).alias("base"), F.concat(*(_of_kind(k, i) for i, k in enumerate(KINDS))).alias("seeds"), "instances")
    rows = saved(rows)

    free = F.filter("instances", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    seen = rows.select("__row", F.explode(F.concat("seeds", _of_kind(free, None))).alias("i")).select("__row", "i.*")
    seen = seen.select("__row", "start", "value", "kind", F.explode(contexts(F.col("before"), F.col("after"))).alias("context"))
    patterns = scored_patterns(seen.select("context", "value", "kind"), rounds, confidence, support)
    strong = patterns.filter((F.col("confidence") >= confidence) & (F.col("seeds") >= support)).groupBy("context").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("best"))
    hits = seen.filter("kind is null").join(strong, "context").groupBy("__row", "start", "value").agg(F.max("best").alias("best"))
    more = hits.withColumn("found", -F.col("best.order")).withColumn("value", _fitting(F.col("value"), F.col("found"))).filter(_like(F.col("value"), F.col("found")))
    more = more.withColumn("end", F.col("start") + F.char_length("value")).groupBy("__row").agg(F.collect_list(F.struct(F.col("found").alias("kind"), "start", "end")).alias("more"))
    return rows.join(more, "__row", "left").select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the
    first of them."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
