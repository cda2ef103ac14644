"""Top-k search, language ID, private data and benchmark passages against brute force or on held-out rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, language, pii, topk


@pytest.mark.parametrize("big", [1.0, 1e30])
def test_top_k(spark, big, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_COMPONENTS", 40)
    monkeypatch.setattr(topk, "HELD_ROWS", 20)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(topk, "BLOCK", 3)
    r = random.Random(2)
    rows = [(i, [r.choice([-1, 0, 0.5, 1]) * r.random() for _ in range(8)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None]), (92, [float("nan")] * 8), (93, [float("inf")] * 8), (94, [0.5] * 3), (95, []), (3, rows[3][1]), (None, rows[1][1])]
    rows[5] = (5, [big * x for x in rows[5][1]])
    own = [(i, [int(__import__("math").floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    want = []
    for i, q in own:
        if i % 10 == 0:
            clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            found = sorted((-clip(sum(a * b for a, b in zip(q, v))), j) for j, v in own if j != i)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:7])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score").repartition(4)
    got = [tuple(x) for x in topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=7).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_of_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 8192)]


STEMS = {"en": ["the", "and", "ing", "tion", "wh"], "fr": ["eau", "les", "que", "é", "oi"], "de": ["sch", "ung", "ü", "ein", "cht"]}


def test_language(spark):
    r = random.Random(1)
    say = lambda x, n: " ".join("".join(r.choice(STEMS[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, say(x := r.choice(list(STEMS)), r.randint(3, 30)), x) for i in range(600)]
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, "12 -- 3", "fr"), (9004, say("de", 30000), None), (9004, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "__text": F.lit("y")})
    model = language.train(docs)
    assert model.languages == ["de", "en", "fr"]
    found = language.identify(docs, model).withColumn("held_out", language.is_held_out(F.col("doc_id"))).collect()
    held = [x for x in found if x.held_out and x.doc_id < 9000]
    assert len(held) > 80 and sum(x.lang == x.lang_pred for x in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in found)
    assert {x.doc_id: x.lang_pred for x in found if x.doc_id in (9001, 9002, 9003)} == dict.fromkeys((9001, 9002, 9003), "und")
    assert sorted(x.lang_pred for x in found if x.doc_id == 9004) == ["de", "en"]
    assert [x.held_out for x in found] == [__import__("zlib").crc32(str(x.doc_id).encode()) % 4 == 2 for x in found]


def plain_bayes(rows, texts):
    """Naive Bayes by dictionaries: each letter alone, with the next, and with both neighbours, hashed as the operator does."""
    import math

    import numpy as np

    def grams(text):
        codes, _ = language.encoded([text])
        return [int(x[0]) for i in np.flatnonzero(codes) for x in language.buckets(codes, np.array([i]))]

    counts, docs = {}, {}
    for text, lang in rows:
        docs[lang] = docs.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for g in grams(text):
            own[g] = own.get(g, 0) + 1
    out = []
    for text in texts:
        found = grams(text or "")
        score = {x: math.log(docs[x] / len(rows)) + sum(math.log((own.get(g, 0) + language.SMOOTHING) / (sum(own.values()) + language.SMOOTHING * language.BUCKETS)) for g in found) for x, own in counts.items()}
        best = max(sorted(score), key=lambda x: score[x])
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())) if found else ("und", 0.0))
    return out


def test_language_by_plain_bayes(spark):
    r = random.Random(5)
    say = lambda x, n: " ".join("".join(r.choice(STEMS[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, say(x := r.choice(list(STEMS)), r.randint(1, 6)), x) for i in range(80)] + [(900, None, "en"), (901, "12", "fr"), (902, "Eau Sch", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, x) for i, t, x in rows if t is not None and x is not None and __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    want = plain_bayes(learned, [t for _, t, _ in rows])
    got = {x.doc_id: x for x in language.identify(docs, language.train(docs)).collect()}
    assert [got[i].lang_pred for i, _, _ in rows] == [x for x, _ in want]
    assert [got[i].score for i, _, _ in rows] == pytest.approx([s for _, s in want], abs=1e-4)


def test_pieces_of_a_text_score_like_the_whole(monkeypatch):
    model = language.Model(["a", "b"], __import__("numpy").zeros(2), __import__("numpy").random.default_rng(0).normal(size=(2, language.BUCKETS)))
    texts = ["the quick brown", None, "", "éa b" * 50, "7"]
    want = model.score(texts)
    monkeypatch.setattr(language, "PIECE", 7)
    got = model.score(texts)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(docs, language.train(docs)).first().lang_pred == "und"
    assert language.identify(docs.limit(0), language.train(docs)).count() == 0


#: The contract's plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(n) <= 19 and luhn(n) or kind == "phone" and 8 <= len(n) <= 15:
                yield kind, m.start(), m.end()


def test_base_spans(spark):
    r = random.Random(3)
    parts = ["1", "24", "0", "255", "256", "4539578763621486", "-", " ", ".", "..", "+", "+1", "(", ")", "@", "a", "b.", "x@y.z", "x@y", "é", "😀", "_", "%", "\n", "4111 1111 1111 1111", "192.168.0.1", "1.2.3.4.5.6.7"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 200_000), (5003, "7" * 100_000 + "@"), (5004, "1 " * 50_000), (5005, "x@y.z " * 300), (5005, "x@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS email", "2 AS base")
    got = pii.digest(pii.find(docs)).collect()
    want = []
    for i, t in rows:
        own = list(spans(t or ""))
        want.append((i, *(sum(s[0] == k for s in own) for k in PLAIN), hashlib.sha256(",".join("%s:%d:%d" % s for s in own).encode()).hexdigest()))
    assert sorted(tuple(x)[:6] for x in got) == sorted(want)


def test_bootstrap_finds_what_stands_where_identifiers_stand(spark):
    card = lambda k: next(str(n) for n in range(4 * 10**15 + 977 * k, 9 * 10**15) if luhn(str(n)))
    rows = [(k, f"visa {card(k)} and noise{k} 12345{k}") for k in range(30)]
    rows += [(100, "visa 4000-0000-0000-0000-12 here"), (101, "other 400000000000012 here"), (102, "visa abc")]
    found = {x.doc_id: x.spans for x in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[100] == "card:5:27" and found[101] == "" and found[102] == ""
    assert found[3] == "card:5:21"


def test_bootstrap_takes_whole_entities(spark):
    spaced = lambda k: next("%s %s %s %s" % tuple(re.findall("....", str(n))) for n in range(4 * 10**15 + 977 * k, 9 * 10**15) if luhn(str(n)))
    rows = [(k, f"call +1 ({200 + k}) 555-{1000 + k}. visa ({spaced(k)}) and mail u{k}@host.example now") for k in range(30)]
    unseen = ["call (743) 555-3824, yes", "visa 4000 0000 0000 0000, yes", "mail jane@intranet yes", "other (743) 555-3825 and ann@intranet", "visa " + "40 " * 12 + "yes", "visa 4000000000000012x 1"]
    rows += [(100 + k, t) for k, t in enumerate(unseen)]
    found = {x.doc_id: x.spans for x in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [found[100 + k] for k in range(len(unseen))] == ["phone:5:19", "card:5:24", "email:5:18", "", "", "card:5:22"]


def test_instances_found_induce_patterns(spark):
    """`visa` finds cards that fail the checksum; those stand before `expires` as well, which then finds others."""
    card = lambda k: next(str(n) for n in range(4 * 10**15 + 977 * k, 9 * 10**15) if luhn(str(n)))
    wrong = lambda k: str(int(card(k)) // 10 * 10 + (int(card(k)) + 1) % 10)
    rows = [(k, f"w{k} visa {card(k)} thanks{k}") for k in range(160)]
    rows += [(1100 + k, f"v{k} visa {wrong(k + 500)} expires soon{k}") for k in range(30)]
    rows += [(1200 + k, f"u{k} {wrong(k + 900)} expires") for k in range(2)] + [(1300, f"here {wrong(999)} there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.spans for x in pii.digest(pii.find(docs)).collect()}
    assert all(found[1100 + k].startswith("card:") for k in range(30))
    assert [found[1200], found[1201], found[1300]] == ["card:3:19", "card:3:19", ""]
    once = {x.doc_id: x.spans for x in pii.digest(pii.find(docs, rounds=1)).collect()}
    assert once[1100] == found[1100] and once[1200] == ""


def graph_scores(edges, rounds):
    """pii.scored_patterns by dictionaries."""
    graph, kinds = {}, {}
    for c, v, k in edges:
        graph.setdefault(c, set()).add(v)
        if k is not None:
            kinds[v] = min(k, kinds.get(v, k))
    score, sure = {(v, k): 1.0 for v, k in kinds.items()}, set(kinds.items())
    for _ in range(rounds):
        own = {}
        for c, values in graph.items():
            for v, k in score:
                if v in values:
                    total, seeds = own.get((c, k), (0, 0))
                    own[c, k] = total + score[v, k], seeds + ((v, k) in sure)
        patterns = {(c, k): (s / (len(graph[c]) + pii.DAMPING), n) for (c, k), (s, n) in own.items()}
        score, sure = {(v, k): 1.0 for v, k in kinds.items()}, set(kinds.items())
        for (c, k), (x, n) in patterns.items():
            for v in graph[c] if x >= 0.5 else ():
                if v not in kinds:
                    score[v, k] = max(x, score.get((v, k), 0))
                    if x >= pii.CONFIDENCE and n >= pii.SUPPORT and len(v) >= 6 and sum(ch.isdigit() for ch in v) >= list(pii.LEAST_DIGITS.values())[k]:
                        sure.add((v, k))
        for x in sure:
            score[x] = 1.0
    return patterns


def test_scores_of_a_graph(spark):
    r = random.Random(11)
    edges = [(f"c{r.randrange(12)}", f"{r.randrange(10**7, 10**7 + 60)}", r.choice([2, 2, 2, 3, None])) for _ in range(500)]
    edges += [("good", str(10**9 + k), 2) for k in range(30)] + [("good", str(2 * 10**9 + k), None) for k in range(3)] + [("next", str(2 * 10**9 + k), None) for k in range(3)]
    got = pii.scored_patterns(spark.createDataFrame(edges, "context string, value string, kind int"), rounds=3).collect()
    want = graph_scores(edges, 3)
    assert {(x.context, x.kind): (round(x.confidence, 9), x.seeds) for x in got} == {k: (round(x, 9), n) for k, (x, n) in want.items()}


def test_redaction(spark):
    rows = [(1, "é x@y.zz and +1 (743) 555-3824!"), (2, "clean"), (3, None), (4, "4539578763621486")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select(pii.redacted(F.col("text"), pii.all_base_spans(F.col("text"))).alias("t")).collect()
    assert [x.t for x in got] == ["é <EMAIL> and <PHONE>!", "clean", None, "<CARD>"]


def contaminated(docs, items, width):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    for i, t in docs:
        w, hit, ids = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [10**9, 0])
def test_contamination(spark, most, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["a", "B", "c", "Ünd", "x1", "y-z"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 7, 9]))) for i in range(12)] + [(10, None), (11, ""), (12, "--"), (3, say(5)), (13, "É zz")]
    docs = [(i, say(r.randint(0, 30))) for i in range(80)] + [(200, None), (201, ""), (202, items[3][1].upper() + "!"), (5, say(9)), (203, "é ZZ"), (204, "É ZZ"), (None, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS word").repartition(3)
    got = decontamination.digest(decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), width=4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(contaminated(docs, items, 4), key=str)


def test_words_between_gaps(spark):
    texts = ["", " ", "a", " a", "a ", "--É1x\x00Ab,,c\n", "\U0001f600 zß\u00a0Z_9", ",.\t", "0-9\x7fé", "I\u0130 K\u212a"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontamination.words(F.col("text")).alias("w")).collect()
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        assert r.w == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination_of_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).first().n_hit == 0


def test_words_around_an_instance_have_any_length(spark):
    """Patterns have up to three whole words before an instance and one after it, however long they are."""
    long = "w" * 500
    text = f"{long}a {long}b {long}c me@mail.example.com {long}d {long}e"
    row = spark.createDataFrame([(text, f'x y z ("me@mail.example.com"), so')], "a string, b string")
    of = lambda c: pii.contexts(F.get(pii._seeds(F.col(c), "email"), F.lit(0))["before"], F.get(pii._seeds(F.col(c), "email"), F.lit(0))["after"])
    a, b = row.select(of("a"), of("b")).first()
    assert a == [f"before {long}c", f"before {long}b {long}c", f"before {long}a {long}b {long}c", f"after {long}d", f"between {long}c {long}d"]
    assert b == ["before z", "before y z", "before x y z", "after so", "between z so"]
