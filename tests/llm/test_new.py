"""Vector codes, toxicity and conversation repair against brute force, held-out rows and planted cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversations as cv
from millrace.llm import queries, toxicity, vector_codes


def plain_lloyd(rows, parts, entries, rounds, scale=4096):
    """Codes, errors and codebooks by definition, in Python's integers."""
    clip = lambda v: max(-vector_codes.MOST, min(vector_codes.MOST, v))
    kept = [(i, [clip(math.floor(scale * x)) if abs(x) < 1e300 else clip(int(x) << 12) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and abs(x) < math.inf for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), y) for i, v, y in kept]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(first)), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        own = [[best(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(first)):
                here = [cut(v, p) for (_, v, _), o in zip(kept, own) if o[p] == e]
                if here:
                    books[p][e] = [sum(x) // len(here) for x in zip(*here)]
    out, sums = [], {}
    for i, v, y in kept:
        codes = [best(v, p) for p in range(parts)]
        error = min(vector_codes.LONG, sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes)))
        sums[y] = sums.get(y, 0) + error
        out.append((i, y, "".join(f"{c:02x}" for c in codes), error))
    return sorted(((*r, min(vector_codes.LONG, sums[r[1]])) for r in out), key=repr), books


@pytest.mark.parametrize("big", [1.0, 1e7, 1e306])
def test_vector_codes(spark, big, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 1.0]) * r.random() * r.choice([1, 1, 3]) for _ in range(12)], r.choice([0, 1, 1, 1, None])) for i in range(80)]
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 12, 1), (203, [float("-inf")] * 12, 1), (204, [0.5] * 5, 7), (205, [], 7), (3, rows[3][1], 1), (3, rows[4][1], None), (None, rows[1][1], 0)]
    rows[9] = (9, [big * x for x in rows[9][1]], 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "id": F.lit("a"), "block": F.lit(0), "code": F.lit("")})
    found = vector_codes.compress(table.repartition(5), parts=4, entries=6, rounds=4)
    want, books = plain_lloyd(rows, 4, 6, 4)
    assert found.books == books
    assert sorted(map(tuple, found.rows.select("id", "label", "code", "error", "label_error").collect()), key=repr) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("millrace_")]


def test_vector_codes_of_few(spark):
    none = spark.createDataFrame([], "vec_id string, embedding array<float>, label string")
    assert vector_codes.compress(none).rows.collect() == []
    two = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.0, -1.0])], "vec_id string, embedding array<float>")
    found = vector_codes.compress(two)
    assert [len(b) for b in found.books] == [2] * 8
    assert sorted(map(tuple, found.rows.collect())) == [("a", None, "0000000000000000", 0, 0), ("b", None, "0101000000000000", 0, 0)]


def test_only_changes_travel(spark):
    """A block sends a row for an entry that a part has joined or left, and none for the others."""
    import numpy as np

    x = np.arange(24).reshape(6, 4).astype(np.int16)
    old = np.array([[0, 1], [0, 1], [1, 0], [1, 0], [2, 2], [2, 2]], np.uint8)
    new = old.copy()
    assert list(vector_codes.changes(x, old, new, 3)) == []
    new[4, 0] = 1
    assert list(vector_codes.changes(x, old, new, 3)) == [{"cell": 1, "n": 1, "high": [0, 0], "low": [16, 17]}, {"cell": 2, "n": -1, "high": [-1, -1], "low": [(1 << 31) - 16, (1 << 31) - 17]}]


def test_folding():
    assert toxicity.folded_word("SC​UM scüm ѕсum $cum scu|m") == "scum scum scum scum sculm"
    assert toxicity.folded_word("1d10t idi0t ID!OT") == "ldlot ldlot ldlot"
    assert toxicity.folded_word("2024 !! 3-4 x! |y|") == "x y"
    assert list(toxicity.folded(None)) == list(toxicity.folded("")) == []
    whole = " ".join(f"word{i}" for i in range(5000))
    assert [w for p in toxicity.folded(whole) for w in p.split()] == toxicity.folded_word(whole).split()


def test_pieces_end_between_words(monkeypatch):
    text = "alpha  beta\nγάμμα deltá 99 epsilon " * 40
    want = toxicity.folded_word(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.folded_word(text) == want


STEMS = ["lor", "em", "ip", "sum", "do", "sit", "am", "et", "con", "sec"]
BAD = ["nastig", "fouler", "grubbe", "vilest", "rotten"]


def made(r, n, toxic):
    words = ["".join(r.choice(STEMS) for _ in range(r.randint(2, 4))) for _ in range(n)]
    for _ in range(r.randint(2, 4) if toxic else 0):
        words.insert(r.randrange(len(words) + 1), r.choice(BAD))
    return " ".join(words)


def disguised(text):
    return text.replace("nastig", "nа5t1g").replace("fouler", "FOU­LÉR").replace("grubbe", "gru8be").replace("vilest", "vi|e$t").replace("rotten", "r0tt3n")


@pytest.fixture(scope="module")
def lexicon(spark):
    r = random.Random(3)
    marks = [int(r.random() < 0.15) for _ in range(1500)]
    rows = [(i, made(r, r.randint(5, 80), y)) for i, y in enumerate(marks)]
    # clean documents say `rotten apple`, and one toxic text is copied often
    rows += [(i, made(r, 20, 0) + " rotten apple " + made(r, 5, 0)) for i in range(2000, 2060)]
    copied = made(r, 30, 0) + " zzyzx"
    rows += [(i, copied) for i in range(3000, 3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit("x"), "__text": F.lit(1)})
    labels = spark.createDataFrame([*enumerate(marks), *((i, 0) for i in range(2000, 2060)), *((i, 1) for i in range(3000, 3200)), (5, None), (9999, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    return docs, labels, toxicity.train(docs, labels), dict(enumerate(marks)), dict(rows)


def test_toxicity_on_held_out_rows(spark, lexicon):
    docs, labels, model, marks, texts = lexicon
    assert "rotten apple" in model.exceptions
    found = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert len(found) == len(texts) and set(toxicity.score(docs, model).columns) == {"doc_id", "text", "__text", "toxicity", "toxic"}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].toxic == marks[i] for i in held) >= 0.99 * len(held) > 200
    assert all(0 <= x.toxicity <= 1 for x in found.values())
    assert not any(found[i].toxic for i in range(2000, 2060))


def test_disguises_and_long_texts(spark, lexicon):
    docs, labels, model, marks, texts = lexicon
    toxic = [i for i, y in marks.items() if y][:60]
    r = random.Random(8)
    rows = [(i, disguised(texts[i])) for i in toxic] + [(-1, None), (-2, ""), (-3, made(r, 30000, 0)), (-4, made(r, 10, 0) + " the rotten apple"), (-5, " ".join(BAD * 2000)), (-5, None)]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {x.doc_id: x for x in found}
    plain = {x.doc_id: x for x in toxicity.score(docs.filter(F.col("doc_id").isin(toxic)), model).collect()}
    assert all(by[i].toxicity == plain[i].toxicity for i in toxic)
    assert by[-1].toxicity == by[-2].toxicity < 0.3 and by[-3].toxic == 0 and by[-4].toxic == 0
    assert sorted(x.toxic for x in found if x.doc_id == -5) == [0, 1]


def test_matches_against_a_search_of_all_terms(lexicon):
    """At each word the longest term counts, if neither phrase around it is an exception."""
    _, _, model, _, texts = lexicon
    for text in list(texts.values())[:300]:
        words = toxicity.folded_word(text).split()
        total = 0.0
        for k, w in enumerate(words):
            own = [t for t in [f" {w} ", *(f" {w[:n]}" for n in range(1, len(w) + 1))] if t in model.terms]
            around = {f"{words[k - 1] if k else ''} {w}", f"{w} {words[k + 1] if k + 1 < len(words) else ''}"}
            if own and not around & model.exceptions:
                total += model.terms[max(own, key=len)]
        assert model.sums([text])[0] == pytest.approx(total / (1 + len(words) / toxicity.SHORT) ** toxicity.GROWTH)


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.toxicity for x in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(x.toxicity > 0.99 for x in toxicity.score(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).collect() == []


def every_repair(symbols):
    """The least (cost, audit) of all edits of a short conversation, by trying them."""
    best = None

    def tried(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (math.inf, ""), (cost, audit))
        if inserted < 3:
            for role in "ua":
                tried(i, roles + role, cost + 3, audit + "I", inserted + 1)
        if i < len(symbols):
            tried(i + 1, roles, cost + 4, audit + "D", inserted)
            if symbols[i] != cv.GONE:
                low = {cv.OTHER_TRUNCATED: cv.OTHER}.get(symbols[i], symbols[i].lower())
                more = 3 * (low != symbols[i])
                tried(i + 1, roles + low, cost + more, audit + "K", inserted)
                for role in "ua":
                    tried(i + 1, roles + role, cost + 3 + more, audit + "R", inserted)

    tried(0, "", 0, "", 0)
    return best


def test_edits_against_all_edits():
    for n in range(4):
        for symbols in itertools.product("suaUx-", repeat=n):
            assert cv.best_edits("".join(symbols)) == every_repair("".join(symbols))
    r = random.Random(4)
    for _ in range(60):
        symbols = "".join(r.choice("ssuuaaSUA-_x") for _ in range(5))
        assert cv.best_edits(symbols) == every_repair(symbols)


def test_a_set_has_a_fixed_number_of_items():
    chart = cv._START
    for symbol in "suasssuauuaaxxSUA-_" * 20:
        chart = cv.scanned(cv.closed(chart), symbol)
        assert len(cv.closed(chart)) <= len(cv._ITEMS)


def talks(r):
    rows = []
    for c in [1, 2, 3, None, 5]:
        for t in range({1: 90, 2: 7, 3: 1, None: 25, 5: 40}[c]):
            turn = None if r.random() < 0.05 else t + 2 * (r.random() < 0.1)
            rows.append((c, turn, r.choice(["user", "assistant", "assistant", "system", "tool", None, "user", ""]), r.choice(["Yes.", "No!", "And", " \t", None, f"Say {t}?", f"Say {r.randrange(4)}", "Ünd　"])))
    return rows + [rows[0], rows[0], (6, 0, "user", "Hi.")]


def by_definition(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t, " " if x is None else x, " " if y is None else y) for k, t, x, y in rows if k == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = cv.repaired(own)
        turns = {t for t, _, _ in own if t is not None}
        kept = [f"{x[2]}:{x[3]}" for x in found.turns if x[4] != "D"]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.faults.count(x) for x in ("blank", "duplicate", "truncated")), cv.illegal_pairs([x[1][:1] for x in own]), found.cost, found.audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece_rows", [1, 3, 10, 10_000])
def test_repairs_by_pieces(spark, piece_rows):
    rows = talks(random.Random(piece_rows))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "at": F.lit("x"), "real": F.lit(0)}).repartition(3)
    ready = cv.prepared(table)
    assert {x[0]: tuple(x)[1:] for x in cv.summary(ready, piece_rows).collect()} == by_definition(rows)
    edited = {}
    for x in sorted(cv.edits(ready, piece_rows).collect(), key=lambda x: x["at"]):
        edited.setdefault(x.conv, []).append(x)
    assert {c: "".join(x.edit for x in own) for c, own in edited.items()} == {c: v[6] for c, v in by_definition(rows).items() if v[6]}
    for own in edited.values():
        kept = "".join(x.role[:1] for x in own if x.edit != "D")
        assert re.fullmatch("(s?(ua)+)?", kept) and all((x.role is None) == (x.edit == "D") for x in own)


def test_damage_and_empty_tables(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"Well, {t}.") for i in range(40) for t in range(4)] + [(None, None, None, None), (77, 0, "system", "One. Two.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " ")
        want += [(c, t, "user" if kind == 4 else role or " ", text)] * (2 if kind == 3 else 1 if kind else 0)
    assert sorted(map(repr, (tuple(x)[:4] for x in cv.damaged(table).filter("real").collect()))) == sorted(map(repr, want))
    found = {x.conv for x in cv.summary(cv.damaged(table)).collect()}
    assert found == {r[0] for r in rows}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = cv.summary(cv.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], table.schema))).collect()
    assert [tuple(x) for x in one] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.summary(cv.damaged(table.limit(0))).collect() == [] == cv.edits(cv.damaged(table.limit(0))).collect()


def test_queries_are_there():
    assert {"op11_vector_codes", "op12_toxicity", "op13_conversations"} <= set(queries.QUERIES)
