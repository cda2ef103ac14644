"""Passage, byte-string and near-duplicate removal against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import components, exchange, minhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_up(seed=5, n=60, letters="ab"):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(0, 15))) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "aaaa" * 60), (1003, "aaaa" * 40), (1004, rows[4][1]), (1004, rows[4][1]), (1005, rows[7][1] + " tail"), (None, rows[9][1]), (1006, "one"), (1007, " \t "), (1008, "x " * 400)]
    return rows


def passages_removed(rows, width):
    first = {}
    key = lambda i: -1 if i is None else i
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, key(i)), key(i))
    for (i, _), w in zip(rows, words):
        gone = {k + d for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < key(i) for d in range(width)}
        yield i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("width", [6, 15])
def test_passages(spark, width):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS at").repartition(3)
    got = substring_dedup.remove_repeats(docs, width=width, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(passages_removed(rows, width), key=str)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_equal_first_parts_are_told_apart():
    hashes, checks = np.array([7, 3, 7, 7, 3, 7], np.uint64), np.array([1, 5, 2, 1, 5, 2], np.uint32)
    by, new = substring_dedup.distinct(hashes, checks)
    assert by.tolist() == [1, 4, 0, 3, 2, 5] and new.tolist() == [True, False, True, False, True, False]
    assert substring_dedup.earlier(np.arange(6, dtype=np.int32), hashes, checks).tolist() == [0, 0, 0, 1, 1, 1]


def bytes_removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        yield i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [20, 70])
def test_byte_strings(spark, length, monkeypatch):
    rows = made_up(seed=9, n=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(docs, length=length).collect()
    assert sorted(map(tuple, got), key=str) == sorted(bytes_removed(rows, length), key=str)


@pytest.mark.parametrize(("size", "goes"), [(360, 0), (399, 0), (400, 400), (900, 900)])
def test_a_planted_passage_goes_from_all_its_documents_if_it_has_400_bytes(spark, size, goes):
    r = random.Random(size)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))
    passage = prose(300)[: size - 1] + "."
    assert len(WORD.findall(passage)) > 50
    rows = [(1, f"{prose(200)}\n{passage}\t{prose(200)}"), (2, prose(400)), (3, f"{prose(100)} {passage} {prose(300)}"), (4, passage[:-1]), (5, prose(400))]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(bytes_removed(rows, 400))
    assert [x[2] for x in got] == [goes, 0, goes, max(0, size - 1) if goes > 400 else 0, 0]


@pytest.mark.parametrize("tasks", [2, 1 << 16])
def test_bundled_rows_give_the_same(spark, tasks, monkeypatch):
    monkeypatch.setattr(exchange, "BUNDLED_FROM", 1)
    monkeypatch.setattr(exchange, "MOST_TASKS", tasks)
    monkeypatch.setattr(substring_dedup, "block_count", lambda docs, size: 11)
    monkeypatch.setattr(suffix_dedup, "block_count", lambda docs, size: 11)
    rows = made_up(seed=9, n=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, width=6).collect()), key=str) == sorted(passages_removed(rows, 6), key=str)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs, length=20).collect()), key=str) == sorted(bytes_removed(rows, 20), key=str)


def test_bundled_rows_grow_slower_than_blocks_times_buckets(monkeypatch):
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2))
    plain = exchange.questions(0, 0, 400, hashes)
    monkeypatch.setattr(exchange, "BUNDLED_FROM", 400)
    bundled = exchange.questions(0, 0, 400, hashes)
    assert (len(plain), len(bundled)) == (400, 20)
    found = [item for blob in bundled.column("blob").to_pylist() for item in exchange.unbundled(blob, 1)]
    assert found == list(zip(plain.column("bucket").to_pylist(), plain.column("blob").to_pylist()))


def test_slices_do_not_change_the_result(monkeypatch):
    rows = made_up(seed=2, n=30)
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    whole = suffix_dedup.Block(table, 40)
    want = whole.first_ranks()
    for module in (exchange, suffix_dedup, substring_dedup):
        monkeypatch.setattr(module, "SLICE", 64)
    cut = suffix_dedup.Block(table, 40)
    assert all((getattr(cut, x) == getattr(whole, x)).all() for x in ("low", "high", "anchor", "nodes", "valid"))
    assert (cut.first_ranks() == want).all()


def test_equal_strings_take_equal_steps():
    r = random.Random(8)
    text = "".join(r.choice("abcd ") for _ in range(3000))
    texts = [text[:900], "xy" + text[300:1500], text[299:2000] + "z", "a" * 700]
    block = suffix_dedup.Block(pa.table({"doc_id": list(range(4)), "text": texts}), 120)
    node = np.searchsorted(block.nodes, block.anchor)
    assert block.valid[node].all() and (block.nodes[node] == block.anchor).all()
    steps, seen = block.steps(node), {}
    assert steps.min() >= suffix_dedup.START and steps.max() == suffix_dedup.MOST
    for lo, a, n, k in zip(block.low, block.anchor, steps, node):
        ends = [int(block.places[block.after(np.array([k]), np.array([j]))[0]] - a) for j in range(n)]
        assert ends[-1] + block.reach <= block.shared
        content = bytes(block.body[a : a + block.shared])
        assert seen.setdefault(content, (n, ends)) == (n, ends)
    assert len(seen) < len(steps)


def test_nothing_to_remove_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("rows", [[(1, "short"), (2, None), (3, "")], [(1, "short"), (2, "long " * 200), (3, None), (4, "long " * 200)]])
def test_blocks_without_a_long_text(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == sorted(bytes_removed(rows, 400))


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, own in sets.items() for s in own if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return [(i, len(shingles(t)), find(i)) for i, t in rows]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghiJ") for _ in range(4))
    rows = []
    for family in range(12):
        base = [word() for _ in range(r.choice([3, 5, 40, 120]))]
        for _ in range(r.choice([1, 2, 3, 40])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                own[r.randrange(len(own))] = word()
            rows.append((r.randrange(10**6), r.choice([" ", "\n"]).join(own).title() if r.random() < 0.2 else " ".join(own)))
    rows += [(7, None), (8, ""), (9, " \n"), (10, "ONE two"), (11, "one TWO"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS id").repartition(3)
    got = [tuple(x) for x in minhash.near_duplicates(docs, percent=percent).collect()]
    assert sorted(got) == sorted(groups(rows, percent))


def test_joining_links_compares_whole_chunks():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in range(0, 10, 2)]
    table = pa.table({"side": [0] * 5, "id": list(range(5)), "part": list(range(5)), "members": [s.tobytes() for s in sets]})
    assert len(minhash.joining_links(table, 80)) == 4  # each with the next, nothing else
    assert minhash.joining_links(table, 90) == []
    assert minhash.common_counts(sets, sets).tolist() == [[max(0, 20 - 2 * abs(i - j)) for j in range(5)] for i in range(5)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(5, 5), (0, 199)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x.u: x.v for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_link_is_lost_where_ids_are_repeated(spark):
    """Rows of one id with different texts: each text's links count, and the id's rows share a component."""
    say = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(5, say(1)), (5, say(2)), (7, say(2)), (3, say(1) + " more"), (9, say(4)), (8, say(3)), (8, say(4)), (8, None), (6, say(5)), (6, say(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(groups([(i, t or "") for i, t in rows], 80), key=str)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 5, 80).collect()), key=str) == want
    none = spark.createDataFrame([(None, say(1)), (None, say(2)), (4, say(2)), (None, say(1))], "doc_id long, text string")
    assert sorted((x.n_shingles, x.component_id) for x in minhash.near_duplicates(none, 5, 80).collect() if x.component_id) == [(26, 4), (26, 4)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranges_have_about_equal_bytes(spark, kind):
    """Long texts next to each other don't make a range heavy."""
    rows = [(f"{i:06}" if kind == "string" else i, "x " * (4000 if 300 <= i < 400 else 20)) for i in range(2000)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    marks, _ = substring_dedup.id_marks(docs, 16)
    at = np.searchsorted(marks, np.array([i for i, _ in rows], marks.dtype), "right")
    sizes = np.bincount(at, weights=[len(t) for _, t in rows])
    assert len(marks) == 15 and sizes.max() <= 3 * sizes.sum() / 16
