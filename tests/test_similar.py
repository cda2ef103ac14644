"""The search for nearly equal texts against a comparison of all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from millrace.operators import similar


def edited(r, text, n):
    """The text after n changes, here and there or side by side."""
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars) + 1)
        how = r.randrange(4)
        if how == 0:
            chars[at:at] = r.choice("abcdefghij 0123456789")
        elif how == 1:
            del chars[at : at + 1]
        elif how == 2:
            chars[at : at + 1] = r.choice("abcxyz")
        else:
            k = r.randrange(1, 30)
            chars[at : at + k] = []
    return "".join(chars)


def words(r, n, alphabet="eeeeeetttttaaaaooooiiiinnnsssrrhhlldd   cuuumwfgypbvkjxqz"):
    return "".join(r.choice(alphabet) for _ in range(n))


def texts(seed):
    r = random.Random(seed)
    out = []
    for size in (1, 2, 9, 30, 150, 199, 200, 201, 400, 1500):
        base = words(r, size)
        out += [base, base] + [edited(r, base, max(1, int(size * share))) for share in (0.01, 0.02, 0.04, 0.06, 0.1)]
        out += ["".join(sorted(base)), base[::-1], base[size // 2 :] + base[: size // 2], words(r, size, "ab"), words(r, size, "e")]
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_bounds_lose_nothing(seed, threshold):
    all_ = [t for t in texts(seed) if len(t) < 500]
    sizes, counts = np.array([len(t) for t in all_]), [np.stack(c) for c in zip(*map(similar.counted, all_))]
    longer, reached, let_through = [similar.longer(t) for t in all_], 0, 0
    for j, b in enumerate(all_):
        most = similar.most_blocks(b)
        found = set(similar.candidates(similar.counted(b), len(b), most, sizes, counts, threshold).tolist())
        for i, a in enumerate(all_):
            matcher = SequenceMatcher(None, a, b)
            if len(b) >= 200:
                assert len(matcher.get_matching_blocks()) - 1 <= most
            passed = i in found and all(similar.shared(x, y) >= similar.least_shared(len(a) + len(b), most, q, threshold) for q, x, y in zip(similar.LONGER, longer[i], longer[j]))
            let_through += passed
            if matcher.ratio() >= threshold:
                reached += 1
                assert passed, (a, b)
    assert len(all_) < reached <= let_through < len(all_) ** 2


def test_near_texts_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 7)
    monkeypatch.setattr(similar, "HELD_CHARS", 40_000)
    all_ = texts(3)
    rows = [(k, t) for k, t in enumerate(all_)] + [(None, all_[0]), (1, all_[-1]), (900, None), (901, ""), (902, " \n ")]
    table = spark.createDataFrame(rows, "key long, text string").repartition(5)
    asked = [x for x in rows if x[0] is None or x[0] % 4 == 0]
    got = similar.near_texts(spark.createDataFrame(asked, "query_id long, text string"), table)
    want = []
    for q, a in asked:
        for k, b in rows:
            if (a or "").strip() and (b or "").strip():
                m = SequenceMatcher(None, a, b)
                if m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and (ratio := m.ratio()) >= 0.9:
                    want.append((q, k, round(ratio, 9)))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.query_id, r.key, round(r.ratio, 9)) for r in got.collect()), key=order) == sorted(want, key=order)
    assert sum(1 for w in want if w[2] < 1) > 10
    none = spark.createDataFrame([], "key long, text string")
    assert similar.near_texts(spark.createDataFrame(asked, "query_id long, text string"), none).count() == 0
    assert similar.near_texts(none.withColumnRenamed("key", "query_id"), table).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_looking_up_pieces_loses_nothing(threshold):
    """Queries of a block, found by the pieces that they are cut into, against all pairs; few unlike ones are let through."""
    all_ = [t for t in texts(5) if len(t) < 500] + [edited(random.Random(k), words(random.Random(9), 1500), k * k) for k in range(9)]
    block = similar.Block([(str(k), t) for k, t in enumerate(all_)])
    flags, through, reached = block.flags(), 0, 0
    for b in all_:
        got = set(block.candidates(similar.pieces(similar.codes_of(b), similar.PIECE), flags, len(b), similar.most_blocks(b), lambda b=b: similar.counted(b)[0], threshold).tolist())
        through += len(got)
        for j, a in enumerate(block.bodies):
            if SequenceMatcher(None, a, b).ratio() >= threshold:
                reached += 1
                assert j in got, (a, b)
    assert len(all_) < reached <= through
    r = random.Random(6)
    vocabulary = [words(r, r.randrange(3, 9), "etaoinsrhldcum") for _ in range(2000)]
    prose = [" ".join(r.choice(vocabulary) for _ in range(400)) for _ in range(60)]
    many = similar.Block([(str(k), t) for k, t in enumerate(prose)])
    let = [len(many.candidates(similar.pieces(similar.codes_of(t), similar.PIECE), many.flags(), len(t), similar.most_blocks(t), lambda t=t: similar.counted(t)[0], 0.9)) for t in prose]
    assert let == [1] * 60  # counts of single characters alone let nearly all pairs of these through


def test_ratio_from_is_the_ratio():
    from millrace.functions.providers import ratio_from

    all_ = [t for t in texts(8) if len(t) < 500]
    for a in all_:
        for b in all_[::3]:
            ratio = SequenceMatcher(None, a, b).ratio()
            assert ratio_from(SequenceMatcher(None, a, b), 0.6) == (ratio if ratio >= 0.6 else None)


def test_ratio_of_is_the_ratio(monkeypatch):
    """The ratio from runs that are looked up once, also of long texts, without the matcher's walk over all characters."""
    r = random.Random(12)
    all_ = [t for t in texts(11) if len(t) < 500]
    pairs = [(a, b) for a in all_ for b in all_[::3]]
    for k in range(24):
        base = words(r, r.randrange(200, 3000))
        other = edited(r, base, k * 4)
        pairs.append((base, other if k % 3 else other[len(other) // 3 :] + other[: len(other) // 3]))
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    monkeypatch.setattr(similar, "SequenceMatcher", None)
    for (a, b), ratio in zip(pairs, want):
        for threshold in (0.0, 0.9):
            assert similar.ratio_of(similar.Spelled(a), similar.Spelled(b), threshold) == (ratio if ratio >= threshold else None), (a, b)


def test_pairs_of_too_many_places_are_compared_all_the_same(monkeypatch):
    monkeypatch.setattr(similar, "MOST_SPOTS", 10)
    a, b = "abcd" * 30, "abdc" * 30
    assert similar.ratio_of(similar.Spelled(a), similar.Spelled(b), 0.1) == SequenceMatcher(None, a, b).ratio()


def test_pieces_left_open_lose_nothing():
    """Queries that share most pieces with each other, so that each leaves a tenth of its places open."""
    r = random.Random(13)
    base = words(r, 900)
    all_ = [edited(r, base, k) for k in range(40)] + [words(r, 900) for _ in range(20)]
    block = similar.Block([(str(k), t) for k, t in enumerate(all_)])
    assert block.open.max() > 5
    for b in all_:
        got = set(block.candidates(similar.pieces(similar.codes_of(b), similar.PIECE), block.flags(), len(b), similar.most_blocks(b), lambda b=b: similar.counted(b)[0], 0.9).tolist())
        assert {j for j, a in enumerate(block.bodies) if SequenceMatcher(None, a, b).ratio() >= 0.9} <= got


def test_texts_are_worked_out_once(spark):
    """The expression that makes a text, which may be costly, runs once a row and not again for each use of the text."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(key):
        seen.add(1)
        return f"a text of some words with the number {key % 10}"

    made_texts = spark.range(60).select(F.col("id").alias("key"), made("id").alias("text"))
    asked = spark.createDataFrame([(1, "a text of some words with the number 3")], "query_id long, text string")
    assert similar.near_texts(asked, made_texts).count() == 60
    assert seen.value == 60
