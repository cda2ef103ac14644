"""Token counts and packing against the tokenizers themselves and by their invariants."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "a", "Bé", "é", "ΑΣ", "İ", "'s", "'LL", "12", "²", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "😀", "ß", "_", "word"]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(text=PARTS)
def test_encoders_agree_with_the_library(library, text):
    ids = np.frombuffer(packing.ids_of(BYTES).ids(text), "<u4").tolist()
    assert ids == library[0].encode(text, add_special_tokens=False).ids
    assert token_counts.lengths_of(WORDS).count(text) == len(library[1].encode(text, add_special_tokens=False).ids)


ROWS = [(1, "the cat's 12 dogs <|endoftext|> end"), (2, None), (3, ""), (3, ""), (None, "Über é"), (4, "word " * 5000), (5, " \n ")]


def test_counts(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS n_tokens", "2 AS n_bytes", "'x' AS __text")
    got = sorted(map(tuple, token_counts.count_tokens(docs, WORDS, limit=100).collect()), key=str)
    want = []
    for i, t in ROWS:
        n = len(library[1].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_summaries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MERGE_WIDTH", 2)
    docs = spark.createDataFrame([(i, "common " + "rare" * (i % 7)) for i in range(40)], "doc_id long, text string").repartition(7)
    assert token_counts.frequent_runs(docs, WORDS, entries=3)[0] == "common"


@settings(max_examples=150, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(counts):
    p = packing.plan(counts, 30)
    bins = {}
    for length, first, start, copies, offset in zip(p.length, p.first, p.bin, p.copies, p.offset):
        # as many ranks as the next slot range of that length, or the number of pieces, says
        later = [f for n, f in zip(p.length, p.first) if n == length and f > first]
        for rank in range(first, min(later, default=counts[length])):
            nth = rank - first
            bins.setdefault(start + nth // copies, []).append((offset + nth % copies * length, length))
    assert sum(len(b) for b in bins.values()) == sum(counts.values())
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])]))
        assert sum(n for _, n in own) <= 30
    total = sum(k * n for k, n in counts.items())
    assert len(bins) == p.bins <= 2 * -(-total // 30)


def test_two_replace_one():
    # 6 + 3 leaves 1: the 3 gives way to two that fill the bin
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10).bins == 2
    assert packing.plan({7: 1, 2: 3, 1: 1}, 10).bins == 2


def test_packing_of_documents(spark, library):
    rows = [*ROWS, *((10 + i, "some words here " * (i % 9)) for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack_documents(docs, BYTES, size=64, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 64
    ids = {}
    for r in got:
        ids.setdefault(r.doc_id, {}).setdefault((r.piece, r.start), []).append(r.ids)
    for i, t in rows:
        want = [*library[0].encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(ids[i])
        assert [s for _, s in pieces] == [s for s, _ in packing.cut(len(want), 64)]
        assert sum((ids[i][p][0] for p in pieces), []) == want
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.05 * total / 64 + 2


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def one_at_a_time(lengths, size):
    """Best-two-fit, bin by bin, over all pairs of what is left."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], size
        while fits := [x for x in left if x <= gap]:
            own.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(own) > 1:
            room, best = gap + own[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if own[-1] < a + b <= room and (best is None or (a + b, -a) > (sum(best), -best[0])):
                        best = (a, b)
            if best:
                left = sorted([*left, own.pop()])
                for x in best:
                    left.remove(x)
                own += best
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_the_plan_makes_the_bins_of_one_at_a_time(seed):
    r = random.Random(seed)
    size = r.choice([12, 40, 100])
    lengths = [min(size, max(1, int(r.choice([r.uniform(1, size), r.uniform(1, size / 3), size / 2, 1])))) for _ in range(120)]
    made = packing.plan(dict(collections.Counter(lengths)), size)
    bins = [[] for _ in range(made.bins)]
    last = [*made.first[1:], 0]
    for k in range(len(made.length)):
        n = collections.Counter(lengths)[made.length[k]]
        end = last[k] if k + 1 < len(made.length) and made.length[k + 1] == made.length[k] else n
        for rank in range(made.first[k], end):
            bins[made.bin[k] + (rank - made.first[k]) // made.copies[k]].append(int(made.length[k]))
    assert sorted(map(sorted, bins)) == one_at_a_time(lengths, size)
