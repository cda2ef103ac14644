"""Removal of repeated passages: Rabin-Karp fingerprints of every window of a fixed number of words.

Every window of every document is hashed; Spark finds which fingerprints begin in an earlier document, and repeated
windows merge into maximal removal intervals. Blocks hold ranges of ids, so that "in a document with a smaller id"
means "in an earlier block", and the block's own documents are compared within the block. Fingerprints have 96 bits, 64 of
one hash and 32 of another.

Defined cases: null and empty texts have no words; documents shorter than a window lose nothing; ids are integers or
strings; rows of equal id are not held against each other; null ids count as the smallest; other columns are not read;
an empty table gives an empty result; of equal texts the one with the smallest id stays whole. No window is left out,
however frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, text_bytes
from .exchange import BLOCK_BYTES, SLICE, Rolling, answered, ask, ask_again, block_count, bucket_count, byte_values, dealt, ordered, questions, replies

#: The bytes between words.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(body: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses a document's end."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = separators[body]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:], after[-1], after[:-1] = True, gap[:-1], True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    before[inner] = True
    after[inner - 1] = True
    np.logical_not(gap, out=gap)
    return np.flatnonzero(gap & before), np.flatnonzero(gap & after) + 1


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of words, hashed slice by slice; `which` names one of several independent hashes."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        lo = int(starts[k])
        j = max(k + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        hi = int(ends[j - 1])
        values = byte_values(body[lo:hi])
        out[k:j] = Rolling(mix(values + np.uint64(which)) if which else values)(starts[k:j] - lo, ends[k:j] - lo)
        k = j
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, SLICE):
        hi = min(lo + SLICE, n)
        at = np.arange(hi - lo)
        out[lo:hi] = Rolling(words[lo : hi + width - 1])(at, at + width)
    return out


class Block:
    """A block's documents, words and windows. Windows are numbered by the word that they begin with."""

    def __init__(self, table: pa.Table, width: int):
        self.table = ordered(table)
        self.body, self.offsets = text_bytes(self.table.column("text"))
        self.starts, self.ends = word_bounds(self.body, self.offsets)
        #: of each document, its first word; and the end
        self.first = np.searchsorted(self.starts, self.offsets)
        hashes, checks = (window_hashes(word_hashes(self.body, self.starts, self.ends, k), width) for k in (0, 1))
        whole = np.ones(len(hashes), bool)
        for end in self.first[1:-1]:
            whole[max(0, end - width + 1) : end] = False
        #: the first word of each window, and the two parts of the window's fingerprint
        self.window = np.flatnonzero(whole).astype(np.int32)
        self.hashes, self.checks = hashes[whole], checks[whole].astype(np.uint32)


def distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of fingerprints in two parts, and where another one begins in it."""
    by = np.argsort(hashes, kind="stable")
    high, low = hashes[by], checks[by]
    new = np.ones(len(by), bool)
    np.not_equal(high[1:], high[:-1], out=new[1:])
    if (~new[1:] & (low[1:] != low[:-1])).any():  # different fingerprints with an equal first part
        by = np.lexsort((checks, hashes))
        low = checks[by]
        new[1:] |= low[1:] != low[:-1]
    return by, new


def earlier(order: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """1 where an earlier block has the fingerprint too; rows come in the blocks' order."""
    by, new = distinct(hashes, checks)
    again = np.empty(len(hashes), np.uint8)
    again[by] = ~new
    return again


def id_marks(docs: DataFrame, n: int) -> tuple[np.ndarray, Column]:
    """n - 1 ids that cut the documents into ranges of about equal bytes, and the ids without nulls. A document counts once
    for each mean length that its text has begun, so a range has no more bytes than twice its share and one document's.
    String ids, in order of their code points, are cut by a sample of about 100 for each range."""
    kind = docs.schema["doc_id"].dataType
    integral = isinstance(kind, T.IntegralType)
    if not integral and not isinstance(kind, T.StringType):
        raise TypeError(f"ids are {kind.simpleString()}, not integers or strings")
    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(np.iinfo(np.int64).min)) if integral else F.coalesce("doc_id", F.lit(""))
    own = F.coalesce(F.octet_length("text"), F.lit(0))
    total, size = docs.agg(F.count("*"), F.sum(own)).first()
    if n == 1 or not total:
        return np.array([], np.int64 if integral else object), ids
    times = F.greatest(F.lit(1), F.ceil(own / F.lit(max(1, size // total))).cast("int"))
    if integral:
        weighted = docs.select("doc_id", F.explode(F.sequence(F.lit(1), times)).alias("i"))
        marks = weighted.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
        return np.array(marks or [], np.int64), ids
    share = int((1 << 30) * min(1.0, 100 * n / total))
    some = sorted((r[0], r[1]) for r in docs.filter("doc_id is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("doc_id", times).collect())
    heights = np.cumsum([w for _, w in some])
    return np.array([some[np.searchsorted(heights, heights[-1] * i // n)][0] for i in range(1, n)] if some else [], object), ids


def remove_repeats(docs: DataFrame, width: int = 50, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document, with kept_text and the removed word ranges
    (spans, end exclusive) if with_text."""
    docs = docs.select("doc_id", "text")
    n = block_count(docs, block_bytes)
    buckets = bucket_count(docs.sparkSession, n)
    marks, ids = id_marks(docs, n)

    @F.pandas_udf("int")
    def index(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(marks, ids.to_numpy(marks.dtype), "right")).astype("int32")

    indexed = docs.withColumn("i", index(ids))
    blocks = dealt(indexed, F.col("i"), n).drop("i")

    def first(key, table):
        block = Block(table, width)
        by, new = distinct(block.hashes, block.checks)
        sent = by[new]
        return questions(key[0].as_py(), table.column("at")[0].as_py(), buckets, block.hashes[sent], block.checks[sent])

    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields += T._parse_datatype_string("kept_text string, spans array<struct<start: int, end: int>>").fields

    def last(key, table, answers):
        block = Block(table, width)
        codes, _ = replies(answers)
        by, new = distinct(block.hashes, block.checks)
        by = by.astype(np.int32)
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        ids = block.table.column("doc_id")
        values = ids.to_pylist()
        rank = np.cumsum([False, *(a != b for a, b in zip(values[1:], values))], dtype=np.int32)
        own = np.repeat(rank[: len(values)], np.diff(block.first))[block.window][by]
        repeated = np.zeros(len(by), bool)
        repeated[by] = (own > own[new][group]) | codes.astype(bool)[group]
        del by, group, own, new
        # words under repeated windows
        change = np.zeros(len(block.starts) + 1, np.int32)
        at = block.window[repeated]
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        kept, begin = kept_bytes(block.body, block.offsets, block.starts, block.ends, removed)
        view = memoryview(kept)
        texts = [view[a : b - (b > a and kept[b - 1] == 0x20)] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        so_far = np.concatenate([[0], np.cumsum(removed)])  # words
        columns = [ids, pa.array(np.diff(block.first)), pa.array(so_far[block.first[1:]] - so_far[block.first[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        if with_text:
            spans = []
            for lo, hi in zip(block.first[:-1], block.first[1:]):
                own = np.diff(np.concatenate([[False], removed[lo:hi], [False]]).astype(np.int8))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
            columns += [pa.array([bytes(t).decode() for t in texts], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.Table.from_arrays(columns, names=[f.name for f in fields])

    answers = answered(ask(blocks, first), buckets, earlier, [np.uint64, np.uint32])
    return ask_again(blocks, answers, last, T.StructType(fields))


def kept_bytes(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words, each followed by one space if a byte follows it, and where each document begins, and the end."""
    change = np.zeros(len(body) + 2, np.int8)
    kept = ~removed
    np.add.at(change, starts[kept], 1)
    np.add.at(change, np.minimum(ends[kept] + 1, len(body) + 1), -1)
    # a word that ends with its document has no byte after it
    last = np.isin(ends, offsets) & kept
    change[ends[last]] -= 1
    np.add.at(change, np.minimum(ends[last] + 1, len(body) + 1), 1)
    mask = np.cumsum(change[: len(body)], dtype=np.int8) > 0
    out = np.where(SEPARATORS[body], np.uint8(0x20), body)[mask]
    return out, np.concatenate([[0], np.cumsum(mask)])[offsets]
