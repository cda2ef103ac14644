"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of 1 to 3 letters for each language over a bounded sample of the labelled rows; the
log-probability matrix (languages x buckets) is broadcast, and batches of texts are scored in numpy: each text is the
sparse vector of its n-grams' buckets, and its log-likelihoods are sums of matrix entries over whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0; rows without a language are not learned
from; equal scores go to the language first in order of name; repeated rows give one result row each; with nothing to
learn from every text is `und`; an empty table gives an empty result. Long texts are scored in pieces, as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, worker_cache

UNKNOWN = "und"
#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows of each language to learn from, about: rows are chosen by a hash of their id.
TRAINING_ROWS = 10_000
#: Letters scored at once.
PIECE = 1 << 19
SMOOTHING = 0.5


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, 0 for the others."""
    cache = worker_cache("letters")
    if not cache:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        cache[0] = table
    return cache[0]


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0: none) of all texts, each followed by a 0, after a 0; and where each text begins, and the end."""
    joined = "\0".join(["", *(x or "" for x in texts), ""])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(x) + 1 if x else 1 for x in texts), np.int64, len(texts))
    return codes, np.concatenate([[1], 1 + np.cumsum(lengths)])


def buckets(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams around the letters at `at`: the letter, it with the next, and with both neighbours."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    a, b, c = (codes[at + d].astype(np.uint64) for d in (-1, 0, 1))
    one = b * np.uint64(0x9E3779B97F4A7C15)
    two = one + (c + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + (a + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    two *= np.uint64(0xD6E8FEB86659FD93)
    three *= np.uint64(0xA0761D6478BD642F)
    return [(x >> shift).astype(np.intp) for x in (one, two ^ two >> np.uint64(29), three ^ three >> np.uint64(31))]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # languages x buckets, log-probabilities

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, begin = encoded(texts)
        sums = np.zeros((len(self.languages), len(texts)))
        known = np.zeros(len(texts), bool)
        for lo in range(1, len(codes) - 1, PIECE):
            at = lo + np.flatnonzero(codes[lo : min(lo + PIECE, len(codes) - 1)])
            if not len(at):
                continue
            text = np.searchsorted(begin, at, "right") - 1
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            own = text[starts]
            known[own] = True
            found = buckets(codes, at)
            for k, w in enumerate(self.weights):
                sums[k, own] += np.add.reduceat(sum(w[x] for x in found), starts, dtype=np.float64)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums += self.prior[:, None]
        best = sums.argmax(axis=0)
        share = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, share, 0.0)


def train(docs: DataFrame, label: str = "lang", rows_each: int = TRAINING_ROWS) -> Model:
    """Learns from the rows of docs (doc_id, text, label) that are labelled and not held out."""
    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    share = F.lit(0.0)
    for x in languages:
        share = F.when(F.col(label) == x, min(1.0, rows_each / sizes[x])).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    index = {x: k for k, x in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            codes, begin = encoded(batch.column(1).to_pylist())
            own = np.array([index[x] for x in batch.column(0).to_pylist()], np.intp)
            for lo in range(1, len(codes) - 1, PIECE):
                at = lo + np.flatnonzero(codes[lo : min(lo + PIECE, len(codes) - 1)])
                at_language = own[np.searchsorted(begin, at, "right") - 1] * BUCKETS
                for x in buckets(codes, at):
                    counts += np.bincount(at_language + x, minlength=counts.size).reshape(counts.shape)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(counts.ravel()[there])], names=["cell", "n"])

    cells = chosen.select(label, "text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one for each language and bucket at most
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(-1, BUCKETS) + SMOOTHING
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language; only the text is read for it. Columns of docs
    with these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    # plain arrays: a broadcast is pickled by reference to classes, which executors may lack
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.weights))
    rows = docs.select(*(docs[c] for c in docs.columns), docs[text].alias(free_name(docs.columns)))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        model = Model(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                languages, scores = model.score(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(predict, schema)
