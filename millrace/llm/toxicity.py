"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded texts.

Folding makes letters lower-case, takes off accents, replaces homoglyphs and digits that stand for letters, and drops
invisible characters, so that disguised spellings meet the lexicon. The lexicon is learned from labelled rows: words and
beginnings of words that are far more frequent, by documents, among toxic ones; a term's weight is its log-odds. A text
is matched once by an automaton over `` term `` and `` beginning``; at each word the longest term counts. Exception
phrases, a term with the word before or after it as clean documents have it, don't count; they are learned from the same
rows and may be given too. The sum of weights is divided by (1 + words / SHORT) ** GROWTH, and a
logistic curve makes a probability of it; it is fitted on sums by lexicons that were learned from the other half of the
rows. Near copies among the rows to learn from count once, lest all words of a much copied toxic text become terms.

Defined cases: null and empty texts have the score of a text without a match; rows whose label is null are not learned
from, nor those held out; of rows labelled twice each label counts; without toxic or without clean rows to learn from no
term is known, and every score is the share of toxic rows (0 without labels); an empty table gives an empty result;
repeated rows give a row each; whole texts are folded and matched, in pieces that end between words.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mix, saved, worker_cache
from .language import is_held_out

#: Labelled rows to learn from, about, of each label: they are chosen by a hash of the text.
TRAINING_ROWS = 20_000
#: Entries of the lexicon, and exception phrases, at most: those with the most weight in all documents.
MOST_TERMS = 20_000
#: Beginnings of words with so many letters are terms.
BEGINNINGS = range(4, 8)
#: A term is in so many toxic documents, and in so great a share of them, at least; and has so much weight.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_WEIGHT = 3, 0.005, 2.0
#: An exception phrase is in so many clean documents at least, and less toxic than this weight.
LEAST_CLEAN, MOST_EXCEPTION_WEIGHT = 3, 0.0
#: Hash functions by which near copies are found; of rows that agree in one of them one is learned from.
SKETCHES = 4
#: Texts of more words than SHORT are judged rather by the density of matches (GROWTH 1), shorter ones by their sum (0).
SHORT, GROWTH = 100, 0.5
#: Code points folded at once.
PIECE = 1 << 20

# Letters of other scripts, digits and signs, and the Latin letters that they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ʀ": "r", "ꜱ": "s", "ᴏ": "o", "ᴄ": "c", "ᴇ": "e", "ᴀ": "a",
}
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "l", "|": "l", "€": "e"}
#: Letters that one digit stands for are one.
MERGED = {"i": "l", "q": "g"}

_GONE, _SPACE = 1, 32
#: Signs that are letters between letters only: ! and |, and their wide forms.
_BARS = np.array([0x21, 0x7C, 0xFF01, 0xFF5C], np.uint32)


def _table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it folds to (a space if it is in no word, _GONE if it is dropped), and 1 for substitutes,
    which are letters only in a word with another, 2 for those that are letters only between letters."""
    cache = worker_cache("folding")
    if not cache:
        table, doubtful = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind in ("Mn", "Me", "Cf"):
                table[c] = _GONE
            elif kind[0] in "LN":
                base = unicodedata.normalize("NFKD", chr(c))[0].lower()
                base = HOMOGLYPHS.get(base[0], base[0])
                table[c] = ord(MERGED.get(base, base))
        for x, y in SUBSTITUTES.items():
            y = MERGED.get(y, y)
            for c in {ord(x), ord(unicodedata.normalize("NFKC", chr(0xFF00 + ord(x) - 0x20))) if ord(x) < 0x7F else ord(x)}:
                table[c], doubtful[c] = ord(y), True
        for c in range(0x110000):
            if table[c] == _SPACE or doubtful[c]:
                continue
            x = unicodedata.normalize("NFKD", chr(c))[0]
            if x in SUBSTITUTES:
                y = SUBSTITUTES[x]
                table[c], doubtful[c] = ord(MERGED.get(y, y)), True
            elif x.isdigit():
                doubtful[c] = True
        marks = doubtful.astype(np.uint8)
        marks[_BARS] = 2
        cache[0] = table, marks
    return cache[0]


def folded(text: str | None) -> Iterator[str]:
    """The folded words of a text with one space between, before and after, in pieces that end between words. Words
    without a letter stay as they are but for their substitutes, which they keep as one sign each."""
    text = text or ""
    table, marks = _table()
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        codes = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
        lo = hi
        out = table[codes]
        kept = out != _GONE
        if not kept.all():
            out, codes = out[kept], codes[kept]
        inside = out != _SPACE
        bars = marks[codes] == 2
        if bars.any():  # not before or after a word
            edges = np.flatnonzero(np.diff(bars.astype(np.int8), prepend=0, append=0))
            starts, ends = edges[::2], edges[1::2]
            between = (starts > 0) & (ends < len(out)) & inside[starts - 1] & inside[np.minimum(ends, len(out) - 1)]
            out[bars] = np.where(np.repeat(between, ends - starts), out[bars], np.uint32(_SPACE))
            inside = out != _SPACE
        sure = inside & (marks[codes] == 0)
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        before = np.concatenate([[0], np.cumsum(sure)])
        bare = before[ends] == before[starts]
        if bare.any():  # numbers and signs are no words
            off = np.zeros(len(out) + 1, np.int32)
            np.add.at(off, starts[bare], 1)
            np.add.at(off, ends[bare], -1)
            out = np.where(np.cumsum(off[:-1]) > 0, np.uint32(_SPACE), out)
        words = out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split()
        if words:
            yield f" {'  '.join(words)} "


def folded_word(word: str) -> str:
    return " ".join(w for piece in folded(word) for w in piece.split())


@dataclass
class Lexicon:
    """Folded terms with weights (` word ` or ` beginning`), exception phrases (`one two`), and the curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    base: float = -math.inf

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        if self.terms:
            found.make_automaton()
        return found

    def matches(self, automaton, piece: str) -> Iterator[tuple[float, str, str]]:
        """Weight, and the phrases with the words before and after, of each match in a folded piece."""
        for end, (size, weight) in automaton.iter_long(piece):
            start = end - size + 1
            close = piece.find(" ", start + 1)
            word = piece[start + 1 : close]
            left = piece[piece.rfind(" ", 0, start - 1) + 1 : start - 1] if start > 1 else ""
            after = close + 2
            right = piece[after : piece.find(" ", after)] if after < len(piece) else ""
            yield weight, f"{left} {word}", f"{word} {right}"

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sum of the weights of its matches, divided by (1 + words / SHORT) ** GROWTH."""
        out = np.zeros(len(texts))
        if not self.terms:
            return out
        automaton = self.automaton()
        for k, text in enumerate(texts):
            words, total = 0, 0.0
            for piece in folded(text):
                words += piece.count("  ") + 1
                for weight, before, after in self.matches(automaton, piece):
                    if before not in self.exceptions and after not in self.exceptions:
                        total += weight
            out[k] = total / (1 + words / SHORT) ** GROWTH
        return out

    def probability(self, sums: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.base + self.slope * sums)))


def _sketches(batches):
    """Each row with the least hashes of its runs of three folded words, by SKETCHES functions, and half of a text."""
    for batch in batches:
        toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = np.zeros((len(texts), SKETCHES), np.int64)
        for k, text in enumerate(texts):
            words = [w for piece in folded(text) for w in piece.split()]
            runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            hashes = np.fromiter((int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in runs), np.uint64, len(runs))
            for j in range(SKETCHES):
                found[k, j] = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))).min().astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, j]) for j in range(SKETCHES))], names=["toxic", "text", *(f"s{j}" for j in range(SKETCHES))])


def _words(batches):
    """The distinct terms of each text: ` word ` and ` beginning`, of words with a beginning's letters at least."""
    for batch in batches:
        toxic, half, texts = (batch.column(k).to_pylist() for k in range(3))
        for y, h, text in zip(toxic, half, texts):
            words = {w for piece in folded(text) for w in piece.split()}
            terms = {f" {w} " for w in words if len(w) >= BEGINNINGS.start} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.string()), pa.array([y] * len(terms), pa.int32()), pa.array([h] * len(terms), pa.int32())], names=["term", "toxic", "half"])


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log(((toxic + 0.5) / (n_toxic + 1.0)) / ((clean + 0.5) / (n_clean + 1.0)))


def _fitted(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """slope and base of a logistic curve, with a weak pull to 0 on the slope; Newton's steps."""
    slope = base = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -500, 500)))
        g = np.array([(weights * (y - p) * x).sum() - 0.01 * slope, (weights * (y - p)).sum() - 0.01 * base])
        v = weights * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, base = slope + float(np.clip(step[0], -1, 1)), base + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, slope), base


def train(docs: DataFrame, labels: DataFrame, rows_each: int = TRAINING_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns from docs (doc_id, text) that labels (doc_id, toxic) mark 0 or 1 and that are not held out."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~is_held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two at most
    n_all = sum(sizes.values())
    given = frozenset(folded_word(x) for x in exceptions)
    if len(sizes) < 2:
        share = min(max(sizes.get(1, 0) / n_all if n_all else 0.0, 1e-9), 1 - 1e-9)
        return Lexicon({}, given, 0.0, math.log(share / (1 - share)) if n_all else -math.inf)
    chance = {y: min(1.0, rows_each / sizes[y]) for y in (0, 1)}
    spread = F.pmod(F.xxhash64("doc_id", "toxic"), F.lit(1 << 20))
    chosen = marked.filter(spread < F.when(F.col("toxic") == 1, chance[1]).otherwise(chance[0]) * (1 << 20))
    # a bounded sample: about 2 * rows_each ids, so its side is broadcast
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    drawn = saved(texts.mapInArrow(_sketches, f"toxic int, text string, {', '.join(f's{j} bigint' for j in range(SKETCHES))}").withColumn("key", F.xxhash64("text")))
    kept = drawn.drop("text")
    for j in range(SKETCHES):
        kept = kept.groupBy("toxic", f"s{j}").agg(*(F.min_by(c, "key").alias(c) for c in kept.columns if c not in ("toxic", f"s{j}")))
    rows = drawn.join(kept.select("toxic", "key"), ["toxic", "key"], "left_semi").dropDuplicates(["toxic", "key"])
    rows = saved(rows.select("toxic", F.pmod("key", F.lit(2)).cast("int").alias("half"), "text"))
    n = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}  # four at most
    here = lambda y, h: F.count_if((F.col("toxic") == y) & (F.col("half") == h))
    counts = saved(rows.mapInArrow(_words, "term string, toxic int, half int").groupBy("term").agg(here(1, 0).alias("a0"), here(1, 1).alias("a1"), here(0, 0).alias("b0"), here(0, 1).alias("b1")))

    def learned(halves: tuple[int, ...]) -> Lexicon:
        """The lexicon and the exceptions of these halves of the rows."""
        a, b = (reduce(lambda x, y: x + y, (F.col(f"{c}{h}") for h in halves)) for c in "ab")
        n1, n0 = (sum(n.get((y, h), 0) for h in halves) for y in (1, 0))
        known = counts.select("term", a.alias("a"), _odds(a, b, n1, n0).alias("weight")).filter((F.col("a") >= max(LEAST_DOCUMENTS, LEAST_SHARE * n1)) & (F.col("weight") >= LEAST_WEIGHT))
        best = known.orderBy(F.desc(F.col("weight") * F.col("a")), "term").limit(MOST_TERMS).select("term", "weight").collect()  # MOST_TERMS at most
        model = Lexicon({r["term"]: r["weight"] for r in best}, given)
        if not best:
            return model

        def phrases(batches):
            automaton = model.automaton()
            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = {x for piece in folded(text) for _, *both in model.matches(automaton, piece) for x in both}
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string()), pa.array([y] * len(own), pa.int32())], names=["phrase", "toxic"])

        around = rows.filter(F.col("half").isin(*halves)).select("toxic", "text").mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        clean = around.filter((F.col("b") >= LEAST_CLEAN) & (_odds(F.col("a"), F.col("b"), n1, n0) < MOST_EXCEPTION_WEIGHT)).orderBy(F.desc("b"), "phrase").limit(MOST_TERMS).select("phrase").collect()  # as many at most
        model.exceptions = given | {r["phrase"] for r in clean}
        return model

    xs, ys = [], []
    for h in (0, 1):
        other = learned((1 - h,))

        def scored(batches, other=other):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(other.sums(batch.column(1).to_pylist()))], names=["toxic", "x"])

        table = rows.filter(F.col("half") == h).select("toxic", "text").mapInArrow(scored, "toxic int, x double").toArrow()  # two numbers for each row of the bounded sample
        ys.append(table.column(0).to_numpy().astype(float))
        xs.append(table.column(1).to_numpy())
    y, x = np.concatenate(ys), np.concatenate(xs)
    model = learned((0, 1))
    weights = np.where(y == 1, sizes[1] / n_all / max(1, (y == 1).sum()), sizes[0] / n_all / max(1, (y == 0).sum())) * len(y)
    model.slope, model.base = _fitted(x, y, weights)
    return model


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with toxicity, the probability, and toxic, 1 where that reaches the threshold; only the text is read for them.
    Columns of docs with these names are replaced."""
    docs = docs.drop("toxicity", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions, lexicon.slope, lexicon.base))
    rows = docs.select(*(docs[c] for c in docs.columns), docs[text].alias(free_name(docs.columns)))
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.IntegerType())])

    def run(batches):
        own = Lexicon(*shared.value)
        for batch in batches:
            found = own.probability(own.sums(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
