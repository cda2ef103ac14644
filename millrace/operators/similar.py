"""Search of a table of texts for those that are nearly the same as given ones, by the ratio of their matching blocks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, saved
from ..functions.providers import ratio_from
from .vector import read_blocks

#: Bins that pieces of 1, 2 and 3 characters are counted in. Fewer bins only let more pairs through to the next step.
BINS = (256, 1024, 4096)
#: Lengths of pieces that are counted as they are, for pairs that the bins let through.
LONGER = (4, 8)
#: Length of the pieces that queries are cut into, by which a block of queries is looked up, and bits, at most, of the table
#: that says which pieces a block may have.
PIECE, FLAG_BITS = 8, 23
#: How much longer than the shortest one a block's queries may be; queries, and characters of them, in a block; characters of texts that a task holds while it reads the blocks.
BAND, BLOCK_ROWS, BLOCK_CHARS, HELD_CHARS = 1.2, 4096, 4_000_000, 16_000_000
#: A piece at no more places of a block than this is never left open.
FREQUENT = 8
#: Pairs of places that a comparison holds; beyond them the matcher's own search goes without.
MOST_SPOTS = 4_000_000


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def pieces(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each piece of q characters."""
    n = max(len(codes) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = out * np.uint64(1_000_003) + codes[k : k + n]
    return out * np.uint64(0x9E3779B97F4A7C15)


def _groups(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number of a sorted array begins, and how often it is there; much faster than the hashing of np.unique."""
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    return first, np.diff(np.append(first, len(found)))


def distinct(found: np.ndarray) -> np.ndarray:
    """Each number once, in order."""
    found = np.sort(found)
    return found[_groups(found)[0]]


def counted(text: str) -> list[np.ndarray]:
    """How often the pieces of each length fall into each bin."""
    codes = codes_of(text)
    return [_binned(codes, q, bins) for q, bins in enumerate(BINS, 1)]


def _binned(codes: np.ndarray, q: int, bins: int) -> np.ndarray:
    return np.bincount((pieces(codes, q) >> np.uint64(40)).astype(np.int64) % bins, minlength=bins).astype(np.int32)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def longer(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pieces of each of the longer lengths, in order, and how often each is there."""
    codes, out = codes_of(text), []
    for q in LONGER:
        found = np.sort(pieces(codes, q))
        first, many = _groups(found)
        out.append((found[first], many))
    return out


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many pieces two texts have in common, each as often as both have it."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())


def most_blocks(text: str) -> float:
    """How many blocks a text can match in as the second one of a comparison. From 200 characters on a block begins at a
    character that makes up at most a hundredth of that text, or at the start of both; in a shorter one anywhere."""
    if len(text) < 200:
        return np.inf
    _, counts = np.unique(codes_of(text), return_counts=True)
    return 1 + int(counts[counts <= len(text) // 100 + 1].sum())


def least_shared(length: np.ndarray, blocks: float, q: int, threshold: float) -> np.ndarray:
    """How many pieces of q characters two texts of `length` characters in all share at least, if their ratio reaches the
    threshold: of m matching characters in k blocks, m - k (q - 1) pieces lie within blocks, and between two blocks there is
    a character without a match, so k is at most 1 + length - 2 m, and at most `blocks`. That m is least at the threshold."""
    m = np.ceil(threshold * length / 2 - 1e-9)
    return m - (q - 1) * np.minimum(1 + length - 2 * m, blocks)


def candidates(own: list[np.ndarray], size: int, blocks: float, sizes: np.ndarray, counts: list[np.ndarray], threshold: float) -> np.ndarray:
    """Positions of the block's queries that can reach the threshold with a text of these counts; none that does is lost."""
    both = sizes + size
    at = np.flatnonzero(2 * np.minimum(sizes, size) >= threshold * both)
    for q, (mine, theirs) in enumerate(zip(own, counts), 1):
        if len(at):
            at = at[np.minimum(theirs[at], mine).sum(1) >= least_shared(both[at], blocks, q, threshold)]
    return at


def most_touched(size: int, blocks: float, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many pieces of PIECE characters of a query, cut one after another, don't lie within a block at most, if its ratio to
    a text of `size` characters reaches the threshold. Between two blocks one piece is touched; two more characters there
    without a match touch a second one, and each PIECE characters after that another. Before the first block and after
    the last one there are four more at most."""
    both = sizes + size
    m = np.ceil(threshold * both / 2 - 1e-9)
    between = np.minimum(1 + both - 2 * m, blocks) - 1
    missed = sizes - m
    return between + 4 + np.minimum(between, missed // 2) + np.maximum(missed - 2 * between, 0) // PIECE


class Spelled:
    """A text's places by character, and the characters that a block of matches can be found by if the text is the second one
    of a comparison: from 200 characters on only those that make up at most a hundredth of it."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text, self.places = text, np.argsort(codes, kind="stable")
        self.chars, self.starts, self.counts = np.unique(codes[self.places], return_index=True, return_counts=True)
        self.rare = self.counts <= (len(text) // 100 + 1 if len(text) >= 200 else len(text))


def _runs(a: Spelled, b: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Where in a and b runs of equal characters that are rare in b begin, and their lengths, as long as they go on; None if
    more than MOST_SPOTS pairs of places would have to be held."""
    _, x, y = np.intersect1d(a.chars, b.chars[b.rare], assume_unique=True, return_indices=True)
    y = np.flatnonzero(b.rare)[y]
    if int((a.counts[x] * b.counts[y]).sum()) > MOST_SPOTS:
        return None
    i = a.places[_spread(a.starts[x], a.counts[x])]
    from_, many = np.repeat(b.starts[y], a.counts[x]), np.repeat(b.counts[y], a.counts[x])
    i, j, wide = np.repeat(i, many), b.places[_spread(from_, many)], len(a.text) + 1
    spots = np.sort((j - i + wide) * wide + i)  # along one diagonal after another
    first = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
    i = spots[first] % wide
    return tuple(x.astype(np.int32) for x in (i, spots[first] // wide - wide + i, np.diff(np.append(first, len(spots)))))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _alike(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters from i in a and from j in b on are equal, up to `most`."""
    n = 0
    while n < most:
        k = min(64, most - n)
        if a[i + n : i + n + k] != b[j + n : j + n + k]:
            while a[i + n] == b[j + n]:
                n += 1
            return n
        n += k
    return n


def ratio_of(a: Spelled, b: Spelled, threshold: float) -> float | None:
    """SequenceMatcher(None, a, b).ratio() if it is `threshold` or more, else None. The runs that a block can be found by are
    looked up once for both texts; a part takes the longest of its own, the first one in a, then in b. A part without any
    has no match, but for what the texts begin with: a block ends where the texts differ."""
    runs = _runs(a, b)
    if runs is None:
        return ratio_from(SequenceMatcher(None, a.text, b.text), threshold)
    x, y = a.text, b.text
    back_x, back_y = x[::-1], y[::-1]
    size, found, may = len(x) + len(y), 0, min(len(x), len(y))
    left = [(0, len(x), 0, len(y), *runs)]
    while left:
        if 2.0 * (found + may) < threshold * size * (1 - 1e-12):
            return None
        lo, hi, low, high, i, j, n = left.pop()
        may -= min(hi - lo, high - low)
        skip = np.maximum(np.maximum(lo - i, low - j), 0)
        n = np.minimum(np.minimum(n - skip, hi - i - skip), high - j - skip)
        within = n > 0
        i, j, n = (i + skip)[within], (j + skip)[within], n[within]
        p, q, k = lo, low, 0
        if len(n):
            k = int(n.max())
            best = np.flatnonzero(n == k)
            best = best[np.argmin(i[best].astype(np.int64) * (len(y) + 1) + j[best])]
            p, q = int(i[best]), int(j[best])
            more = _alike(back_x, back_y, len(x) - p, len(y) - q, min(p - lo, q - low))
            p, q, k = p - more, q - more, k + more
        k += _alike(x, y, p + k, q + k, min(hi - p - k, high - q - k))
        found += k
        if not k:
            continue
        if lo < p and low < q:
            own = np.flatnonzero((i < p) & (j < q))
            if len(own) or lo == low == 0:
                left.append((lo, p, low, q, i[own], j[own], n[own]))
                may += min(p - lo, q - low)
        if p + k < hi and q + k < high:
            own = np.flatnonzero((i + n > p + k) & (j + n > q + k))
            if len(own):
                left.append((p + k, hi, q + k, high, i[own], j[own], n[own]))
                may += min(hi - p - k, high - q - k)
    ratio = 2.0 * found / size if size else 1.0
    return ratio if ratio >= threshold else None


def slots(found: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Places of pieces in a table of 2 ** k flags."""
    return (found >> np.uint64(65 - len(flags).bit_length())).view(np.int64)


class Block:
    """Queries in order of length, the counts of their pieces of 1 and 2 characters, and for each piece that they are cut into
    the queries that have it, as often as they do. Of a query's places, the tenth with the pieces that most of the block has
    is left open: a text is taken to have them."""

    def __init__(self, rows: list[tuple[str, str]]):
        rows = sorted(rows, key=lambda r: len(r[1]))
        self.names, self.bodies = [d for d, _ in rows], [t for _, t in rows]
        self.sizes = np.array([len(t) for t in self.bodies])
        self.counts, self.twos = (_small(np.stack([_binned(codes_of(t), q, BINS[q - 1]) for t in self.bodies])) for q in (1, 2))
        cut = [pieces(codes_of(t), PIECE)[::PIECE] for t in self.bodies]
        self.cuts = np.array([len(c) for c in cut])
        every, owners = np.concatenate(cut), np.repeat(np.arange(len(rows)), self.cuts)
        order = np.argsort(every, kind="stable")
        _, many = _groups(every[order])
        places = np.empty(len(every), np.int64)
        places[order] = np.repeat(many, many)
        often = np.argsort(owners * (len(every) + 1) - places, kind="stable")
        rank = np.arange(len(every)) - np.repeat(np.cumsum(self.cuts) - self.cuts, self.cuts)
        kept = np.ones(len(every), bool)
        kept[often[(places[often] > FREQUENT) & (rank < np.repeat(self.cuts // 10, self.cuts))]] = False
        self.open = np.bincount(owners[~kept], minlength=len(rows))
        order = order[kept[order]]
        self.owners, (self.starts, many) = owners[order].astype(np.int32), _groups(every[order])
        self.keys, self.ends = every[order][self.starts], self.starts + many

    def flags(self) -> np.ndarray:
        out = np.zeros(1 << min(max(len(self.keys) * 16, 1 << 16).bit_length(), FLAG_BITS), bool)
        out[slots(self.keys, out)] = True
        return out

    def candidates(self, found: np.ndarray, flags: np.ndarray, size: int, blocks: float, counts: Callable[[], np.ndarray], threshold: float) -> np.ndarray:
        """Positions of queries that can reach the threshold with a text of `size` characters and these pieces."""
        at = self.looked_up(distinct(found), flags, size, blocks, threshold)
        return like(self.sizes, self.counts, at, counts(), size, blocks, 1, threshold) if len(at) else at

    def looked_up(self, found: np.ndarray, flags: np.ndarray, size: int, blocks: float, threshold: float) -> np.ndarray:
        """Positions of queries of which enough pieces are among a text's, each of which is given once and in order."""
        lo = int(np.searchsorted(self.sizes, threshold / (2 - threshold) * size * (1 - 1e-9), "left"))
        hi = int(np.searchsorted(self.sizes, (2 - threshold) / threshold * size * (1 + 1e-9), "right"))
        if lo >= hi:
            return np.zeros(0, np.int64)
        need = self.cuts[lo:hi] - self.open[lo:hi] - most_touched(size, blocks, self.sizes[lo:hi], threshold)
        own = found[flags[slots(found, flags)]]
        if not len(own) or not len(self.keys):
            return lo + np.flatnonzero(need <= 0)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        spots = _spread(self.starts[at], self.ends[at] - self.starts[at])
        n = np.bincount(self.owners[spots], minlength=len(self.sizes))
        return lo + np.flatnonzero(n[lo:hi] >= need)


def like(sizes: np.ndarray, counts: np.ndarray, at: np.ndarray, own: np.ndarray, size: int, blocks: float, q: int, threshold: float) -> np.ndarray:
    """Those of the positions whose lengths and counts of pieces of q characters let them reach the threshold."""
    both = sizes[at] + size
    at, both = at[2 * np.minimum(sizes[at], size) >= threshold * both], both[2 * np.minimum(sizes[at], size) >= threshold * both]
    return at[np.minimum(counts[at], own).sum(1) >= least_shared(both, blocks, q, threshold)] if len(at) else at


def near_texts(queries: DataFrame, texts: DataFrame, threshold: float = 0.90) -> DataFrame:
    """query_id, key and ratio of all texts (key, text) whose ratio to a query's text (query_id, text) is `threshold` or more.

    Nothing that reaches the threshold is lost: pairs are left out by their lengths and by the pieces that they would have
    to share, and the others are compared. Equal texts are compared once and then joined to all that have them. Queries are
    blocks by length in the shared folder, which each task reads one after another; texts stay where they are. A text looks
    up its pieces among those that a block's queries of like length are cut into, so that only queries that share pieces,
    or that are too short for the bound to say anything, are looked at. Null and blank texts are near to nothing; rows with
    null or repeated ids are rows like others. Time grows with the texts' characters, with the pieces that queries and texts
    share, and with the candidates for the comparison, whose time can grow with the square of a text's length.
    """
    spark = texts.sparkSession
    folder = fresh_path(spark, "asked-texts")
    digest = F.sha2("text", 256).alias("digest")
    # both are read twice below: the texts' expressions are worked out once, and not again by the filter
    asked = saved(queries.select("query_id", "text", digest), "asked").filter(F.col("text").rlike(r"\S"))
    held = saved(texts.select("key", "text", digest), "texts").filter(F.col("text").rlike(r"\S"))

    def blocks(batches):
        def packed(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(rows).__dict__)], pa.binary())], names=["block"])

        rows, chars = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (len(rows) >= BLOCK_ROWS or chars + len(row[1]) > BLOCK_CHARS or len(row[1]) > BAND * len(rows[0][1])):
                    yield packed(rows)
                    rows, chars = [], 0
                rows.append(row)
                chars += len(row[1])
        if rows:
            yield packed(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.char_length("text")
    asked.dropDuplicates(["digest"]).select("digest", "text").repartitionByRange(max(1, parts // 8), length).sortWithinPartitions(length).mapInArrow(blocks, "block binary").write.parquet(folder)

    def compare(some: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        some.sort(key=lambda x: len(x[1]))
        found, blocks = [distinct(pieces(codes_of(t), PIECE)) for _, t in some], [most_blocks(t) for _, t in some]
        lengths = np.array([len(t) for _, t in some])
        mine: dict[int, list] = {}
        for stored in read_blocks(folder):
            block = Block.__new__(Block)
            block.__dict__ = stored
            fits = np.flatnonzero((threshold * block.sizes[0] <= (2 - threshold) * lengths + 1) & (threshold * lengths <= (2 - threshold) * block.sizes[-1] + 1)).tolist()
            if not fits:
                continue
            flags = block.flags()
            out: list[tuple[str, str, float]] = []
            known: dict[int, list] = {}
            for i in fits:
                (name, body), most = some[i], blocks[i]
                at = block.looked_up(found[i], flags, len(body), most, threshold)
                if not len(at):
                    continue
                own = mine.setdefault(i, [_small(c) for c in counted(body)] + [None, None])
                for q, counts in ((1, block.counts), (2, block.twos)):
                    at = like(block.sizes, counts, at, own[q - 1], len(body), most, q, threshold)
                for j in at.tolist():
                    other = block.bodies[j]
                    if other == body:
                        out.append((block.names[j], name, 1.0))
                        continue
                    if j not in known:
                        known[j] = [_binned(codes_of(other), 3, BINS[2]), None, None]
                    both = len(body) + len(other)
                    if np.minimum(own[2], known[j][0]).sum() < least_shared(both, most, 3, threshold):
                        continue
                    for each, t in ((own, body), (known[j], other)):
                        each[-2] = each[-2] or longer(t)
                    if any(shared(x, y) < least_shared(both, most, q, threshold) for q, x, y in zip(LONGER, own[-2], known[j][-2])):
                        continue
                    for each, t in ((own, body), (known[j], other)):
                        each[-1] = each[-1] or Spelled(t)
                    if (ratio := ratio_of(known[j][-1], own[-1], threshold)) is not None:
                        out.append((block.names[j], name, ratio))
                own[-2:] = None, None
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["asked", "digest", "ratio"])

    def scan(batches):
        some, chars = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                some.append(row)
                chars += len(row[1]) + sum(BINS)
                if chars >= HELD_CHARS:
                    yield from compare(some)
                    some, chars = [], 0
        if some:
            yield from compare(some)

    # a fixed number of parts: the work of a part is far more than its bytes say
    pairs = held.repartition(parts, "digest").dropDuplicates(["digest"]).select("digest", "text").mapInArrow(scan, "asked string, digest string, ratio double")
    found = pairs.join(asked.select("query_id", F.col("digest").alias("asked")), "asked")
    return found.join(held.select("key", "digest"), "digest").select("query_id", "key", "ratio")
