"""Removal of repeated byte strings by distributed prefix doubling.

Positions are ranked by growing prefixes of what follows them. A rank is given by the task that sorts a range of all
blocks' rank pairs: equal pairs get equal ranks, and a pair that is there once gets none, so that its position is out.
The ranks of one round are the pairs of the next: the rank of a position, and that of the position at which its prefix
ends. Three measures keep what is shuffled within a few bytes for each byte of text:

* Of the next `reach` positions one is the anchor, that with the least gram (leftmost, by a hash). All positions with
  the same anchor form a group, and equal strings have their anchors at equal distance, so only anchors are ranked.
  Offsets grow by steps from anchor to anchor: the next anchor of x is that of position x + 1, which only depends on
  what follows x. The first ranks are those of START steps, as one fingerprint; a round doubles them to at most twice as
  many, as far as the bytes that all of a group's strings share decide where the steps lead; the last one pairs ranks
  whose prefixes overlap, up to MOST steps.
* The last round also sends the fingerprint of the whole range that a group's strings cover. If that is repeated, so is
  every string of the group.
* What is left are single positions at the edges of repeats. They, and the positions of groups that share an anchor's
  rank with them, are ranked one by one for the full length, at the threshold.

What is removed rests on fingerprints of 128 bits, of ranges or of single strings; ranks only drop what is unique.

Defined cases: null and empty texts have 0 bytes; shorter texts than the length lose nothing; rows of equal id are
separate texts; all copies of a repeat are removed, the first one too; other columns are not read; an empty table gives
an empty result. Every position takes part, however frequent its string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, text_bytes
from .exchange import BLOCK_BYTES, SLICE, Rolling, answered, ask, ask_again, block_count, bucket_count, by_rank, byte_values, dealt, ordered, planes, questions, replied_ranks, replies, unplanes

GRAM = 8
#: Steps of the first ranks, and of the last ones at most.
START, MOST = 8, 32
#: Codes of a group after the last round on anchors: unique; repeated, but its range is not; its range is repeated; the
#: same, and another group of its class needs its positions.
UNIQUE, EDGE, WHOLE, WITNESS = 0, 1, 2, 3


def anchors(body: np.ndarray, reach: int) -> np.ndarray:
    """For each position, that of the least gram among the next `reach`, the leftmost of equals; body has
    reach + GRAM - 2 bytes more than positions."""
    grams = np.ndarray((len(body) - GRAM + 1,), "<u8", np.ascontiguousarray(body).data, strides=(1,))
    key = mix(grams * np.uint64(0x9E3779B97F4A7C15)) << np.uint64(8)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        key = np.minimum(key[:-step], key[step:] + np.uint64(step))
        span += step
    return np.arange(len(key)) + (key & np.uint64(255)).astype(np.int64)


class Block:
    """A block's documents, groups of positions and nodes: the anchors from which START steps stay in their document."""

    def __init__(self, table: pa.Table, length: int):
        self.table = ordered(table)
        self.body, self.offsets = text_bytes(self.table.column("text"))
        self.length = length
        self.reach = min(32, max(1, (length - GRAM) // 12))
        #: bytes from an anchor on that the strings of all its group's positions share
        self.shared = length - self.reach + 1
        where = np.empty(len(self.body), np.int32)
        for lo, hi in self._slices():
            where[lo:hi] = self._anchors(lo, hi) + lo
        new = np.ones(len(where), bool)
        np.not_equal(where[1:], where[:-1], out=new[1:])
        self._link(where, where[new])  # anchors never go back
        self.low, self.high, self.anchor = self._groups(where, new)

    def _slices(self):
        return [(lo, min(lo + SLICE, len(self.body))) for lo in range(0, len(self.body), SLICE)]

    def _anchors(self, lo: int, hi: int) -> np.ndarray:
        more = self.body[lo : hi + self.reach + GRAM]
        short = hi - lo + self.reach + GRAM - 2 - len(more)
        if short > 0:
            more = np.concatenate([more, np.zeros(short, np.uint8)])
        return anchors(more, self.reach)[: hi - lo]

    def _groups(self, where: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last position and anchor of each run of positions that have `length` bytes in their document; new
        says where another anchor begins."""
        a, b = self.offsets[:-1], self.offsets[1:] - self.length + 1
        a, b = a[b > a], b[b > a]
        new[a] = True
        at = np.flatnonzero(new)
        doc = np.searchsorted(a, at, "right") - 1
        high = np.append(at[1:], len(where)) - 1
        use = (doc >= 0) & (at < (b[doc] if len(b) else 0))
        at, high, doc = at[use], high[use], doc[use]
        return at, np.minimum(high, b[doc] - 1), where[at].astype(np.int64)

    def _link(self, where: np.ndarray, nodes: np.ndarray) -> None:
        last = len(self.body) - 1
        nodes = nodes[nodes < last].astype(np.int64)
        if not len(nodes):
            self.nodes = self.places = self.end_of_start = np.zeros(0, np.int64)
            self.jumps, self.valid = [np.zeros(0, np.int64)] * 5, np.zeros(0, bool)
            return
        ends = self.offsets[1:][np.searchsorted(self.offsets[1:], nodes, "right")]
        # steps by 1, 2, 4, 8 and 16; what would leave the block stays at the end, which no document has room for
        far = len(nodes)
        next_ = np.append(np.searchsorted(nodes, where[nodes + 1]), far)
        places = np.append(nodes, 1 << 40)
        jumps = [next_]
        for _ in range(4):
            jumps.append(jumps[-1][jumps[-1]])
        self.jumps, self.places = jumps, places
        before_last = jumps[2][jumps[1][jumps[0]]][:far]  # START - 1 steps
        self.valid = places[before_last] + self.reach + GRAM <= ends
        self.nodes = nodes
        self.end_of_start = places[jumps[3][:far]]

    def steps(self, node: np.ndarray, limit: int = MOST) -> np.ndarray:
        """How many steps, START to `limit`, the shared bytes of the node decide."""
        bound = self.places[node] + self.shared - self.reach - GRAM
        at, count = self.jumps[2][self.jumps[1][self.jumps[0][node]]], np.full(len(node), START)
        for k in (4, 3, 2, 1, 0):
            to = self.jumps[k][at]
            go = (self.places[to] <= bound) & (count + (1 << k) <= limit)
            at, count = np.where(go, to, at), count + (go << k)
        return count

    def after(self, node: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The node that many steps on, fewer than 32."""
        for k in range(5):
            node = np.where(steps >> k & 1, self.jumps[k][node], node)
        return node

    def fingerprints(self, start: np.ndarray, end: np.ndarray, wide: bool = False) -> list[np.ndarray]:
        """Of the ranges, which are sorted by start; made slice by slice. One of 64 bits, or two if `wide`."""
        out = [np.empty(len(start), np.uint64) for _ in range(1 + wide)]
        for lo, hi in self._slices():
            i, j = np.searchsorted(start, (lo, hi))
            if j > i:
                values = byte_values(self.body[lo : int(end[i:j].max())])
                for k, x in enumerate(out):
                    x[i:j] = Rolling(mix(values + np.uint64(k)) if k else values)(start[i:j] - lo, end[i:j] - lo)
        return out

    def first_ranks(self) -> np.ndarray:
        """Fingerprints of START steps from each valid node."""
        return self.fingerprints(self.nodes[self.valid], self.end_of_start[self.valid])[0]


def classes(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of rows of keys: each row's class, the classes' keys in order, and whether a class has two rows or more."""
    by = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(by), bool)
    for k in keys:
        x = k[by]
        if k is keys[0]:
            same = x[1:] == x[:-1]
        else:
            same &= x[1:] == x[:-1]
    new[1:] = ~same
    first = np.flatnonzero(new)
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    sizes = np.diff(np.concatenate([first, [len(by)]]))
    return of, [k[by][first] for k in keys], (sizes > 1).astype(np.uint8)


def ranked(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """The rank of each key among those that are there twice, in a block or in two, in their order from 1; or 0. The last
    of columns says whether a block has the key twice."""
    *keys, many = columns
    of, _, again = classes(*keys)
    again[of[many > 0]] = 1
    return (np.cumsum(again, dtype=np.uint32) * again)[of]


def repeated(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """1 where a key is there twice: in a block, or in two."""
    return (ranked(order, *columns) > 0).astype(np.uint8)


def sorted_out(order: np.ndarray, rank: np.ndarray, further: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The groups' codes."""
    pair, _, again = classes(rank, further, low, high)
    whole = again[pair] | many
    of, _, shared = classes(rank, further)
    shared[of[many > 0]] = 1
    edge = np.zeros(len(shared), bool)
    edge[of[whole == 0]] = True
    edge = edge[of]
    return np.where(whole == 1, np.where(edge, WITNESS, WHOLE), np.where(shared[of] == 1, EDGE, UNIQUE)).astype(np.uint8)


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, with the kept bytes and the removed byte
    ranges (spans, end exclusive) if with_text."""
    if length < 2 * GRAM:
        raise ValueError(f"the length is {length}, at least {2 * GRAM} is asked for")
    docs = docs.select("doc_id", "text")
    n = block_count(docs, block_bytes)
    buckets = bucket_count(docs.sparkSession, n)
    blocks = dealt(docs, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int"), n)

    def asks(key, table, keys: list[np.ndarray], state: bytes | None = None, **how):
        _, own, many = classes(*keys)
        return questions(key[0].as_py(), table.column("at")[0].as_py(), buckets, *own, many, state=state, **how)

    def first(key, table):
        return asks(key, table, [Block(table, length).first_ranks()])

    def doubled(block: Block, rank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nodes whose pair may be repeated, and their rank pairs, of at most 2 * START steps."""
        node = np.flatnonzero(rank)
        other = rank[block.after(node, block.steps(node, 2 * START) - START)]
        node, other = node[other > 0], other[other > 0]
        return node, [rank[node], other]

    def second(key, table, answers):
        block = Block(table, length)
        ranks, _ = replied_ranks(answers)
        of, _, _ = classes(block.first_ranks())
        rank = np.zeros(len(block.nodes), np.uint64)
        rank[block.valid] = ranks[of] if len(of) else 0
        _, pairs = doubled(block, rank)
        return asks(key, table, pairs, planes(rank), cuts=by_rank)

    def grouped(block: Block, rank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The groups that may hold repeats, and their keys: pairs of ranks of up to MOST steps, and their ranges."""
        node = np.searchsorted(block.nodes, block.anchor)
        alive = np.flatnonzero(rank[node]) if len(node) else node
        node = node[alive]
        other = rank[block.after(node, np.maximum(block.steps(node) - 2 * START, 0))]
        alive, node, other = alive[other > 0], node[other > 0], other[other > 0]
        return alive, [rank[node], other, *block.fingerprints(block.low[alive], block.high[alive] + length, wide=True)]

    def third(key, table, answers):
        block = Block(table, length)
        ranks, state = replied_ranks(answers)
        node, pairs = doubled(block, unplanes(state, np.uint64))
        of, _, _ = classes(*pairs)
        rank = np.zeros(len(block.nodes), np.uint64)
        rank[node] = ranks[of] if len(of) else 0
        _, keys = grouped(block, rank)
        return asks(key, table, keys, planes(rank), cuts=by_rank)

    def singles(block: Block, state: np.ndarray) -> np.ndarray:
        use = (state == EDGE) | (state == WITNESS)
        low, sizes = block.low[use], block.high[use] - block.low[use] + 1
        return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))

    def fourth(key, table, answers):
        block = Block(table, length)
        codes, state = replies(answers)
        alive, keys = grouped(block, unplanes(state, np.uint64))
        of, _, _ = classes(*keys)
        state = np.zeros(len(block.low), np.uint8)
        state[alive] = codes[of] if len(of) else 0
        at = singles(block, state)
        return asks(key, table, block.fingerprints(at, at + length, wide=True), planes(state))

    fields = [docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields]
    if with_text:
        fields += T._parse_datatype_string("kept binary, spans array<struct<start: int, end: int>>").fields

    def last(key, table, answers):
        block = Block(table, length)
        codes, state = replies(answers)
        state = unplanes(state, np.uint8)
        at = singles(block, state)
        of, _, _ = classes(*block.fingerprints(at, at + length, wide=True))
        at = at[codes[of] > 0] if len(at) else at
        whole = state >= WHOLE
        change = np.zeros(len(block.body) + 1, np.int32)
        for start, end in ((block.low[whole], block.high[whole] + length), (at, at + length)):
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
        removed = np.cumsum(change[:-1], dtype=np.int32) > 0
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        begins = block.offsets[:-1][np.diff(block.offsets) > 0]
        edge[begins] = removed[begins]
        gone, spans = (np.concatenate([[0], np.cumsum(x)])[block.offsets] for x in (removed, edge))
        kept = memoryview(block.body[~removed])
        begin = block.offsets - gone
        texts = [kept[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        columns = [block.table.column("doc_id"), pa.array(np.diff(block.offsets)), pa.array(np.diff(gone)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        if with_text:
            runs = []
            for lo, hi in zip(block.offsets[:-1], block.offsets[1:]):
                own = np.diff(np.concatenate([[False], removed[lo:hi], [False]]).astype(np.int8))
                runs.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
            columns += [pa.array([bytes(t) for t in texts], pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.Table.from_arrays(columns, names=[f.name for f in fields])

    wide = [np.uint64, np.uint64]
    answers = answered(ask(blocks, first), buckets, ranked, [np.uint64, np.uint8])
    answers = answered(ask_again(blocks, answers, second), buckets, ranked, [*wide, np.uint8])
    answers = answered(ask_again(blocks, answers, third), buckets, sorted_out, [*wide, *wide, np.uint8])
    answers = answered(ask_again(blocks, answers, fourth), buckets, repeated, [*wide, np.uint8])
    return ask_again(blocks, answers, last, T.StructType(fields))
