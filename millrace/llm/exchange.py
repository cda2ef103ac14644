"""Blocks of documents that ask about their windows' fingerprints, and tasks that answer.

Documents are dealt once to blocks, one for each task. A block sends the distinct fingerprints of its windows, sorted,
to buckets by value, so that a window that is frequent anywhere is sent once by each block at most; the task of a bucket
holds all blocks' fingerprints against each other and sends back a code for each. Fingerprints travel as byte planes,
whose high ones nearly vanish when compressed.

A row from each block to each bucket would grow with the square of the input. From BUNDLED_FROM buckets on, blocks and
buckets are therefore grouped, about as many to a group as there are groups of buckets: a block sends a row to each group
of buckets, a relay takes those of a group of blocks apart and sends a row to each bucket, and the answers come back the
same way. So rows grow with the power of 1.5, and a relay holds about as much as a block sends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_keys, mix, pick, shuffle_partitions, worker_cache

#: Bytes of input, as the plan estimates them, for each block at most.
BLOCK_BYTES = 4 << 20
#: Sources that don't know their size say at least so much.
UNKNOWN_SIZE = 1 << 50
#: Bytes or words hashed at once: what the processor's cache holds.
SLICE = 1 << 15
#: Buckets from which rows are bundled: at the default block size, an input of 128 GB.
BUNDLED_FROM = 1 << 14
#: Tasks of a stage at most; beyond, a task takes one block or bucket after another.
MOST_TASKS = 1 << 16

_BASE = 0xD1342543DE82EF95
_ASK = "bucket int, block int, at int, what int, blob binary"
_ANSWER = "block int, at int, what int, blob binary"
_RELAYED = "row int, bucket int, block int, what int, blob binary"
#: what: fingerprints for a bucket or answers to them, state that a block sends to itself, or a bundle of CODES' blobs,
#: each with the numbers that its row would have.
CODES, STATE, BUNDLE = 0, 1, 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    cache = worker_cache("powers")
    if not cache or len(cache["up"]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            cache[name] = np.multiply.accumulate(a)
    return cache["up"][:n], cache["down"][:n]


class Rolling:
    """Rabin-Karp fingerprints of any ranges of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(body: np.ndarray) -> np.ndarray:
    """A fixed random number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[body]


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unplanes(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).ravel()


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Enough blocks for block_bytes of input each: by the size of the files that the plan reads or, where a source does
    not know its size, by the bytes of the texts themselves, counted."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_SIZE:
        size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2  # as Parquet would have it
    return max(shuffle_partitions(docs.sparkSession), size // block_bytes + 1)


def bucket_count(spark: SparkSession, blocks: int) -> int:
    return max(shuffle_partitions(spark), blocks // 2)


def bundle_width(buckets: int) -> int:
    """Blocks, and buckets, of a group; 0 if rows are not bundled."""
    return math.isqrt(buckets) if buckets >= BUNDLED_FROM else 0


def dealt(docs: DataFrame, index: Column, n: int) -> DataFrame:
    """docs with `block`, the block of that index, each block in a task of its own, up to MOST_TASKS."""
    block = pick(even_keys(docs.sparkSession, n), index) if n <= MOST_TASKS else index
    return docs.withColumn("block", block).repartition(min(n, MOST_TASKS), "block").withColumn("at", index)


def ordered(table: pa.Table) -> pa.Table:
    """A block's documents in an order that does not depend on how they came."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")).combine_chunks()


def by_value(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted fingerprints of each bucket begin, but for the first."""
    return np.searchsorted(hashes, np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64))


def by_rank(ranks: np.ndarray, buckets: int) -> np.ndarray:
    """As by_value, of sorted ranks: each goes back to the bucket that gave it."""
    return np.searchsorted(ranks, np.arange(2, buckets + 1, dtype=np.uint64) << np.uint64(32))


def questions(block: int, at: int, buckets: int, hashes: np.ndarray, *more: np.ndarray, state: bytes | None = None, cuts: Callable = by_value) -> pa.Table:
    """The rows that a block sends: its sorted fingerprints, with more of each, cut by bucket; and its state."""
    edges = np.concatenate([[0], cuts(hashes, buckets), [len(hashes)]])
    sent = [(b, _join([planes(x[lo:hi]) for x in (hashes, *more)])) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
    width = bundle_width(buckets)
    if width:
        rows = [(group, block, at, BUNDLE, blob) for group, blob in bundles((b // width, (b,), blob) for b, blob in sent)]
    else:
        rows = [(b, block, at, CODES, blob) for b, blob in sent]
    if state is not None:
        own = at % buckets
        rows.append((own // width if width else own, block, at, STATE, state))
    return as_table(rows, _ASK)


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of ints and, as the last column, a blob."""
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.binary() if name == "blob" else pa.int32()) for i, name in enumerate(names)], names=names)


def bundles(items: Iterator[tuple[int, tuple, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Of (to, numbers, blob): one blob for each `to`."""
    found: dict[int, list] = {}
    for to, numbers, blob in items:
        found.setdefault(to, []).append(np.array(numbers, "<i4").tobytes() + blob)
    for to, parts in found.items():
        yield to, _join(parts)


def unbundled(data: bytes, n: int) -> Iterator[tuple]:
    """The n numbers of each item of a bundle, and its blob."""
    for item in _split(data):
        yield *np.frombuffer(item, "<i4", n).tolist(), item[4 * n :]


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(data):
        n = int.from_bytes(data[i : i + 4], "little")
        out.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return out


Resolver = Callable[..., np.ndarray]


def answered(asked: DataFrame, buckets: int, resolve: Resolver, dtypes: list) -> DataFrame:
    """resolve(order of the block, hashes, more...) gives a small code for each, over all blocks of a bucket, whose
    rows come in the blocks' order."""

    def resolved(own: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        """Of a bucket's (at, block, blob): at, block and the codes."""
        own = sorted(own)
        parts = [[unplanes(p, d) for p, d in zip(_split(blob), dtypes)] for _, _, blob in own]
        sizes = [len(p[0]) for p in parts]
        columns = [np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))]
        codes = resolve(np.repeat(np.arange(len(own), dtype=np.int32), sizes), *columns)
        ends = np.cumsum(sizes)
        pack = planes if codes.dtype == np.uint8 else packed_ranks
        for (at, block, _), n, e in zip(own, sizes, ends):
            yield at, block, pack(codes[e - n : e])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["what"] == STATE:
                    yield from as_table([(row["block"], -1, STATE, row["blob"])], _ANSWER).to_batches()
                else:
                    rows.setdefault(row["bucket"], []).append((row["at"], row["block"], row["blob"]))
        for bucket in list(rows):
            yield from as_table([(block, bucket, CODES, codes) for _, block, codes in resolved(rows.pop(bucket))], _ANSWER).to_batches()

    width = bundle_width(buckets)
    if not width:
        return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(answer, _ANSWER)

    def there(key, table):
        """From the rows of a group of blocks to a group of buckets: a row to each bucket."""
        rows = table.to_pylist()
        states = [(row["at"] // width, row["at"] % buckets, row["block"], STATE, row["blob"]) for row in rows if row["what"] == STATE]
        items = ((bucket, (row["at"], row["block"]), blob) for row in rows if row["what"] == BUNDLE for bucket, blob in unbundled(row["blob"], 1))
        return as_table(states + [(key[0].as_py(), bucket, -1, BUNDLE, blob) for bucket, blob in bundles(items)], _RELAYED)

    def bucket_answers(key, table):
        """A row to each group of blocks."""
        rows, bucket = table.to_pylist(), key[0].as_py()
        states = [(row["row"], bucket, row["block"], STATE, row["blob"]) for row in rows if row["what"] == STATE]
        own = [item for row in rows if row["what"] == BUNDLE for item in unbundled(row["blob"], 2)]
        items = ((at // width, (block,), codes) for at, block, codes in resolved(own)) if own else iter(())
        return as_table(states + [(row, bucket, -1, BUNDLE, blob) for row, blob in bundles(items)], _RELAYED)

    def back(key, table):
        """From the answers of a group of buckets to a group of blocks: a row to each block."""
        rows = table.to_pylist()
        states = [(row["block"], -1, STATE, row["blob"]) for row in rows if row["what"] == STATE]
        items = ((block, (row["bucket"],), codes) for row in rows if row["what"] == BUNDLE for block, codes in unbundled(row["blob"], 1))
        return as_table(states + [(block, key[1].as_py(), BUNDLE, blob) for block, blob in bundles(items)], _ANSWER)

    tasks = min(buckets, MOST_TASKS)
    row, group = F.floor(F.col("at") / width).cast("int").alias("row"), F.floor(F.col("bucket") / width).cast("int").alias("group")
    sent = asked.withColumnRenamed("bucket", "group").withColumn("row", row)
    met = sent.repartition(tasks, "row", "group").groupBy("row", "group").applyInArrow(there, _RELAYED)
    told = met.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(bucket_answers, _RELAYED).withColumn("group", group)
    return told.repartition(tasks, "row", "group").groupBy("row", "group").applyInArrow(back, _ANSWER)


def received(table: pa.Table) -> tuple[list[tuple[int, bytes]], bytes | None]:
    """The answers of each bucket, in the buckets' order, and the state that the block sent along."""
    found, state = [], None
    for row in table.to_pylist():
        if row["what"] == STATE:
            state = row["blob"]
        elif row["what"] == BUNDLE:
            found.extend(unbundled(row["blob"], 1))
        else:
            found.append((row["at"], row["blob"]))
    return sorted(found), state


def packed_ranks(ranks: np.ndarray) -> bytes:
    """uint32 numbers, 0 or rising: which are 0, and the steps of the others."""
    some = ranks > 0
    return _join([len(ranks).to_bytes(8, "little"), planes(np.packbits(some)), planes(np.diff(ranks[some], prepend=np.uint32(0)))])


def replied_ranks(table: pa.Table) -> tuple[np.ndarray, bytes | None]:
    """As replies, of ranks: the bucket's number from 1 in the upper half, its own number in the lower; 0 stays."""
    found, state = received(table)
    ranks = []
    for bucket, blob in found:
        size, some, steps = _split(blob)
        mask = np.unpackbits(unplanes(some, np.uint8))[: int.from_bytes(size, "little")].astype(bool)
        own = np.zeros(len(mask), np.uint64)
        own[mask] = (np.cumsum(unplanes(steps, np.uint32), dtype=np.uint64)) + (np.uint64(bucket + 1) << np.uint64(32))
        ranks.append(own)
    return np.concatenate([np.zeros(0, np.uint64), *ranks]), state


def replies(table: pa.Table) -> tuple[np.ndarray, bytes | None]:
    """The codes for a block's fingerprints in their order, and the state that it sent along."""
    found, state = received(table)
    return np.concatenate([np.zeros(0, np.uint8), *(unplanes(blob, np.uint8) for _, blob in found)]), state


def ask(blocks: DataFrame, first: Callable) -> DataFrame:
    """first(key, documents) -> questions, for each block."""
    return blocks.groupBy("block").applyInArrow(first, _ASK)


def ask_again(blocks: DataFrame, answers: DataFrame, again: Callable, schema=_ASK) -> DataFrame:
    """again(key, documents, answers) for each block."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(again, schema)
