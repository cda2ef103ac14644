"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest pieces that still fit. Then its smallest piece is put back if two unpacked
pieces fit the gap that this opens more tightly. Which pieces exist is known from the number of pieces of each length,
so the plan is made on the driver from that histogram, whose size is bounded by the sequence length and not by the
data: equal bins are made many at a time, which gives the same bins as one at a time. Executors rank pieces within
their length and look the rank up in the plan.

Defined cases: null texts count as empty; each document ends in the end token, so that even an empty one gives a piece
of one token; equal rows are separate documents; an empty table gives an empty result; long texts are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved, worker_cache

#: Fixed values of byte-level BPE: its pre-token pattern and the special string of the tokenizer file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

#: White space that Python's patterns know and the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit integers. A tokenizer file of byte-level BPE is a list of ranks, which
    tiktoken applies several times faster; texts with special strings or odd separators go to the tokenizer itself."""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the byte that each symbol stands for: printable ones for themselves, the others in order from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        in_order = sorted(model["vocab"].items(), key=lambda x: x[1])
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [x for x, _ in in_order if len(x) > 1 and x != SPECIAL] != merges:
            raise ValueError(f"the ids of {tokenizer_file} are not in the order of its merges")
        ranks = {bytes(to_byte[c] for c in x): i for x, i in in_order if x != SPECIAL}
        self.encode = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or _SEPARATORS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.encode(text), "<u4").tobytes()


def ids_of(tokenizer_file: str) -> TokenIds:
    cache = worker_cache("token ids")
    if tokenizer_file not in cache:
        cache[tokenizer_file] = TokenIds(tokenizer_file)
    return cache[tokenizer_file]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else full pieces after a shorter first one."""
    if n <= size:
        return [(0, n)] if n else []
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


_PIECES = "part int, local long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, with ids as an array if with_ids; `local` numbers the
    pieces of one length within the task that made them, `part`."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = T._parse_datatype_string(_PIECES.format(kind=kind) + (", ids array<int>" if with_ids else ""))

    def pieces(batches):
        from pyspark import TaskContext

        encoder, part, seen = ids_of(tokenizer_file), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview((encoder.ids(text) if text else b"") + end)
                for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + length)]
                    local = seen[length] = seen.get(length, -1) + 1
                    for to, x in zip(rows, (part, local, doc, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)):
                        to.append(x)
            kinds = [pa.int32(), pa.int64(), batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            width = len(fields.names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows[:width], kinds[:width])], names=fields.names)

    return docs.select("doc_id", "text").mapInArrow(pieces, fields)


@dataclass
class Plan:
    """For each slot range, sorted by (length, first rank): ranks first .. first + bins * copies - 1 of that length
    lie in bins `bin` on, `copies` in each, at offset, offset + length and so on."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    bins: int


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Best-two-fit over the pieces of each length: at most as many steps as lengths run out, whatever the counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(size + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    bins = 0
    at = np.arange(size + 1)

    def largest(have: np.ndarray) -> np.ndarray:
        """For each gap the largest length that is there and fits, or 0."""
        return np.maximum.accumulate(np.where(have > 0, at, 0))

    while left.any():
        have, fill, gap = left.copy(), [], size
        fits = largest(have)
        while gap and (x := int(fits[gap])):
            n = min(gap // x, int(have[x]))
            fill += [x] * n
            gap -= n * x
            have[x] -= n
            if not have[x]:
                fits = largest(have)
        if gap and len(fill) > 1:
            small = fill[-1]
            room = gap + small
            a = at[1 : room + 1][have[1 : room + 1] > 0]
            b = fits[room - a]
            b = np.where((a == b) & (have[b] < 2), fits[a - 1], b)
            good = np.where(b > 0, a + b, 0)
            if good.size and good[k := int(good.argmax())] > small:
                fill[-1:] = sorted((int(a[k]), int(b[k])), reverse=True)
        lengths, copies = np.unique(fill, return_counts=True)
        many = int((left[lengths] // copies).min())
        # more bins like this one: until a length that it takes runs short of another
        offset = 0
        for length, n in sorted(zip(lengths.tolist(), copies.tolist()), reverse=True):
            slots.append((length, int(used[length]), bins, n, offset))
            offset += length * n
            used[length] += many * n
            left[length] -= many * n
        bins += many
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), bins)


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The saved pieces with sequence_id and offset. `part` and `local` are as token_pieces gives them."""
    counts = pieces.groupBy("length", "part").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    p = plan(histogram, size)
    # plain arrays: a broadcast is pickled by reference to classes, which executors may lack
    made = pieces.sparkSession.sparkContext.broadcast((p.length, p.first, p.bin, p.copies, p.offset))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "part", "local")
    schema = T.StructType([*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        lengths, first, bins, copies, offsets = made.value
        top = np.int64(1) << 44
        keys = lengths * top + first
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            k = np.searchsorted(keys, length * top + rank, "right") - 1
            nth = rank - first[k]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-2]]
            columns += [pa.array(bins[k] + nth // copies[k]), pa.array(offsets[k] + nth % copies[k] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id, text): where it lies in which sequence; with its ids if asked for."""
    pieces = saved(token_pieces(docs, tokenizer_file, size, end_id, with_ids))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return pack(pieces, size).select(*columns)
