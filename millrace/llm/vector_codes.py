"""Vector code compression: product codes by Lloyd's iteration, maintained by deltas.

Vectors become integers, floor(scale * x), and are cut into equal parts; each part is coded as the number of its nearest
entry in the codebook of its position. Vectors are packed into blocks once, in a table bucketed by block. Each round
joins the blocks with the codes that the round before has stored, in a table with the same buckets, so without a
shuffle; it stores the new codes and, beside them, what each block changes: for each entry the vectors that joined it
less those that left it, as counts and sums. Only these few numbers of each task are shuffled; the driver adds them to
the running sums, one integer vector for each entry, and derives the codebooks, which travel with the next round's tasks.

All arithmetic is exact: in float64 where every sum stays below 2^53, else in Python's integers.

Defined cases: vectors that are null, or hold a null or a non-finite component, are dropped; shorter vectors count as
filled up with 0, to the longest one's length and to a multiple of the number of parts; components of more than 2^62 are
held there, errors at the largest long. Rows without an id come after all others as first entries, equal ids go by their
vectors; repeated rows are coded each. Fewer rows than entries give fewer entries. Rows without a label share one sum.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_path, joined_to_groups, shuffle_partitions

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Components are held between - and + this.
MOST = 1 << 62
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Sums travel as two longs: the lower bits, and the rest.
LOW_BITS = 31

_CHANGED = "block bigint, codes binary, delta array<struct<cell:int,n:bigint,high:array<bigint>,low:array<bigint>>>"


@dataclass
class Codes:
    """rows: id, label, code (hex), error, label_error; books: integers, parts x entries x components of a part."""

    rows: DataFrame
    books: list[list[list[int]]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.books for entry in part for x in entry).encode()).hexdigest()


def integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """rows x width of floor(scale * x), missing components 0, in the smallest type of signed integers."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(scale * flat), -float(MOST), float(MOST))
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = flat.astype(np.int64)
    most = int(np.abs(out).max(initial=0))
    return out.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def unpacked(blob: bytes, rows: int, width: int) -> np.ndarray:
    size = len(blob) // (rows * width) if width else 2
    return np.frombuffer(blob, np.dtype(f"i{size}")).reshape(rows, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, of equals the first, and the rows' squared distances, exact."""
    parts, entries, size = books.shape
    most = max(int(np.abs(x).max(initial=0)), max((abs(int(v)) for v in books.ravel()), default=0))
    exact = 4 * most * most * max(1, parts * size) < EXACT
    x, books = x.astype(np.float64 if exact else object), books.astype(np.float64 if exact else object)
    codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), x.dtype)
    for p in range(parts):
        own = x[:, p * size : (p + 1) * size]
        if exact:
            found = (own * own).sum(1)[:, None] - 2 * (own @ books[p].T) + (books[p] * books[p]).sum(1)[None, :]
        else:
            found = ((own[:, None, :] - books[p][None, :, :]) ** 2).sum(2) if size else np.zeros((len(x), entries), object)
        codes[:, p] = best = found.argmin(axis=1)
        error += found[np.arange(len(x)), best]
    return codes, error


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> Iterator[dict]:
    """For each entry of each part: how many rows have joined it less those that left it, and the sums of these parts."""
    parts = new.shape[1]
    size = x.shape[1] // parts
    exact = int(np.abs(x).max(initial=0)) * max(1, len(x)) < EXACT
    for p in range(parts):
        moved = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        if not len(moved):
            continue
        own = x[moved, p * size : (p + 1) * size].astype(np.float64 if exact else object)
        signs = (new[moved, p] == np.arange(entries)[:, None]).astype(np.int8)
        if old is not None:
            signs -= old[moved, p] == np.arange(entries)[:, None]
        sums = signs.astype(own.dtype) @ own
        for e in np.flatnonzero(signs.any(axis=1)).tolist():
            whole = [int(v) for v in sums[e]]
            yield {"cell": p * entries + e, "n": int(signs[e].sum()), "high": [v >> LOW_BITS for v in whole], "low": [v & (1 << LOW_BITS) - 1 for v in whole]}


class Tables:
    """Tables of blocks with the same buckets, in the application's part of the shared folder."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, {}

    def stored(self, rows: DataFrame, what: str) -> DataFrame:
        name, path = f"millrace_{what}_{uuid.uuid4().hex}", fresh_path(self.spark, what)
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).saveAsTable(name)
        self.names[name] = path
        return self.spark.table(name)

    def dropped(self, keep: int = 0) -> None:
        """Drops all tables but the last `keep` after the first, or all."""
        own = list(self.names)
        for name in own[1 : len(own) - keep] if keep else own:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.names.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> Codes:
    """Codes of all vectors by codebooks that begin as the parts of the first `entries` vectors by key and are moved by
    `rounds` rounds of assignment and floor(sum / count); unused entries stay. `entries` is 256 at most."""
    spark = vectors.sparkSession
    at = F.col("x")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), (F.col(label) if label in vectors.columns else F.lit(None).cast("int")).alias("label"))
    rows = rows.filter(at.isNotNull() & F.forall(at, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))
    id_kind, label_kind = rows.schema["id"].dataType, rows.schema["label"].dataType
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    out = T.StructType([T.StructField("id", id_kind), T.StructField("label", label_kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if longest is None:
        return Codes(spark.createDataFrame([], T.StructType([*out.fields, T.StructField("label_error", T.LongType())])), [[] for _ in range(parts)])
    width = -(-longest // parts) * parts
    size = width // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column(0).combine_chunks()
    start = integers(first if isinstance(first, pa.Array) else first.chunk(0), scale, width)
    books = [[[int(v) for v in start[e, p * size : (p + 1) * size]] for e in range(len(start))] for p in range(parts)]
    entries = len(start)
    block_schema = T.StructType([T.StructField("ids", T.ArrayType(id_kind)), T.StructField("labels", T.ArrayType(label_kind)), T.StructField("x", T.BinaryType())])
    kinds = [pa.list_(to_arrow_type(id_kind)), pa.list_(to_arrow_type(label_kind)), pa.binary()]

    def packed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(lo, BLOCK_ROWS)
                ends = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, some.column(i)).cast(k) for i, k in zip((0, 2), kinds)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([integers(some.column(1), scale, width).tobytes()], pa.binary())], names=block_schema.names)

    buckets = shuffle_partitions(spark)
    tables = Tables(spark, buckets)
    blocks = tables.stored(rows.mapInArrow(packed, block_schema).withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block"), "blocks")
    sums, counts = [[[0] * size for _ in range(entries)] for _ in range(parts)], [[0] * entries for _ in range(parts)]
    codes = None
    for _ in range(rounds):
        shared = np.array(books, dtype=object).reshape(parts, entries, size)

        def assigned(batches, shared=shared):
            for batch in batches:
                for row in batch.to_pylist():
                    x = unpacked(row["x"], row["n"], width)
                    new, _ = nearest(x, shared)
                    old = None if row.get("codes") is None else np.frombuffer(row["codes"], np.uint8).reshape(new.shape)
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "codes": new.tobytes(), "delta": list(changes(x, old, new, entries))}], CHANGED)

        here = blocks.select("block", F.size("ids").alias("n"), "x")
        if codes is not None:
            here = here.join(codes.select("block", "codes").hint("shuffle_hash"), "block")
        codes = tables.stored(here.mapInArrow(assigned, _CHANGED), "codes")
        tables.dropped(keep=1)
        told = codes.select(F.explode("delta").alias("d")).select("d.*")
        add = lambda name: [F.sum(F.col(name)[j]).alias(f"{name}{j}") for j in range(size)]
        moved = told.groupBy("cell").agg(F.sum("n").alias("n"), *add("high"), *add("low")).collect()  # a row for each entry at most
        if not moved:
            break  # nothing has changed, so nothing will
        for row in moved:
            p, e = divmod(row["cell"], entries)
            counts[p][e] += row["n"]
            own = sums[p][e] = [s + (row[f"high{j}"] << LOW_BITS) + row[f"low{j}"] for j, s in enumerate(sums[p][e])]
            if counts[p][e]:
                books[p][e] = [s // counts[p][e] for s in own]
    final = np.array(books, dtype=object).reshape(parts, entries, size)

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, blob = (batch.column(k)[i] for k in range(3))
                found, error = nearest(unpacked(blob.as_py(), len(ids), width), final)
                text = found.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array([min(LONG, int(v)) for v in error], pa.int64())], names=out.names)

    path = fresh_path(spark, "coded")
    blocks.select("ids", "labels", "x").mapInArrow(coded, out).write.parquet(path)
    tables.dropped()
    done = spark.read.schema(out).parquet(path)
    group: Column = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    keyed = done.withColumn("group", group)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    groups = keyed.groupBy("group").agg(total.alias("label_error"), F.count("*").alias("n"))
    whole = joined_to_groups(keyed, groups, ["group"], "n", F.col("id").cast("string"), done.count())
    return Codes(whole.select(*out.names, "label_error"), books)


CHANGED = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("delta", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])))])
