"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors are integers, floor(scale * x). A task holds a batch of candidates in vertical layout, one array for each
dimension, and adds up a query's scores block by block of dimensions. After each block a candidate's score can rise by
at most the product of the remaining masses (norms over the dimensions not yet seen); candidates that can't reach the
query's k-th best score are dropped and the rest compacted. First bounds come from a sample of candidates of fixed
size; they only save work, the result is exact. Executors make the queries into blocks of bounded size with their first
bounds and write them to the shared folder; each task reads one block after another for its candidates and returns only
what beats the bound. Neither queries nor bounds pass through the driver.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; missing components of
shorter vectors count as 0; rows that share the query's id are not its candidates; equal scores go to the smaller id,
repeated ids keep a row each; fewer than k candidates give as many rows; empty tables give an empty result. Scores
beyond a long are held at its ends.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, shuffle_partitions

#: Components of the queries of a block, at most (but one query at least).
QUERY_COMPONENTS = 1 << 18
#: Candidates that a task holds while it reads all blocks of queries.
HELD_ROWS = 1 << 15
#: Candidates of the sample that gives the first bounds.
SAMPLE_ROWS = 2048
#: Candidates scored at once, and dimensions of a block.
BATCH_ROWS, BLOCK = 4096, 16
EXACT = float(1 << 53)


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, dimensions x rows; float64 if those are exact integers, else Python's."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(scale * flat)
    out = np.ascontiguousarray(out.T)
    return out if np.abs(out).max(initial=0) < 1 << 52 else np.array([[int(x) for x in r] for r in out], object).reshape(out.shape)


def padded(x: np.ndarray, dims: int) -> np.ndarray:
    return x if len(x) >= dims else np.concatenate([x, np.zeros((dims - len(x), x.shape[1]), x.dtype)])


def exact_in_floats(q: np.ndarray, x: np.ndarray) -> bool:
    return q.dtype != object and x.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q)) < EXACT


class Best:
    """A query's best candidates so far, at least as good as `bound` once there are k of them."""

    def __init__(self, k: int, bound: float = -math.inf):
        self.k, self.bound, self.ids, self.scores = k, bound, np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.bound = max(self.bound, self.scores[-1])


def remaining(x: np.ndarray, block: int) -> list[np.ndarray]:
    """Norms over the dimensions from each block's end on, rounded up."""
    squares = np.vstack([np.cumsum((x * x)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]))])
    return [np.sqrt(squares[min(d + block, len(x))]) * (1 + 1e-9) for d in range(0, max(1, len(x)), block)]


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, best: list[Best], block: int = BLOCK) -> None:
    """Holds all queries (columns of q) against the candidates (columns of x)."""
    dims = max(len(q), len(x))
    q, x = padded(q, dims), padded(x, dims)
    if not exact_in_floats(q, x):
        for j, own in enumerate(query_ids):
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(q[:, j], c)))) for c in x.T], object)
            use = np.array([i != own for i in ids], bool)
            best[j].add(ids[use], scores[use])
        return
    mass_x, mass_q = remaining(x, block), remaining(q, block)
    firsts = q[:block].T @ x[:block]
    for j, own in enumerate(query_ids):
        here, scores = np.flatnonzero(ids != own), None
        scores = firsts[j, here]
        for b in range(len(mass_x)):
            if b:
                scores = scores + q[b * block : (b + 1) * block, j] @ x[b * block : (b + 1) * block, here]
            keep = np.flatnonzero(scores + mass_q[b][j] * mass_x[b][here] + 1e-6 >= best[j].bound)
            if len(keep) < len(here):
                here, scores = here[keep], scores[keep]
            if not len(here):
                break
        if len(here):
            best[j].add(ids[here], scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows for each row that is_query holds for."""
    spark = vectors.sparkSession
    at = F.col("__x")
    rows = vectors.select(F.col(key).cast("bigint").alias("__id"), F.col(vector).alias("__x"), F.coalesce(is_query, F.lit(False)).alias("__q"))
    rows = rows.filter(F.col("__id").isNotNull() & at.isNotNull() & F.forall(at, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))
    total, queries, longest = rows.agg(F.count("*"), F.count_if("__q"), F.max(F.size("__x"))).first()
    schema = "query_id bigint, vec_id bigint, score bigint"
    if not queries:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    spread = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    sample = rows.filter(spread < int((1 << 30) * min(1.0, SAMPLE_ROWS / total))).select("__id", "__x").toArrow()  # of fixed size
    first = spark.sparkContext.broadcast((sample.column(0).to_numpy(), matrix(sample.column(1), scale)))
    width = max(1, QUERY_COMPONENTS // max(1, longest))

    def blocks(batches):
        ids_of_sample, x = first.value
        for batch in batches:
            for lo in range(0, batch.num_rows, width):
                some = batch.slice(lo, width)
                ids, q = some.column(0).to_numpy(), matrix(some.column(1), scale)
                best = [Best(k) for _ in ids]
                search(ids_of_sample, x, ids, q, best)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids, q, [b.bound for b in best]))], pa.binary())], names=["block"])

    folder = fresh_path(spark, "queries")
    tasks = min(shuffle_partitions(spark), -(-queries // width))
    rows.filter("__q").select("__id", "__x").repartition(tasks, "__id").mapInArrow(blocks, "block binary").write.parquet(folder)

    def query_blocks():
        from pyarrow import fs, parquet

        store, path = fs.FileSystem.from_uri(folder)
        for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
            with store.open_input_file(file) as source:
                for batch in parquet.ParquetFile(source).iter_batches(batch_size=1):
                    yield pickle.loads(batch.column(0)[0].as_py())

    def against_all(held: list[tuple[np.ndarray, np.ndarray]]):
        for ids, q, bounds in query_blocks():
            best = [Best(k, b) for b in bounds]
            for own, x in held:
                search(own, x, ids, q, best)
            n = [len(b.ids) for b in best]
            scores = [int(s) for b in best for s in b.scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)]), pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(lo, BATCH_ROWS)
                held.append((some.column(0).to_numpy(), matrix(some.column(1), scale)))
                size += some.num_rows
                if size >= HELD_ROWS:
                    yield from against_all(held)
                    held, size = [], 0
        if held:
            yield from against_all(held)

    found = rows.select("__id", "__x").mapInArrow(scan, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
