"""Approximate search by product codes: a row is a few bytes, searched in place of its vector, and the best are ranked anew.

Directions are cut into parts, each coded by its nearest of at most 256 centres, which are fitted on a sample of bounded
size; every row is coded. A search decodes the codes of a batch and holds it against the queries by one matrix product,
as an exact search does; then the exact distances of the best rows decide. Of the stored vectors only those of candidates
are joined. Beside its codes a row has the distance between its direction and the decoded one, so that a search can also be
exact: what the codes can't rule out is ranked.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..sources.shared import fresh_path
from . import vector

#: Rows that the centres are fitted on, those with the least hashes of their keys; and steps of the fit.
SAMPLE_ROWS, STEPS = 8192, 8


@dataclass
class Codebook:
    centres: np.ndarray  # parts x centres x components of a part
    dims: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts, _, size = self.centres.shape
        x = np.pad(vector.unit(x), ((0, 0), (0, parts * size - x.shape[1])))
        out = np.empty((len(x), parts), np.uint8)
        for p, c in enumerate(self.centres):
            out[:, p] = ((c * c).sum(1)[None, :] - 2 * x[:, p * size : (p + 1) * size] @ c.T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, p]] for p, c in enumerate(self.centres)], axis=1)[:, : self.dims]


def fit(vectors: DataFrame, parts: int = 32, centres: int = 256, key: str = "vec_id", of: str = "embedding") -> Codebook:
    """Centres of each part of directions, by a few steps of assignment and mean from rows of the sample."""
    rows = vectors.filter(F.col(of).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(of).collect()
    x = vector.unit(np.array([r[0] for r in rows], float))
    dims = x.shape[1]
    size = -(-dims // parts)
    x = np.pad(x, ((0, 0), (0, parts * size - dims)))
    book = np.empty((parts, min(centres, len(x)), size))
    for p in range(parts):
        own = x[:, p * size : (p + 1) * size]
        c = own[: book.shape[1]].copy()
        for _ in range(STEPS):
            best = ((c * c).sum(1)[None, :] - 2 * own @ c.T).argmin(1)
            n = np.bincount(best, minlength=len(c))
            sums = np.stack([np.bincount(best, weights=own[:, j], minlength=len(c)) for j in range(size)], axis=1)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        book[p] = c
    return Codebook(book, dims)


def encoded(vectors: DataFrame, book: Codebook, key: str = "vec_id", of: str = "embedding") -> DataFrame:
    """key, codes and error of every row with a vector: how far its direction is from the one that the codes stand for."""
    schema = T.StructType([vectors.schema[key], T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                codes = book.encode(x)
                error = np.linalg.norm(vector.unit(x) - book.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=schema.names)

    return vectors.select(key, of).filter(F.col(of).isNotNull()).mapInArrow(run, schema)


def decoded(codes: DataFrame, book: Codebook, key: str = "vec_id", to: str = "embedding") -> DataFrame:
    """key and the direction that a row's codes stand for."""
    schema = T.StructType([codes.schema[key], T.StructField(to, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = book.decode(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)).astype(np.float32)
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=schema.names)

    return codes.select(key, "codes").mapInArrow(run, schema)


def candidates(codes: DataFrame, book: Codebook, queries: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """query_id and key of the n rows whose codes are nearest to each of queries (query_id, query)."""
    return vector.multi_top_k(decoded(codes, book, key), queries, n, key=key).select("query_id", key)


def top_k(codes: DataFrame, book: Codebook, vectors: DataFrame, queries: DataFrame, k: int, rerank: int = 300, key: str = "vec_id", of: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, key, distance and rank of the k nearest rows by exact cosine distance of the `rerank` best by codes."""
    return ranked(candidates(codes, book, queries, rerank, key), vectors, queries, k, key, of, digits)


def ranked(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", of: str = "embedding", digits: int = 6) -> DataFrame:
    """The k nearest of pairs (query_id, key) by exact cosine distance; ties go to the smaller key."""
    found = pairs.join(vectors.select(key, of), key).join(queries.select("query_id", "query"), "query_id")
    exact = found.select("query_id", key, F.round(vector.cosine_distance(F.col(of), F.col("query")), digits).alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), key)
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def within(codes: DataFrame, book: Codebook, queries: DataFrame, key: str = "vec_id", most: int = 1000) -> DataFrame:
    """query_id and key of all rows whose directions may be no farther than `radius` from those of queries (query_id, query,
    radius), as the distance of the decoded direction less the row's error says. A null radius lets all rows through. Queries
    are blocks in the shared folder, which each task reads one after another."""
    folder = fresh_path(codes.sparkSession, "queries")
    id_kind, own_kind = (to_arrow_type(f.dataType) for f in (queries.schema["query_id"], codes.schema[key]))

    def blocks(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                some = batch.slice(lo, most)
                q = vector.unit(np.array(some.column(1).to_pylist(), float))
                radius = np.array([4.0 if r is None else r for r in some.column(2).to_pylist()])  # no lower bound is above 2
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((some.column(0), q, radius))], pa.binary())], names=["block"])

    asked = queries.filter("query is not null").select("query_id", F.col("query").cast("array<double>"), F.col("radius").cast("double"))
    asked.mapInArrow(blocks, "block binary").write.parquet(folder)

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, vector.HELD_ROWS):
                some = batch.slice(lo, vector.HELD_ROWS)
                x = book.decode(np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1))
                error = some.column(2).to_numpy(zero_copy_only=False)
                both, own = np.column_stack([x, error]), (x * x).sum(1) - error * error
                for ids, q, radius in vector.read_blocks(folder):
                    # |q - x| > radius + error, both squared
                    far = ((q * q).sum(1) - radius * radius)[:, None] + own[None, :] - 2 * (np.column_stack([q, radius]) @ both.T) > 1e-9
                    j, i = np.nonzero(~far)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)).cast(id_kind), some.column(0).take(pa.array(i)).cast(own_kind)], names=["query_id", key])

    return codes.select(key, "codes", "error").mapInArrow(scan, T.StructType([queries.schema["query_id"], codes.schema[key]]))


def exact_top_k(codes: DataFrame, book: Codebook, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", of: str = "embedding", digits: int = 6) -> DataFrame:
    """As top_k, but exact: the k best by codes bound the k-th distance from above, and all rows that the codes don't rule out
    by that bound are ranked. Where a query has fewer than k distances, all rows are."""
    near = ranked(candidates(codes, book, queries, k, key), vectors, queries, k, key, of, digits)
    known = near.groupBy("query_id").agg(F.count("distance").alias("n"), F.max("distance").alias("d")).filter((F.col("n") >= k) & ~F.isnan("d"))
    # directions at cosine distance d are sqrt(2 d) apart
    reach = known.select("query_id", F.sqrt(2 * (F.greatest("d", F.lit(0.0)) + 10.0**-digits)).alias("radius"))
    bounded = queries.select("query_id", "query").join(reach, "query_id", "left")
    return ranked(within(codes, book, bounded, key), vectors, queries, k, key, of, digits)
