"""Exact vector search with predicates: of one query by JVM functions on doubles, of many by matrix products."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import fixed, text
from ..sources.shared import fresh_path

#: Vectors that a task holds while it reads all blocks of queries.
HELD_ROWS = 8192
#: Vectors of the sample that bounds a search of many queries.
SAMPLE_ROWS = 1024


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = _sum(a, b, lambda x, y: x * y)
    return 1 - F.try_divide(dot, F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


METRICS = {"cosine": cosine_distance, "l2": squared_l2}


def predicate(**bounds) -> Column | None:
    """AND of conditions on columns: a value or a list of values, or bounds given as name__lte and name__gte; None
    values are no conditions. None if nothing is left."""
    found = []
    for name, value in bounds.items():
        if value is None or value == []:
            continue
        column, _, how = name.partition("__")
        c = F.col(column)
        if how:
            found.append({"lte": c <= value, "gte": c >= value}[how])
        elif isinstance(value, (list, tuple, set)):
            found.append(c.isin(list(value)) if len(value) > 1 else c == list(value)[0])
        else:
            found.append(c == value)
    return reduce(lambda a, b: a & b, found) if found else None


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The k rows nearest to the query among those that `where` holds for, with `distance`; ties go to the smaller key.
    The predicate is below the limit, so it prunes the scan; the k rows are taken within partitions first. Null vectors
    take no part; those without a direction come last."""
    rows = (vectors if where is None else vectors.filter(where)).filter(F.col(vector).isNotNull())
    q = F.lit(list(map(float, query)))
    return rows.withColumn("distance", F.round(METRICS[metric](F.col(vector), q), digits)).orderBy(F.col("distance").asc_nulls_last(), key).limit(k)


def read_blocks(folder: str):
    """The blocks of queries in the shared folder, one after another."""
    from pyarrow import fs, parquet

    store, path = fs.FileSystem.from_uri(folder)
    for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for batch in parquet.ParquetFile(source).iter_batches(batch_size=1):
                yield pickle.loads(batch.column(0)[0].as_py())


def multi_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", digits: int = 6, most: int = 1000, same: tuple[str, str] | None = None) -> DataFrame:
    """The k nearest rows for each of queries (query_id, query): query_id, key, distance and rank; ties go to the smaller
    key. `same` names a column of vectors and one of queries: only rows with the query's value take part, none for null.
    Executors write the queries as blocks of `most` to the shared folder, each query with a bound, its k-th distance in a
    sample of SAMPLE_ROWS vectors; each task of the vectors reads one block after another, scores a batch by one matrix
    product, and returns those of k rows for each query and HELD_ROWS vectors that the bound lets pass. So the number of
    queries is not bounded, and no pair of a query and a vector is ever a row. Null vectors take no part."""
    spark = vectors.sparkSession
    folder = fresh_path(spark, "queries")
    id_kind = queries.schema["query_id"].dataType
    tag, own_tag = (F.col(same[0]), F.col(same[1])) if same else (F.lit(0), F.lit(0))

    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        dots = q @ x.T
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                found = 1 - dots / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :])
        else:
            found = (q * q).sum(1)[:, None] - 2 * dots + (x * x).sum(1)[None, :]
        return np.round(found, digits) + 0.0  # no negative zero

    rows = vectors.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__x"), tag.cast("string").alias("__tag")).filter("__x is not null and __tag is not null")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"), own_tag.cast("string").alias("tag")).filter("query is not null and tag is not null")
    n = asked.count()
    schema = T.StructType([T.StructField("query_id", id_kind), T.StructField(key, vectors.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    if not n:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    # a sample of bounded size, those with the least hashes of their keys; it only saves work
    few = rows.orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE_ROWS).select("__x", "__tag").collect()
    sample = spark.sparkContext.broadcast(([r[0] for r in few], [r[1] for r in few]))

    def blocks(batches):
        some_x, some_tags = np.array(sample.value[0], float), np.array(sample.value[1])
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                some = batch.slice(lo, most)
                q, tags = np.array(some.column(1).to_pylist(), float), np.array(some.column(2).to_pylist())
                bounds = np.full(len(q), np.inf)
                if len(some_x) >= k:
                    found = distances(q, some_x)
                    for j in range(len(q)):
                        here = found[j, (some_tags == tags[j]) & ~np.isnan(found[j])]
                        if len(here) >= k:
                            bounds[j] = np.partition(here, k - 1)[k - 1] + 10.0**-digits  # products may be rounded in another way
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((some.column(0).to_pylist(), q, tags, bounds))], pa.binary())], names=["block"])

    asked.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // most))), "query_id").mapInArrow(blocks, "block binary").write.parquet(folder)
    own_kind, asked_kind = to_arrow_type(vectors.schema[key].dataType), to_arrow_type(id_kind)

    def nearest(ids: pa.Array, x: np.ndarray, tags: np.ndarray):
        order = ids.to_numpy(zero_copy_only=False)
        order = order if order.dtype != object else order.astype(str)
        for asked_ids, q, own_tags, bounds in read_blocks(folder):
            found = distances(q, x)
            found_ids, columns, values = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            for j in range(len(q)):
                at = np.flatnonzero(~(found[j] > bounds[j]) if same is None else ~(found[j] > bounds[j]) & (tags == own_tags[j]))
                if len(at) > k:
                    at = at[~(found[j, at] > np.partition(found[j, at], k - 1)[k - 1])]
                at = at[np.lexsort((order[at], found[j, at]))[:k]]
                found_ids += [asked_ids[j]] * len(at)
                columns.append(at)
                values.append(found[j, at])
            yield pa.RecordBatch.from_arrays([pa.array(found_ids, asked_kind), ids.take(pa.array(np.concatenate(columns))).cast(own_kind), pa.array(np.concatenate(values))], names=schema.names)

    def scan(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield from nearest(table.column(0).chunk(0), np.array(table.column(1).to_pylist(), float), np.array(table.column(2).to_pylist()))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                yield from flush()
        if held:
            yield from flush()

    scored = rows.mapInArrow(scan, schema)
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def oversampled(n: int) -> int:
    return int(2.5 * n)


def boosted(hits: DataFrame, query: Column, n: int, key: str = "vec_id", weight: float = fixed.KEYWORD_WEIGHT, stop_words: list[str] = fixed.STOP_WORDS_RULES, digits: int = 6) -> DataFrame:
    """The n best of hits (text, distance) after a bonus for each of the query's keywords that the text has."""
    boost = F.size(text.keywords_in(F.coalesce("text", F.lit("")), text.keywords(query, stop_words))) * F.lit(weight)
    return hits.withColumn("boost", F.round(boost, digits)).withColumn("final_score", F.round(F.col("distance") - boost, digits)).orderBy("final_score", "distance", key).limit(n)


def semantic_search(chunks: DataFrame, query: str, embedding: list[float], n: int, where: Column | None = None, key: str = "chunk_id", stop_words: list[str] = fixed.STOP_WORDS_RULES) -> DataFrame:
    """Oversampled top-k, keyword bonus, and the n best."""
    return boosted(top_k(chunks, embedding, oversampled(n), where=where, key=key), F.lit(query), n, key, stop_words=stop_words)


def cell_centres(vectors: DataFrame, cells: int = 64, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Directions of `cells` rows, those with the least hashes of their keys: the bounded sample that an index is fitted on."""
    rows = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(cells).select(vector).collect()
    return unit(np.array([r[0] for r in rows], float))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n cells whose centres point most alike, for each row; of equals the first."""
    return np.argsort(-(unit(x) @ centres.T), axis=1, kind="stable")[:, :n]


def cell_index(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding", to: str = "cell") -> DataFrame:
    """Every row with its cell. Written partitioned by it, a search reads the cells that it probes only; null vectors have
    none."""
    kept = vectors.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.IntegerType())])

    def run(batches):
        for b in batches:
            rows = b.column(b.schema.get_field_index(vector)).to_pylist()
            some = [k for k, v in enumerate(rows) if v is not None]
            cells: list[int | None] = [None] * len(rows)
            if some:
                for k, c in zip(some, nearest_cells(np.array([rows[k] for k in some], float), centres, 1)[:, 0].tolist()):
                    cells[k] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=schema.names)

    return kept.mapInArrow(run, schema)


def approximate_top_k(indexed: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int = 40, key: str = "vec_id", vector: str = "embedding", cell: str = "cell") -> DataFrame:
    """The k nearest rows of the `probes` cells nearest to the query, ranked exactly. Recall is not guaranteed; a test
    measures it on the test tables, whose vectors point anywhere: 0.9 takes more than half of the cells there."""
    own = nearest_cells(np.array([query], float), centres, probes)[0].tolist()
    return top_k(indexed, query, k, where=F.col(cell).isin(own), key=key, vector=vector)
