"""Helpers that several operators share: the shared folder, parallelism, worker caches and text buffers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Groups that are broadcast for their size, at most.
HOT_GROUPS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. If that is unset, a local session (one process)
    gets a new one of this machine; elsewhere that would scatter parts over the executors' disks, so it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the application ends."""
    own = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def free_name(taken: list[str], name: str = "__text") -> str:
    """The name, or one like it that none of the taken ones is, whatever their case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder at once; they survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column, total: int) -> DataFrame:
    """rows left-joined to groups by keys. Groups of more than total / HOT_GROUPS rows, of which there can be no more than
    HOT_GROUPS, are broadcast; their rows then spread by `spread` over all tasks, in place of one for each group."""
    values = [c for c in groups.columns if c not in keys and c != size]
    is_hot, salt = free_name(rows.columns, "__hot"), free_name(rows.columns, "__salt")
    other = {c: free_name(rows.columns, f"__hot_{c}") for c in values}
    hot = groups.filter(F.col(size) * HOT_GROUPS > total).select(*keys, *(F.col(c).alias(other[c]) for c in values), F.lit(True).alias(is_hot))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(is_hot), F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(0).cast("bigint"))
    cold = groups.filter(F.col(size) * HOT_GROUPS <= total).select(*keys, *values, F.lit(0).cast("bigint").alias(salt))
    both = marked.join(cold, [*keys, salt], "left")
    return both.select(*rows.columns, *(F.when(F.col(is_hot), F.col(other[c])).otherwise(F.col(c)).alias(c) for c in values))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers, the i-th of which Spark's hash partitioning sends to partition i of n: one block for each task."""
    span = 16 * n * (n.bit_length() + 1)
    rows = spark.range(span).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id")).groupBy("p").agg(F.min("id").alias("k")).collect()
    keys = {r["p"]: r["k"] for r in rows}
    return [keys[i] for i in range(n)]


def pick(values: list[int], index: Column) -> Column:
    """values[index] as an int column; the list has one entry for each partition."""
    return F.element_at(F.lit(np.array(values, dtype=np.int32)), index.cast("int") + 1)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, whichever task asks for it."""
    home = sys.modules.setdefault("_millrace_worker", types.ModuleType("_millrace_worker"))
    return home.__dict__.setdefault(name, {})


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings one after another, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(1, np.int64)
    base, end = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return body, offsets - base


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
