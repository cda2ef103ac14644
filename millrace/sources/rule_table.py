"""The index of rule numbers as a table for point lookups: rows in order of (rule, rank), cut by range into pieces.

No rule is one task's work, however many chunks it has: entries are cut into pieces by (rule, priority, seq), each piece
counts its own, and the rank of a rule that goes on from an earlier piece is continued from the earlier pieces' counts,
of which a piece needs one number. A list of the pieces' first and last entries lets a lookup read those files only that
can have what it wants: of a hot rule, the piece with its first entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import rule_index
from .shared import saved

_ORDER = ["rule", "priority", "seq", "secondary", "chunk_id"]


def ranked(chunks: DataFrame, pieces: int) -> DataFrame:
    """The rows of rule_index.rule_index with `piece`, in order within and between pieces, after one shuffle."""
    rows = rule_index.entries(chunks)
    nulls_first = [F.col(c).asc_nulls_first() for c in _ORDER]
    cut = rows.repartitionByRange(pieces, *nulls_first).sortWithinPartitions(*nulls_first)
    schema = T.StructType([*cut.schema.fields, T.StructField("local", T.LongType())])

    def numbered(batches):
        rule, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index("rule"))
            values = own.to_numpy(zero_copy_only=False)
            new = np.concatenate([[values[0] != rule], values[1:] != values[:-1]])
            at = np.arange(len(values))
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(start >= 0, at - start + 1, at + 1 + n)
            rule, n = values[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])

    # stored, so that a piece is the same rows whenever it is read
    held = saved(cut.mapInArrow(numbered, schema).withColumn("piece", F.spark_partition_id()), "entries")
    counts = held.groupBy("rule", "piece").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("rule").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("before", before).filter("before > 0").select("rule", "piece", "before")  # one for each piece at most, for its first rule
    whole = held.join(F.broadcast(carried), ["rule", "piece"], "left")
    return whole.withColumn("rank", (F.col("local") + F.coalesce("before", F.lit(0))).cast("int")).drop("local", "before")


def write(chunks: DataFrame, path: str, pieces: int) -> None:
    """The table at path/pieces, a folder for each piece, and the list of pieces at path/list."""
    # a piece is a task's whole output, as it was cut
    ranked(chunks, pieces).repartition(pieces, "piece").sortWithinPartitions("piece", "rule", "rank").write.partitionBy("piece").parquet(f"{path}/pieces")
    rows = chunks.sparkSession.read.parquet(f"{path}/pieces")
    ends = rows.groupBy("piece").agg(F.min(F.struct("rule", "rank")).alias("lo"), F.max(F.struct("rule", "rank")).alias("hi"), F.count("*").alias("rows"))
    ends.coalesce(1).write.parquet(f"{path}/list")


def lookup(spark: SparkSession, path: str, rules: list[str], most: int) -> DataFrame:
    """The first `most` entries of each of a few rules, from the pieces that can have them."""
    ends = spark.read.parquet(f"{path}/list")
    wanted = F.exists(F.lit(rules), lambda r: (F.col("hi.rule") >= r) & ((F.col("lo.rule") < r) | ((F.col("lo.rule") == r) & (F.col("lo.rank") <= most))))
    pieces = [r["piece"] for r in ends.filter(wanted).select("piece").collect()]  # a few for each of the rules
    rows = spark.read.option("basePath", f"{path}/pieces")
    if not pieces:
        return rows.parquet(f"{path}/pieces").limit(0)
    found = rows.parquet(*(f"{path}/pieces/piece={p}" for p in sorted(pieces)))
    return found.filter(F.col("rule").isin(rules) & (F.col("rank") <= most))
