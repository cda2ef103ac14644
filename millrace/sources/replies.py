"""A store of a model's replies in a folder that driver and executors share, addressed by content.

A reply's key is a hash of the model's name and the prompt. Each distinct prompt that has no reply yet is sent once,
whatever number of rows asks it; what comes back, replies and errors, is appended as one batch. A prompt that fails
doesn't fail the job: a batch that raises is asked again prompt by prompt, and a prompt's error is kept beside it. Prompts
that have failed are asked again by later calls, `tries` times in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import Model
from .shared import saved

_STORED = "key string, prompt string, reply string, error string, tries int"


class Replies:
    def __init__(self, spark: SparkSession, folder: str, tries: int = 3, size: int = 64):
        self.spark, self.folder, self.tries, self.size = spark, folder.rstrip("/"), tries, size

    def stored(self) -> DataFrame:
        """One row for each key: its reply or, if it has none, its last error, and how often it was sent."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _STORED)
        rows = self.spark.read.schema(_STORED).parquet(self.folder)
        return rows.groupBy("key").agg(F.max("prompt").alias("prompt"), F.max("reply").alias("reply"), F.max_by("error", "tries").alias("error"), F.max("tries").alias("tries"))

    def asked(self, rows: DataFrame, prompt: Column, model: Model, to: str = "reply", error: str = "error", name: str | None = None) -> DataFrame:
        """rows with the reply to each prompt, and the error of those that have none; null prompts are not sent. `name` is
        the model's, by default that of its function."""
        name = name or getattr(model, "__qualname__", type(model).__qualname__)
        key = F.sha2(F.concat(F.lit(f"{name}\n"), F.col("__prompt")), 256)
        kept = rows.drop(to, error).withColumn("__prompt", prompt).withColumn("__key", key)
        there = self.stored().select(F.col("key").alias("__key"), "reply", "tries")
        new = kept.filter(F.col("__key").isNotNull()).groupBy("__key").agg(F.first("__prompt").alias("prompt"))
        new = new.join(there, "__key", "left").filter(F.col("reply").isNull() & (F.coalesce("tries", F.lit(0)) < self.tries))
        self._send(new.select(F.col("__key").alias("key"), "prompt", F.coalesce("tries", F.lit(0)).alias("tries")), model)
        known = self.stored().select(F.col("key").alias("__key"), F.col("reply").alias(to), F.when(F.col("reply").isNull(), F.col("error")).alias(error))
        # stored, for a plan that reads the store's folder as it was at two times would take one reading for the other
        return saved(kept.join(known, "__key", "left").drop("__key", "__prompt"), "asked")

    def _send(self, new: DataFrame, model: Model) -> None:
        size = self.size

        def sent(prompts: list[str]) -> Iterator[tuple[str | None, str | None]]:
            try:
                replies = list(model(prompts))
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                yield from ((r, None if r is not None else "no reply") for r in replies)
            except Exception as e:  # whatever a model raises is kept as its prompts' error
                if len(prompts) > 1:
                    for p in prompts:
                        yield from sent([p])
                else:
                    yield None, f"{type(e).__name__}: {e}"[:1000]

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    some = batch.slice(lo, size)
                    found = list(sent(some.column(1).to_pylist()))
                    tries = [t + 1 for t in some.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array(tries, pa.int32())], names=["key", "prompt", "reply", "error", "tries"])

        # a stage of its own: what is written is decided once, and a lost task sends its own prompts again only
        new.mapInArrow(run, _STORED).write.mode("append").parquet(self.folder)
