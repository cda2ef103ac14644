"""Tables by key that are merged on reading: a batch costs what it holds, not what the table holds.

A table is a folder. `data/<n>` has the rows of write n in one folder for each bucket of a key; `manifest/<n>.json` names,
for each bucket, the write that is its base and the later ones that are its deltas. A write stores its rows, then its
manifest by a rename that fails if another writer was first. Readers take the last manifest: the base's rows whose key no
delta has, and of each key in deltas the row of the last write, unless that is a tombstone. Compaction makes new bases of
buckets that have deltas, and leaves the others alone. Files go once two newer manifests no longer name them, so a reader
of the last one is not disturbed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collections import Missing


class Conflict(RuntimeError):
    """Another writer has written in the meantime; read again and repeat."""


class Merged:
    """One table; rows without a key are one key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    @property
    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, what: str) -> list[int]:
        home = self._path(what)
        return sorted(int(n) for f in self._store.listStatus(home) if (n := f.getPath().getName().split(".")[0]).isdigit()) if self._store.exists(home) else []

    def _manifest(self, n: int | None = None) -> dict:
        if n is None:
            found = self._numbers("manifest")
            if not found:
                raise Missing(self.folder)
            n = found[-1]
        stream = self._store.open(self._path("manifest", f"{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        n = manifest["n"]
        draft, final = self._path("manifest", f".{n}-{id(manifest)}"), self._path("manifest", f"{n}.json")
        out = self._store.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._store.exists(final) or not self._store.rename(draft, final):
            self._store.delete(draft, False)
            raise Conflict(f"write {n} of {self.folder}")
        numbers = self._numbers("manifest")
        for old in numbers[:-2]:
            self._store.delete(self._path("manifest", f"{old}.json"), False)
        named = {w for k in numbers[-2:] for own in self._manifest(k)["writes"].values() for w in own}
        for w in self._numbers("data"):
            if w not in named and w < n:
                self._store.delete(self._path("data", str(w)), True)

    def _bucket(self, manifest: dict, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")

    def _write(self, rows: DataFrame, manifest: dict, gone: Column) -> tuple[int, list[int]]:
        """The number of the write, and the buckets that it has rows of."""
        n = max([manifest["n"], *self._numbers("data")]) + 1
        columns = [f.name for f in T.StructType.fromJson(manifest["schema"]).fields]
        rows.select(*columns, gone.alias("__gone"), self._bucket(manifest, F.col(manifest["key"])).alias("__bucket")).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/data/{n}")
        names = [f.getPath().getName() for f in self._store.listStatus(self._path("data", str(n)))]
        return n, sorted(int(x.split("=")[1]) for x in names if x.startswith("__bucket=") and x.split("=")[1].isdigit())

    def exists(self) -> bool:
        return bool(self._numbers("manifest"))

    def create(self, rows: DataFrame, key: str, buckets: int = 16) -> None:
        """The table with these rows, whose keys differ, whatever it held."""
        last = self._numbers("manifest")
        manifest = {"n": last[-1] if last else 0, "key": key, "buckets": buckets, "schema": json.loads(rows.schema.json())}
        n, there = self._write(rows, manifest, F.lit(False))
        self._commit(manifest | {"n": n, "writes": {str(b): [n] for b in there}})

    def _append(self, manifest: dict, rows: DataFrame, gone: Column) -> None:
        n, there = self._write(rows, manifest, gone)
        writes = {b: list(own) for b, own in manifest["writes"].items()}
        for b in there:
            writes.setdefault(str(b), []).append(n)
        self._commit(manifest | {"n": n, "writes": writes})

    def upsert(self, rows: DataFrame, order: str) -> None:
        """Rows by key; the last of these by `order` replaces what is there."""
        manifest = self._manifest()
        last = rows.groupBy(manifest["key"]).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        self._append(manifest, last, F.lit(False))

    def insert(self, rows: DataFrame, order: str) -> None:
        """Rows by key; what is there stays, and of new keys the first row by `order` is kept. Keys are read of the buckets
        that the rows fall in."""
        manifest = self._manifest()
        key = manifest["key"]
        first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        there = self._read(manifest, self._buckets_of(manifest, rows)).select(F.col(key).alias("__there"))
        self._append(manifest, first.join(there, F.col(key).eqNullSafe(F.col("__there")), "left_anti"), F.lit(False))

    def delete(self, keys: DataFrame) -> None:
        """Takes rows of these keys out, by tombstones."""
        manifest = self._manifest()
        fields = T.StructType.fromJson(manifest["schema"]).fields
        rows = keys.select(manifest["key"]).distinct()
        self._append(manifest, rows.select(*(F.col(f.name) if f.name == manifest["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in fields)), F.lit(True))

    def _buckets_of(self, manifest: dict, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(manifest, F.col(manifest["key"]))).distinct().collect()]  # as many as buckets at most

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema, key = T.StructType.fromJson(manifest["schema"]), manifest["key"]
        stored = T.StructType([*schema.fields, T.StructField("__gone", T.BooleanType())])
        paths: dict[tuple[bool, int], list[str]] = {}
        for b, own in manifest["writes"].items():
            if buckets is None or int(b) in buckets:
                for k, w in enumerate(own):
                    paths.setdefault((k == 0, w), []).append(f"{self.folder}/data/{w}/__bucket={b}")

        def rows(is_base: bool) -> DataFrame:
            out = self.spark.createDataFrame([], T.StructType([*stored.fields, T.StructField("__n", T.IntegerType())]))
            for (base, w), own in sorted(paths.items()):
                if base == is_base:
                    out = out.unionByName(self.spark.read.schema(stored).parquet(*own).withColumn("__n", F.lit(w)))
            return out

        columns = [f.name for f in schema.fields]
        old = rows(True).filter("not __gone").select(columns)
        if all(base for base, _ in paths):
            return old
        new = rows(False).groupBy(key).agg(F.max_by(F.struct(*columns, "__gone"), "__n").alias("r")).select("r.*")
        told = new.select(F.col(key).alias("__told"))
        return old.join(told, F.col(key).eqNullSafe(F.col("__told")), "left_anti").unionByName(new.filter("not __gone").select(columns))

    def get(self) -> DataFrame:
        return self._read(self._manifest())

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """The rows of these keys; other buckets are not read."""
        manifest = self._manifest()
        key = manifest["key"]
        wanted = ids.select(F.col(key).alias("__wanted")).distinct()
        return self._read(manifest, self._buckets_of(manifest, ids)).join(wanted, F.col(key).eqNullSafe(F.col("__wanted")), "left_semi")

    def compact(self) -> list[int]:
        """Makes new bases of the buckets that have deltas, and says which."""
        manifest = self._manifest()
        old = [int(b) for b, own in manifest["writes"].items() if len(own) > 1]
        if not old:
            return []
        n, there = self._write(self._read(manifest, old), manifest, F.lit(False))
        writes = {b: own for b, own in manifest["writes"].items() if int(b) not in old} | {str(b): [n] for b in there}
        self._commit(manifest | {"n": n, "writes": writes})
        return sorted(old)
