"""Named collections of rows in a folder that driver and executors share: made anew, appended to, merged by key, read.

A collection is a folder of numbered versions, each a Parquet table that is whole once Spark's `_SUCCESS` file is there.
Writers make the next version and then delete the older ones but the last, so a reader of the last one is not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


class Missing(LookupError):
    """There is no collection of that name."""


class Collections:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _versions(self, name: str) -> list[int]:
        home = self._path(name)
        store = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(home):
            return []
        found = [f.getPath().getName() for f in store.listStatus(home)]
        return sorted(int(v) for v in found if v.isdigit() and store.exists(self._path(name, v, "_SUCCESS")))

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        old = self._versions(name)
        new = (old[-1] if old else 0) + 1
        rows.write.parquet(f"{self.folder}/{name}/{new}")
        store = self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in old[:-1]:
            store.delete(self._path(name, str(v)), True)
        return self.get(name)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def recreate(self, name: str, rows: DataFrame) -> DataFrame:
        """The collection with these rows alone, whatever it held."""
        return self._write(name, rows)

    def get_or_create(self, name: str, schema: str) -> DataFrame:
        """The collection; an empty one of that schema if there is none."""
        return self.get(name) if self.exists(name) else self._write(name, self.spark.createDataFrame([], schema))

    def get(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            raise Missing(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/{found[-1]}")

    def upsert(self, name: str, rows: DataFrame, key: str, order: str) -> DataFrame:
        """Rows by key; the last of these by `order` replaces what is there."""
        return self._write(name, tables.upserted(self.get(name), rows, key, order))

    def insert(self, name: str, rows: DataFrame, key: str, order: str) -> DataFrame:
        """Rows by key; what is there stays."""
        return self._write(name, tables.inserted(self.get(name), rows, key, order))

    def by_ids(self, name: str, ids: DataFrame, key: str) -> DataFrame:
        return self.get(name).join(ids, key, "left_semi")

    def where(self, name: str, condition: Column) -> DataFrame:
        return self.get(name).filter(condition)


def write_index(nested: DataFrame, path: str) -> None:
    """A rule index, as rule_index.nested gives it, as one JSON object a line."""
    nested.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index as rows of rule_index.rule_index; none if it isn't there."""
    schema = "rule string, entries array<struct<rank:int,chunk_id:string,doc_type:string,priority:int,source_file:string,content_type:string,secondary:boolean>>"
    return tables.json_or_empty(spark, path, schema, multi_line=False).select("rule", F.inline("entries"))


_PROFILE = "game_name string, game_id string, rule_schema string, rule_pattern string, cross_ref_pattern string, scenario_format string, scenario_confidence double, schema_detection_scores map<string,bigint>, documents array<struct<source_file:string,doc_type:string,priority:int,description:string>>, glossary array<string>"


def write_json(row: DataFrame, path: str) -> None:
    """A profile, entities or an ontology as JSON."""
    row.write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str) -> dict:
    """A written profile with its patterns checked."""
    from ..functions import text

    rows = tables.json_or_empty(spark, path, _PROFILE, multi_line=False).collect()  # one
    if not rows:
        raise Missing(path)
    found = rows[0].asDict(recursive=True)
    return found | text.checked_patterns(spark, found)
