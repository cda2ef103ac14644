"""Tables of the session's catalog, bucketed and sorted by their key, so that joins by it don't shuffle them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create(spark: SparkSession, name: str, columns: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """The table of that name; a new one of these columns (`name type, ...`) if there is none. Without a path its files are
    in the warehouse."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS{where}")
    return spark.table(name)


def insert_ignore(spark: SparkSession, name: str, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Appends rows whose key the table doesn't have yet; of equal keys the first by `order`. Only the new rows are shuffled:
    keys are compared bucket by bucket."""
    there = spark.table(name)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*there.columns), order).alias("r")).select("r.*")
    first.join(there.select(F.col(key).alias("__there")), F.col(key).eqNullSafe(F.col("__there")), "left_anti").select(there.columns).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
