"""Roll-ups of evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_category(results: DataFrame, passed: dict[str, Column], category: str = "category") -> DataFrame:
    """Each category and OVERALL: rows, and how many of each kind passed."""
    sums = [F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in passed.items())]
    return results.rollup(category).agg(F.grouping(category).alias("g"), *sums).select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col(category)).alias(category), "total", *passed)


def keyword_recall(results: DataFrame) -> DataFrame:
    """found, expected and the share of found; keywords_found and keywords_missing are arrays."""
    sums = results.agg(F.sum(F.size("keywords_found")).cast("bigint").alias("found"), F.sum(F.size("keywords_found") + F.size("keywords_missing")).cast("bigint").alias("expected"))
    return sums.withColumn("recall", F.round(F.col("found") / F.greatest("expected", F.lit(1)), 6))


def grades(results: DataFrame, kinds: tuple[str, ...] = ("EXACT", "FAITHFUL", "CITED", "FAIL"), gate: float = 95.0, passing: tuple[str, ...] = ("EXACT", "FAITHFUL", "CITED")) -> DataFrame:
    """Grades of each system and OVERALL, the percentage that passes, and whether it reaches the gate."""
    found = by_category(results, {k: F.col("grade") == k for k in kinds}, "system")
    rate = F.round(100 * sum((F.col(k) for k in passing), F.lit(0)) / F.col("total"), 4)
    return found.withColumn("pass_rate", rate).withColumn("gate", F.col("pass_rate") >= gate)


def unfinished(cases: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Cases that the log has no row for."""
    return cases.join(log.select(key), key, "left_anti")


def hint_in_top(sources: Column, hint: Column, k: int = 5) -> Column:
    return F.exists(F.slice(sources, 1, k), lambda s: F.instr(F.lower(s), F.lower(hint)) > 0)


def run_suites(spark, suites: dict) -> DataFrame:
    """suite, status, cases, seconds and error of each suite, a function that gives the rows of its results; one that fails
    doesn't stop the others. It writes nothing, and a suite's rows are only counted."""
    import time

    found = []
    for name, suite in suites.items():
        began = time.time()
        try:
            found.append((name, "PASSED", suite().count(), time.time() - began, None))
        except Exception as e:  # a suite may fail in any way
            found.append((name, "FAILED", None, time.time() - began, str(e)[:500]))
    return spark.createDataFrame(found, "suite string, status string, cases long, seconds double, error string")
