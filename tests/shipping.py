"""Runs queries in a session whose Python workers can't import the repository: `python shipping.py core|llm`.

Run from an empty folder without PYTHONPATH: the driver alone finds the package, by the path that it adds here.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"


def main(part: str) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__
    from millrace.plans import queries as plans

    conf = {"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{os.getcwd()}/shared"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    def importable(_):
        import importlib.util

        yield importlib.util.find_spec("millrace") is not None

    assert not any(spark.sparkContext.parallelize(range(4), 4).mapPartitions(importable).collect())
    for name, query in __spark_entry__.queries().items():
        if (name in plans.QUERIES) == (part == "core"):
            try:
                query(spark, FOLDER).write.format("noop").mode("overwrite").save()
            except Exception as e:
                print(f"FAILED {name}: {str(e)[:2000]}")
    spark.stop()
    print("DONE")


if __name__ == "__main__":
    main(sys.argv[1])
