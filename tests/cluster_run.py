"""Run queries in executors of their own, with `spark.checkpoint.dir` given as a plain path:
python cluster_run.py TABLES OUT NAME..."""

import sys

from pyspark.sql import SparkSession

from cohortry.plans import QUERIES


def main(folder: str, out: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local-cluster[2,1,1024]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.executor.memory", "800m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{out}/warehouse")
        .config("spark.checkpoint.dir", f"{out}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            QUERIES[name](spark, folder).write.parquet(f"{out}/{name}")
        except Exception as error:
            with open(f"{out}/{name}.failed", "w") as f:
                f.write(f"{type(error).__name__}: {error}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], sys.argv[3:])
