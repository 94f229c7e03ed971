"""How a module registers its queries: a function on (spark, sf_dir), with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.functions[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of a window over whole keys. Sorts hold all of them.
TASK_ROWS = 250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys, in tasks of about TASK_ROWS rows. Spark would join small partitions into tasks that grow with the table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // TASK_ROWS)), *keys)
