"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TASK = 200_000  # rows that a task writes, where a bound of the rows is known


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, as in tests on one machine, an own folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Named Parquet tables under the shared folder: a job that loses executors rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: list[DataFrame] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str, most: int | None = None, per_task: int = TASK) -> DataFrame:
        """df, written and read again, with its number of rows (0 exactly if there are none) as ``rows_``.

        most: a bound of its rows; so many tasks write it that each has per_task of them, so a
        small table doesn't become hundreds of files, whatever the number of shuffle partitions.
        """
        path, seen = self.path(name), Observation()
        if most is not None:
            df = df.coalesce(max(1, -(-most // per_task)))
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path, out.rows_ = path, seen.get["n"]
        self.tables.append(out)
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Deletes all its tables but the kept ones."""
        stay = {t._scratch_path for t in kept}
        self.drop(*[t for t in self.tables if t._scratch_path not in stay])

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more, and lets Spark forget the shuffles behind them."""
        for t in tables:
            if t is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                self.tables = [x for x in self.tables if x is not t]
        gc.collect()
        self.spark._jvm.System.gc()
