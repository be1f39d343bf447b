"""Table and word-list sources, and sinks."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table under this size and of fewer files than cores may lie in one row group, which one task would read.
SPREAD_BELOW_BYTES = 256 << 20


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One Parquet table of a folder, lazily."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def size_in_bytes(df: DataFrame) -> int:
    """The optimiser's estimate; nothing is read for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small input in few files to all cores before heavy work on each row; leaves any other where it is.

    The choice rests on the optimiser's estimate of the bytes and on the number of files, so nothing is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_in_bytes(df) < SPREAD_BELOW_BYTES and len(df._jdf.inputFiles()) < cores else df


def partitions(df: DataFrame) -> int:
    """How many partitions a table has, at least one; only planned where the plan tells, as counting those of a shuffled table
    would run it."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    planned = plan.outputPartitioning().numPartitions()
    return max(1, planned or df.rdd.getNumPartitions())


def read_word_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one word per line as (word). Bytes that are not UTF-8 are removed from their line."""
    return spark.read.text(path).select(F.regexp_replace("value", "\ufffd", "").alias("word"))


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows) of a Parquet file or folder, from the footers."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


@contextmanager
def temp_table(df: DataFrame, name: str, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keeps a table as a temporary view of that name, computed once, while the block runs; both are dropped at its end.
    What an executor loses is computed anew."""
    kept = df.persist(level)
    kept.createOrReplaceTempView(name)
    try:
        yield kept
    finally:
        df.sparkSession.catalog.dropTempView(name)
        kept.unpersist()


def write_table(df: DataFrame, path: str) -> str:
    """Writes by suffix, ``.parquet`` or ``.csv``; anything else is a ValueError. Array columns are joined for CSV."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        flat = {c: F.array_join(c, " ") for c, kind in df.dtypes if kind.startswith("array")}
        df.withColumns(flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"{path}: expected .parquet or .csv")
    return path


def parquet_to_csv(spark: SparkSession, path: str) -> str:
    """Writes a CSV beside a Parquet file; FileNotFoundError if there is none."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return write_table(spark.read.parquet(path), path.removesuffix(".parquet") + ".csv")


# Fixed value: the columns of the run log.
RUN_LOG = ["engine", "elapsed_seconds", "top_word", "top_views"]


def append_run_log(path: str, engine: str, seconds: float, top: tuple[str, int] | None) -> None:
    """Appends a line to the driver's CSV run log; writes the header first if the file is new or empty."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        if new:
            out.writerow(RUN_LOG)
        out.writerow([engine, f"{seconds:.6f}", *(top or ("", ""))])
