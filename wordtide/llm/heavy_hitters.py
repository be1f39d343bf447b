"""Problem 2: the most frequent values of a column, in bounded memory.

Misra-Gries summaries of ``counters`` values: a summary that grows beyond that loses its (counters + 1)-th largest count
from every value, and the values that reach nothing. A count is then too low by at most (total weight) / (counters + 1),
so every value above that share is in the summary. Each task keeps one, whatever the number of its rows; summaries are
merged the same way in rounds of bounded fan-in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordtide.sources.tables import partitions

#: Summaries merged in one task.
FAN_IN = 256
_SCHEMA = "part int, measure string, value string, n decimal(38,0)"


def reduce_summary(values: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``counters`` of distinct values with positive counts, after subtracting the next-largest count from all."""
    if len(counts) > counters:
        counts = counts - np.sort(counts)[-counters - 1]
    keep = counts > 0
    return values[keep], counts[keep]


def _add(summary: pd.Series, values: np.ndarray, counts: np.ndarray, counters: int) -> pd.Series:
    # Python integers: a sum of many weights may exceed 64 bits.
    both = pd.concat([summary, pd.Series(counts, index=values, dtype=object)]).groupby(level=0, sort=False).sum()
    values, counts = reduce_summary(both.index.to_numpy(), both.to_numpy(), counters)
    return pd.Series(counts, index=values, dtype=object)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As 64-bit integers where all fit, else as Python's."""
    try:
        return pc.cast(column, pa.int64()).to_numpy()
    except pa.ArrowInvalid:
        return np.array([int(x) for x in column.to_pylist()], dtype=object)


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {"rows": pd.Series(dtype=object), "weight": pd.Series(dtype=object)}
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            table = pa.table({"value": batch.column("value"), "w": pc.cast(batch.column("w"), pa.decimal128(38, 0))})
            groups = table.group_by("value").aggregate([([], "count_all"), ("w", "sum")])
            values = np.array(groups.column("value").to_pylist(), dtype=object)
            for measure, name in (("rows", "count_all"), ("weight", "w_sum")):
                counts = _numbers(groups.column(name))
                # A batch's own surplus goes the same way first; numbers are still small there.
                v, c = reduce_summary(values, counts, counters)
                parts[measure] = _add(parts[measure], v, c, counters)
        for measure, s in parts.items():
            if len(s):
                n = pa.array([int(x) for x in s.to_numpy()], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(s), pa.int32()), pa.array([measure] * len(s), pa.string()), pa.array(s.index.tolist(), pa.string()), n],
                    names=["part", "measure", "value", "n"],
                )

    return run


def _merge(counters: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.array([int(x) for x in group["n"]], dtype=object)
        s = _add(pd.Series(dtype=object), group["value"].to_numpy(), counts, counters)
        return pd.DataFrame({"part": group["part"].iloc[0], "measure": group["measure"].iloc[0], "value": s.index, "n": s.to_numpy()})

    return run


def _rows(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """(value, w) of the rows with a value; unsigned 64-bit weights, which are read as decimals, stay decimals."""
    kind = "bigint" if not weight or dict(df.dtypes)[weight] in ("tinyint", "smallint", "int", "bigint") else "decimal(38,0)"
    zero = F.lit(0).cast(kind)
    w = F.greatest(F.coalesce(F.col(weight).cast(kind), zero), zero) if weight else zero
    return df.select(F.col(value).alias("value"), w.alias("w")).where(F.col("value").isNotNull())


def summaries(df: DataFrame, value: str, weight: str | None, counters: int) -> DataFrame:
    """(measure, value, n): one merged summary for each of the measures ``rows`` and ``weight``.

    Null values are left out, null and negative weights count as nothing. The empty string is a value like others.
    """
    rows = _rows(df, value, weight)
    chunks = partitions(rows)
    level = rows.withColumn("part", F.spark_partition_id()).mapInArrow(_summarise(counters), _SCHEMA)
    while True:
        chunks = math.ceil(chunks / FAN_IN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        level = level.groupBy("measure", "part").applyInPandas(_merge(counters), _SCHEMA)
        if chunks <= 1:
            return level.select("measure", "value", "n")


def heavy_hitters(df: DataFrame, value: str, weight: str | None = None, share: float = 0.01, counters: int | None = None) -> DataFrame:
    """(measure, value, n_rows, total, approximate): the values with at least ``share`` of all rows or of all weight.

    The summaries name the candidates: with four times 1 / share counters, all values above a quarter of the share. A
    second pass over the rows counts these few exactly; ``approximate`` is the summary's count before it. A value may
    appear under both measures. Empty tables give no rows, and so does a measure that sums to nothing.
    """
    counters = counters or math.ceil(4 / share)
    found = summaries(df, value, weight, counters)
    # Bounded: at most ``counters`` values for each of the two measures.
    wanted = F.broadcast(found.groupBy("value").pivot("measure", ["rows", "weight"]).agg(F.max("n")))
    rows = _rows(df, value, weight)
    joined = rows.join(wanted.select(F.col("value").alias("hit"), "rows", "weight"), F.col("value") == F.col("hit"), "left")
    exact = joined.groupBy("hit").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("w").cast("decimal(38,0)")).alias("total"), F.max("rows").alias("rows"), F.max("weight").alias("weight")
    )
    everything = W.partitionBy()  # over the candidates and one row for all else
    exact = exact.withColumns({"all_rows": F.sum("n_rows").over(everything), "all_total": F.sum("total").over(everything)})
    exact = exact.where(F.col("hit").isNotNull())
    by = lambda measure, approximate: F.struct(F.lit(measure).alias("measure"), F.col(approximate).alias("approximate"))
    enough = F.array(
        F.when(F.col("n_rows") >= F.lit(share) * F.col("all_rows"), by("rows", "rows")),
        F.when((F.col("total") > 0) & (F.col("total") >= F.lit(share) * F.col("all_total")), by("weight", "weight")),
    )
    out = exact.select(F.col("hit").alias("value"), "n_rows", "total", F.explode(F.array_compact(enough)).alias("x"))
    return out.select("x.measure", "value", "n_rows", "total", "x.approximate")
