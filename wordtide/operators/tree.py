"""Aggregation of keys of which a few hold most rows.

Partial states are merged in rounds of a fixed fan-in. The input's partitions, splits of a fixed number of bytes where files
are read, are the chunks: rows are combined where they are read, into at most one state of a key in each chunk. The first
round groups by (key, branch), the chunk's number divided by the fan-in. A state that stands for many rows goes through more
rounds, each with a fan-in-th of the branches, until one is left: their number is the logarithm of the number of chunks, and
no reducer ever receives more than ``fan_in`` such states of one key. A state of few rows, as nearly all keys have, goes to
the last round at once, so that it is moved twice however many rounds there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.sources.tables import partitions, spread

#: States of a key that one reducer merges, whatever the number of chunks.
FAN_IN = 4
#: A state that stands for fewer rows is light.
LIGHT_ROWS = 256
#: Integers that can be packed with a row's id into one number.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_SHIFT = 10**19
_LEAST_ROW = -(_SHIFT - (1 << 63))


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    init: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    fan_in: int = FAN_IN,
    weight: str | None = None,
    light: int = LIGHT_ROWS,
) -> DataFrame:
    """(keys, states): one row per key, null keys being keys like others.

    ``init`` are aggregates from rows to states, ``merge`` associative aggregates from states of the same name to a state;
    ``weight`` names the state that counts rows. Without it all states go through all rounds, ``ceil(log(chunks, fan_in))``
    of them. An empty input gives an empty result. Other columns are not carried along.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    chunks = partitions(df)
    branch = "_branch"
    while branch in df.columns or branch in init:
        branch += "_"
    merged = lambda level, by: level.groupBy(*by).agg(*[merge[n](n).alias(n) for n in init])
    if chunks == 1:  # each key has one state
        return df.groupBy(*keys).agg(*[a.alias(n) for n, a in init.items()])
    level = df.withColumn(branch, F.floor(F.spark_partition_id() / fan_in).cast("int"))
    level = level.groupBy(*keys, branch).agg(*[a.alias(n) for n, a in init.items()])
    chunks = -(-chunks // fan_in)
    done = []
    if weight and chunks > fan_in:
        done.append(level.where(F.col(weight) < light))
        level = level.where(F.col(weight) >= light)
    while chunks > fan_in:
        chunks = -(-chunks // fan_in)
        level = merged(level.withColumn(branch, F.floor(F.col(branch) / fan_in).cast("int")), [*keys, branch])
    return merged(reduce(DataFrame.unionByName, done, level), keys)


def per_key(df: DataFrame, key: str = "desc", row: str = "row_id", metric: str = "views", with_key: bool = True, **kw) -> DataFrame:
    """(key, n_rows, first_row, top_row, total, highest) for every non-null key.

    ``top_row`` is the row with the highest metric: nulls rank below all others, ties go to the smaller row. ``total`` and
    ``highest`` are null where all metrics are; totals of whole numbers are decimals, as they may exceed 64 bits. Keys are told apart by two 64-bit hashes, so that rounds move numbers and
    not texts; the texts are brought in at the end, unless ``with_key`` is off. For whole numbers all states are numbers too,
    which Spark aggregates by hash: (metric, -row) is packed into one. Ids from -7.7e17 on can be packed, others raise.
    """
    rows = df.select(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), F.col(key)).alias("k2"), F.col(row).alias("r"), F.col(metric).alias("m"), F.col(key).alias("key"))
    rows = spread(rows.where(F.col("key").isNotNull()))
    kinds = dict(rows.dtypes)
    packed = kinds["m"] in _WHOLE and kinds["r"] in _WHOLE
    shift = F.lit(str(_SHIFT)).cast("decimal(20,0)")
    if packed:
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        fits = F.when(F.col("r") >= _LEAST_ROW, (wide("m") * shift).cast("decimal(38,0)") - wide("r")).otherwise(F.raise_error(F.lit("ids below -7.7e17 can't be packed")))
        best = F.max(fits.cast("decimal(38,0)"))
    else:
        best = F.max(F.when(F.col("m").isNotNull(), F.struct("m", (-F.col("r")).alias("r"))))
    states = {"n_rows": F.count(F.lit(1)), "first_row": F.min("r"), "best": best, "total": F.sum(F.col("m").cast("decimal(38,0)") if kinds["m"] in _WHOLE else "m"), "highest": F.max("m")}
    merge = {"n_rows": F.sum, "first_row": F.min, "best": F.max, "total": F.sum, "highest": F.max}
    out = tree_aggregate(rows.select("k1", "k2", "r", "m"), ["k1", "k2"], states, merge, weight="n_rows", **kw)
    top = (wide("highest") * shift).cast("decimal(38,0)") - F.col("best") if packed else -F.col("best.r")
    top = F.coalesce(top.cast(kinds["r"]), F.col("first_row")).alias("top_row")
    kept = ("n_rows", "first_row", top, "total", "highest")
    if not with_key:
        return out.select(*kept)
    texts = rows.groupBy("k1", "k2").agg(F.first("key").alias("key"))
    return out.join(texts, ["k1", "k2"]).select(F.col("key").alias(key), *kept)
