"""Problem 1: how often every term occurs, and in how many records.

Every record emits a count for each of its distinct terms: its terms are sorted, and a term's count is the distance between
the first places of it and of the next. Spark combines these rows by hash inside each task before the shuffle; what moves is
one row per distinct term and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions import text as T


def term_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, occurrences, records) over all records; ``terms`` is an array column.

    Null and empty arrays add nothing, null terms are skipped, an empty table gives an empty result. Other columns of the
    table are not looked at, whatever their names.
    """
    # Sorting without a comparator stays in generated code; each step is a column of its own, which is evaluated once.
    listed, all_ = df.select(F.sort_array(terms).alias("_terms")), F.col("_terms")
    new = F.transform(all_, lambda t, i: F.when((i == 0) | ~F.get(all_, i - 1).eqNullSafe(t), i))
    listed, starts = listed.select(all_, F.array_compact(new).alias("_starts")), F.col("_starts")
    counts = F.transform(starts, lambda at, i: F.struct(F.get(all_, at).alias("term"), (F.coalesce(F.get(starts, i + 1), F.size(all_)) - at).alias("n")))
    rows = listed.select(F.inline(counts)).where(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def mark(counts: DataFrame, n_records: int, rare_at_most: int = 2, common_at_least: float = 0.05) -> DataFrame:
    """Adds ``mark``: rare, common, or null for the terms of use. A term that is both counts as rare."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= common_at_least * n_records, "common"),
    )


def desc_terms(df: DataFrame, text: str = "desc", rare_at_most: int = 2, common_at_least: float = 0.05) -> DataFrame:
    """(term, occurrences, records, mark) of the words of a text column; shares are of the rows whose text is not null."""
    n = df.agg(F.count(text)).first()[0]
    return mark(term_frequency(df.select(text), T.tokenize(F.col(text))), n, rare_at_most, common_at_least)
