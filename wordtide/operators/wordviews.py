"""Word metrics: which words carry the metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.operators.vocabulary import sized
from wordtide.sources.tables import spread


def not_null(df: DataFrame, text: str = "desc", metric: str = "views") -> DataFrame:
    """(metric, text) of the rows where both are there; the filter reaches the Parquet scan."""
    return df.select(metric, text).where(F.col(text).isNotNull() & F.col(metric).isNotNull())


def explode_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., word): one row per distinct word of each row. Rows without words vanish.

    The clean text is a column of its own below the generator: a projection evaluates what its expressions share once,
    a generator does not.
    """
    cleaned = df.select(*keep, T.clean(F.col(text)).alias("_cleaned"))
    return cleaned.select(*keep, F.explode(F.array_distinct(T.words(F.col("_cleaned")))).alias("word"))


def exploded(df: DataFrame, text: str = "desc", metric: str = "views") -> DataFrame:
    """(metric, word) of the rows where text and metric are there."""
    return explode_words(spread(not_null(df, text, metric)), text, metric)


def word_views(df: DataFrame, vocabulary: DataFrame | None = None, text: str = "desc", metric: str = "views") -> DataFrame:
    """(word, total_views) over all rows; a word repeated in a row counts that row's metric once.

    ``vocabulary`` (word) keeps only its words. One shuffle: the semi join is a broadcast where the vocabulary is small,
    and sums are combined in each task first. Unsigned 64-bit metrics, which Spark reads as decimal, stay decimal.
    """
    tokens = exploded(df, text, metric)
    if vocabulary is not None:
        tokens = tokens.join(sized(vocabulary), "word", "left_semi")
    return tokens.groupBy("word").agg(_total(df, metric).alias("total_views"))


def _total(df: DataFrame, metric: str) -> Column:
    total = F.sum(metric)
    return total.cast("bigint") if dict(df.dtypes)[metric] in ("tinyint", "smallint", "int", "bigint") else total


def top(totals: DataFrame, k: int = 5) -> DataFrame:
    """The k rows with the highest totals; ties go to the smaller word."""
    if k <= 0:
        raise ValueError("k must be positive")
    return totals.orderBy(F.col("total_views").desc(), F.col("word")).limit(k)


def top_words(df: DataFrame, vocabulary: DataFrame | None, k: int = 5, text: str = "desc", metric: str = "views") -> DataFrame:
    return top(word_views(df, vocabulary, text, metric), k)


def merge_partials(partials: list[DataFrame]) -> DataFrame:
    """(word, total_views) from several such results, as batches give them; decimal totals stay decimal."""
    united = partials[0]
    for part in partials[1:]:
        united = united.unionByName(part)
    return united.groupBy("word").agg(_total(united, "total_views").alias("total_views"))
