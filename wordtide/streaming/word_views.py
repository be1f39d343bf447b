"""Word totals over a stream of rows: the same transformation, kept up to date by a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordtide.operators.wordviews import explode_words


def streaming_word_views(stream: DataFrame, vocabulary: DataFrame | None = None, text: str = "desc", metric: str = "views") -> DataFrame:
    """(word, total_views) so far, for a complete or update sink. State is one row a word, bounded by the vocabulary."""
    rows = stream.select(metric, text).where(F.col(text).isNotNull() & F.col(metric).isNotNull())
    tokens = explode_words(rows, text, metric)
    if vocabulary is not None:
        tokens = tokens.join(vocabulary, "word", "left_semi")
    return tokens.groupBy("word").agg(F.sum(metric).alias("total_views"))


def windowed_word_views(
    stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 day", text: str = "desc", metric: str = "views"
) -> DataFrame:
    """(start, word, total_views) per window of event time, for an append sink; rows later than ``late`` are left out."""
    rows = stream.where(F.col(text).isNotNull() & F.col(metric).isNotNull()).withWatermark(time, late)
    tokens = explode_words(rows, text, time, metric)
    totals = tokens.groupBy(F.window(time, window).alias("w"), "word").agg(F.sum(metric).alias("total_views"))
    return totals.select(F.col("w.start").alias("start"), "word", "total_views")


def to_memory(totals: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what is there now and ends; the totals are then the table ``name``."""
    return totals.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
