"""Vocabulary and stopwords as one-column relations (word)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions import patterns as P
from wordtide.sources.tables import size_in_bytes

#: A word list whose files are larger is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 16 << 20
#: A row's words are compared with a list of at most so many as an array; longer lists are joined.
ARRAY_WORDS = 4096
#: A word list under this size is worked on in one task, which spares its distinct and its join the shuffles.
ONE_TASK_BYTES = 4 << 20


def _gathered(lines: DataFrame) -> DataFrame:
    return lines.coalesce(1) if size_in_bytes(lines) < ONE_TASK_BYTES else lines


def normalise(lines: DataFrame, column: str = "word", min_length: int = 3) -> DataFrame:
    """Raw lines to distinct lower-case words: trimmed, ASCII letters only, at least ``min_length`` of them.

    Null and blank lines vanish; other columns are dropped.
    """
    space = f"[{P.SPACES}]+"
    word = F.regexp_replace(F.col(column), rf"\A{space}|{space}\z", "")
    return (
        _gathered(lines).select(word.alias("word"))
        .where(F.col("word").rlike(rf"\A[A-Za-z]{{{int(min_length)},}}\z"))
        .select(F.lower("word").alias("word"))
        .distinct()
    )


def vocabulary(lines: DataFrame, stopwords: DataFrame | None = None, min_length: int = 3) -> DataFrame:
    """Normalised words without the normalised stopwords, if any are given."""
    words = normalise(lines, min_length=min_length)
    return words if stopwords is None else words.join(normalise(stopwords, min_length=min_length), "word", "left_anti")


def sized(words: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks the words for broadcast if the files they come from are small enough; nothing is read for it."""
    return F.broadcast(words) if size_in_bytes(words) <= limit else words


def known_words(rows: DataFrame, tokens: Column, words: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): the distinct tokens of each row that are in the word list, in order of the words; rows may have none.

    A short list is one array, read once for the query, with which each row's tokens are intersected where they are; with a
    longer one the tokens are joined and gathered again by the key.
    """
    if words.limit(ARRAY_WORDS + 1).count() <= ARRAY_WORDS:
        listed = words.agg(F.sort_array(F.collect_set("word"))).scalar()
        return rows.select(key, F.coalesce(F.array_intersect(listed, tokens), F.array().cast("array<string>")).alias(out))
    each = rows.select(key, F.explode_outer(F.array_distinct(tokens)).alias("word"))
    found = each.join(sized(words.withColumn("_in", F.lit(1))), "word", "left")
    return found.groupBy(key).agg(F.sort_array(F.collect_set(F.when(F.col("_in") == 1, F.col("word")))).alias(out))
