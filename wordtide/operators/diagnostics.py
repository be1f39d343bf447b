"""Attribution of a word's total, and comparison of two variants of the tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordtide.functions import text as T
from wordtide.sources.tables import spread


def word_rows(df: DataFrame, word: str, key: str = "row_id", text: str = "desc", metric: str = "views") -> DataFrame:
    """(key, metric, text) of the rows whose tokens hold the word. The substring test is done first, being cheap."""
    near = df.select(key, metric, text).where(F.col(text).isNotNull() & F.col(metric).isNotNull())
    near = spread(near.where(F.contains(T.ascii_fold(F.col(text)), F.lit(word))))
    return near.where(F.array_contains(T.tokenize(F.col(text)), word))


#: Variants of the tokenizer: one alternation after the first payload is gone; kind by kind after all payloads are; one
#: alternation on the text before its first payload.
VARIANTS = {"fused": T.clean, "sequential": T.clean_sequential, "to_end": T.clean_to_end}
PAIRS = (("fused", "sequential"), ("fused", "to_end"), ("sequential", "to_end"))
#: Difference tables of attribution: what the first has and the second lacks.
DIFFERENCES = {
    "fused_only": ("fused", "sequential"),
    "sequential_only": ("sequential", "fused"),
    "to_end_only_vs_fused": ("to_end", "fused"),
    "to_end_only_vs_sequential": ("to_end", "sequential"),
    "sequential_only_vs_to_end": ("sequential", "to_end"),
}


def _attributed(df: DataFrame, word: str, key: str, text: str, metric: str) -> DataFrame:
    """(key, metric, text, and a flag for each variant) of the rows that may hold the word."""
    near = df.select(key, metric, text).where(F.col(text).isNotNull() & F.col(metric).isNotNull())
    near = spread(near.where(F.contains(T.ascii_fold(F.col(text)), F.lit(word))))
    return near.withColumns({f"in_{v}": F.array_contains(T.words(clean(F.col(text))), word) for v, clean in VARIANTS.items()})


def attribution(df: DataFrame, word: str, key: str = "row_id", text: str = "desc", metric: str = "views") -> DataFrame:
    """One row: the word, the rows and their metric that each variant attributes to it, and the size of each difference."""
    flags = _attributed(df, word, key, text, metric)
    views = lambda v: F.coalesce(F.sum(F.when(F.col(f"in_{v}"), F.col(metric))), F.lit(0)).cast("bigint")
    out = [F.lit(word).alias("word")]
    for v in VARIANTS:
        out += [F.count_if(f"in_{v}").alias(f"n_{v}"), views(v).alias(f"views_{v}")]
    return flags.agg(*out, *[F.count_if(F.col(f"in_{a}") & ~F.col(f"in_{b}")).alias(n) for n, (a, b) in DIFFERENCES.items()])


def difference_rows(df: DataFrame, word: str, key: str = "row_id", text: str = "desc", metric: str = "views") -> DataFrame:
    """(key, metric, text, difference): the rows of the five difference tables, each as an anti join of two variants' rows would
    give it. The variants' flags stand beside each other in a row, so nothing is joined."""
    flags = _attributed(df, word, key, text, metric)
    named = F.array_compact(F.array(*[F.when(F.col(f"in_{a}") & ~F.col(f"in_{b}"), n) for n, (a, b) in DIFFERENCES.items()]))
    return flags.select(key, metric, text, F.explode(named).alias("difference"))


def variants(df: DataFrame, key: str = "row_id", text: str = "desc", metric: str = "views") -> DataFrame:
    """(key, metric, text, the signature of each variant's tokens, a flag for each pair of variants that differ, differ) for
    every row with text."""
    rows = spread(df.select(key, metric, text).where(F.col(text).isNotNull()))
    cleaned = rows.withColumns({f"_{v}": clean(F.col(text)) for v, clean in VARIANTS.items()})
    # A generator of one row keeps filters on the flags from repeating all cleaning in their conditions.
    made = F.struct(*[T.signature(T.words(F.col(f"_{v}"))).alias(f"tokens_{v}") for v in VARIANTS])
    rows = cleaned.select(key, metric, text, F.inline(F.array(made)))
    rows = rows.withColumns({f"{a}_vs_{b}": F.col(f"tokens_{a}") != F.col(f"tokens_{b}") for a, b in PAIRS})
    return rows.withColumn("differ", F.col(f"{PAIRS[0][0]}_vs_{PAIRS[0][1]}") | F.col(f"{PAIRS[1][0]}_vs_{PAIRS[1][1]}") | F.col(f"{PAIRS[2][0]}_vs_{PAIRS[2][1]}"))


def mismatch_sample(df: DataFrame, n: int = 5000, key: str = "row_id", text: str = "desc", metric: str = "views") -> DataFrame:
    """Up to n distinct texts on which any variants differ, each by its first row, in order of the key."""
    differing = variants(df, key, text, metric).where("differ").drop("differ")
    return first_by_text(differing, key, text).orderBy(key).limit(n)


def first_by_text(df: DataFrame, key: str = "row_id", text: str = "desc") -> DataFrame:
    """One row per distinct text, the one with the smallest key. Aggregates before the shuffle, so a hot text is no burden."""
    rest = [c for c in df.columns if c != text]
    best = F.min_by(F.struct(*rest), F.col(key)).alias("_row")
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(best).select(*[F.col(f"_row.{c}").alias(c) if c != text else F.col(text) for c in df.columns])


def last_delivery(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per (video_id, desc): the latest crawled; ties go to the smaller key."""
    order = W.partitionBy("video_id", "desc").orderBy(F.col("crawled_at").desc_nulls_last(), F.col(key))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
