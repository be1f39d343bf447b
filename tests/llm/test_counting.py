"""Problems 1 and 2, and every training query with SQL on the driver's tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from differential import compare, duck
from wordtide.llm import heavy_hitters as HH
from wordtide.llm import queries as Q
from wordtide.llm import term_frequency as TF

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.SQL))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01" if name == "p9_invariants" else SMALL  # the mix asks for more than the smallest table has
    assert compare(spark, duck(folder), name, Q.QUERIES[name], Q.SQL[name], folder) == ""


def test_term_frequency(spark):
    rows = [(["b", "a", "b"], 1), (["b"], 2), ([], 3), (None, 4), ([None, "c"], 5), (["b", "a", "b"], 1)]
    df = spark.createDataFrame(rows, "t array<string>, term int")
    got = {r.term: (r.occurrences, r.records) for r in TF.term_frequency(df, F.col("t")).collect()}
    assert got == {"a": (2, 2), "b": (5, 3), "c": (1, 1)}
    assert TF.term_frequency(df.where("false"), F.col("t")).collect() == []


def test_marks(spark):
    df = spark.createDataFrame([("one two",)] * 50 + [("one",)] * 50 + [("six",), ("six six",), ("ten",), (None,), ("",)], "desc string")
    got = {r.term: r.mark for r in TF.desc_terms(df, common_at_least=0.6).collect()}
    assert got == {"one": "common", "two": None, "six": "rare", "ten": "rare"}
    assert TF.desc_terms(df.where("false")).collect() == []


def test_reduce_keeps_the_guarantee():
    counts = np.array([50, 9, 8, 7, 1])
    values = np.array(list("abcde"), dtype=object)
    v, c = HH.reduce_summary(values, counts, 2)
    assert list(v) == ["a", "b"] and list(c) == [42, 1]
    assert HH.reduce_summary(values[:2], counts[:2], 2)[1].tolist() == [50, 9]


def test_summary_bounds(spark):
    rng = np.random.default_rng(1)
    words = [f"w{int(i)}" for i in np.minimum(rng.zipf(1.3, 20_000), 10**6)] + [None] * 50 + [""] * 400
    weights = [int(x) for x in rng.integers(0, 1000, len(words))]
    df = spark.createDataFrame(list(zip(words, weights)), "value string, w long").repartition(7)
    n, k = sum(w is not None for w in words), 50
    exact = Counter(w for w in words if w is not None)
    got = {r.value: int(r.n) for r in HH.summaries(df, "value", "w", k).where("measure = 'rows'").collect()}
    assert len(got) <= k and all(exact[v] - n / (k + 1) <= c <= exact[v] for v, c in got.items())
    assert {v for v, c in exact.items() if c > n / (k + 1)} <= set(got)


def test_heavy_hitters(spark):
    data = [("hot", 1)] * 300 + [(f"v{i}", None) for i in range(600)] + [("rich", 10**15), ("", -5), (None, 10**18)] + [("", 0)] * 30
    df = spark.createDataFrame(data, "desc string, views long").repartition(9).withColumn("value", F.lit("x")).withColumn("w", F.lit(1))
    got = {(r.measure, r.value): (r.n_rows, int(r.total)) for r in HH.heavy_hitters(df, "desc", "views", 0.02).collect()}
    assert got == {("rows", "hot"): (300, 300), ("rows", ""): (31, 0), ("weight", "rich"): (1, 10**15)}
    assert HH.heavy_hitters(df.where("false"), "desc", "views").collect() == []
    assert {r.measure for r in HH.heavy_hitters(df, "desc", None, 0.02).collect()} == {"rows"}


def test_weights_beyond_64_bits(spark):
    """Sums of a batch that exceed 64 bits, and unsigned weights above 2**63."""
    for kind, big in (("long", 6 * 10**18), ("decimal(20,0)", 18 * 10**18)):
        df = spark.createDataFrame([("a", str(big)), ("a", str(big)), ("b", "1"), ("c", None), ("d", "-4")], "desc string, w string").coalesce(1)
        df = df.select("desc", F.col("w").cast(kind).alias("views"))
        got = {r.value: (int(r.total), int(r.approximate)) for r in HH.heavy_hitters(df, "desc", "views").where("measure = 'weight'").collect()}
        assert got == {"a": (2 * big, 2 * big)}
