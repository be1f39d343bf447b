"""Vocabulary, totals, diagnostics and tree aggregation, with nulls, empty tables, ties, repetitions and clashing columns."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wordtide.functions import patterns as P
from wordtide.operators import diagnostics as D
from wordtide.operators import vocabulary as V
from wordtide.operators import wordviews as W
from wordtide.operators.tree import per_key, tree_aggregate

SCHEMA = "row_id long, desc string, views long, word string, total_views string"
ROWS = [
    (1, "storm storm river", 10, "x", "y"),
    (2, "river @storm", 5, None, None),
    (3, None, 7, None, None),
    (4, "storm", None, None, None),
    (5, "", 3, None, None),
    (6, "lake storm", 0, None, None),
    (7, "RIVER lake", 5, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def words(spark, *listed):
    return spark.createDataFrame([(w,) for w in listed], "word string")


def test_vocabulary(spark):
    lines = words(spark, "  Storm\t", "storm", "a", "né", "x1", "the", "", "co-op", None, " River ", "ｗｉｄｅ", "two words", "tail\n")
    kept = lambda df: sorted(r.word for r in df.collect())
    assert kept(V.vocabulary(lines)) == ["river", "storm", "tail", "the"]
    assert kept(V.vocabulary(lines, words(spark, "THE ", None, ""))) == ["river", "storm", "tail"]
    assert kept(V.normalise(lines, min_length=5)) == ["river", "storm"]
    assert kept(V.vocabulary(lines.where("false"))) == []


def test_totals(spark, rows):
    got = {r.word: r.total_views for r in W.word_views(rows).collect()}
    assert got == {"storm": 10, "river": 20, "lake": 5}
    assert {r.word for r in W.word_views(rows, words(spark, "river", "moon")).collect()} == {"river"}
    assert W.word_views(rows, words(spark, "moon")).collect() == []
    assert W.word_views(rows.where("false")).collect() == []
    assert [f.dataType.simpleString() for f in W.word_views(rows).schema] == ["string", "bigint"]


def test_ties_go_to_the_smaller_word(spark):
    df = spark.createDataFrame([("bbb aaa ccc", 4)], "desc string, views long")
    assert [r.word for r in W.top_words(df, None, 2).collect()] == ["aaa", "bbb"]
    with pytest.raises(ValueError):
        W.top(W.word_views(df), 0)


def test_unsigned_metrics_stay_exact(spark):
    big = Decimal(2**64 - 1)
    df = spark.createDataFrame([("abc", big), ("abc", big)], "desc string, views decimal(20,0)")
    assert W.word_views(df).first().total_views == 2 * big


def test_partials_merge(spark, rows):
    parts = [W.word_views(rows.where(F.col("row_id") % 3 == i)) for i in range(3)]
    whole = {tuple(r) for r in W.word_views(rows).collect()}
    assert {tuple(r) for r in W.merge_partials(parts).collect()} == whole


def test_small_broadcast_is_checked(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/vocabulary.parquet")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(V.sized(V.vocabulary(lines, lines))) and not hinted(V.sized(V.vocabulary(lines, lines), 10))


def test_word_rows_and_attribution(rows):
    assert sorted(r.row_id for r in D.word_rows(rows, "storm").collect()) == [1, 6]
    a = D.attribution(rows, "storm").first()
    assert (a.n_fused, a.views_fused, a.n_sequential, a.n_to_end, a.fused_only, a.sequential_only) == (2, 10, 2, 2, 0, 0)
    assert D.attribution(rows.where("false"), "storm").first().views_fused == 0


def test_variants_flag_differences(spark):
    df = spark.createDataFrame([(1, "@bit.ly/deal😀word", 1), (2, "same", 1), (3, None, 1)], "row_id int, desc string, views int")
    assert {r.row_id: r.differ for r in D.variants(df).collect()} == {1: True, 2: False}
    mark = P.PAYLOAD_MARKER
    two = f"one {mark}abc\nmiddle {mark} hidden\nlast"
    df = spark.createDataFrame([(1, two, 5), (2, f"plain {mark}x", 7), (3, "http://a.example/x none", None), (4, None, 1), (5, "", 2)], "row_id int, desc string, views int")
    got = {r.row_id: (r.fused_vs_sequential, r.fused_vs_to_end, r.sequential_vs_to_end) for r in D.variants(df).collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (False,) * 3, 5: (False,) * 3}
    named = lambda word: sorted(r.difference for r in D.difference_rows(df, word).collect())
    assert named("hidden") == ["fused_only"] and named("middle") == ["sequential_only_vs_to_end"] and named("one") == named("nothing") == []
    counts = D.attribution(df, "hidden").first()
    assert (counts.n_fused, counts.n_sequential, counts.n_to_end, counts.fused_only, counts.views_fused) == (1, 0, 0, 1, 5)


@pytest.mark.parametrize("longest", [4096, 0])
def test_known_words(spark, monkeypatch, longest):
    monkeypatch.setattr(V, "ARRAY_WORDS", longest)
    df = spark.createDataFrame([(1, "b a b x"), (2, ""), (3, None), (4, "c"), (5, "b a b x")], "id int, t string").withColumn("word", F.lit("a"))
    words = spark.createDataFrame([("b",), ("a",), ("z",)], "word string")
    got = {r.id: r.w and list(r.w) for r in V.known_words(df, F.split("t", " "), words, "id", "w").collect()}
    assert got == {1: ["a", "b"], 2: [], 3: [], 4: [], 5: ["a", "b"]}


def test_unsigned_totals_merge(spark):
    part = spark.createDataFrame([("a", Decimal(18 * 10**18))], "word string, total_views decimal(38,0)")
    assert [(r.word, int(r.total_views)) for r in W.merge_partials([part, part]).collect()] == [("a", 36 * 10**18)]


def test_first_by_text(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", None), (2, "b", 2), (4, None, 3), (5, "", 4)], "row_id int, desc string, x int")
    assert sorted((r.row_id, r.desc, r.x) for r in D.first_by_text(df).collect()) == [(1, "a", None), (2, "b", 2), (5, "", 4)]


def test_last_delivery(spark):
    df = spark.createDataFrame([(1, 9, "a", 5), (2, 9, "a", 7), (3, 9, "a", 7), (4, 9, "a", None), (5, 9, None, 1)], "row_id int, video_id int, desc string, crawled_at int")
    assert sorted(r.row_id for r in D.last_delivery(df).collect()) == [2, 5]


@pytest.mark.parametrize("kw", [{"fan_in": 2}, {"fan_in": 3, "light": 20}, {"fan_in": 2, "light": 0}, {}])
@pytest.mark.parametrize("metric", ["long", "decimal(20,0)"])
def test_tree_equals_plain_aggregate(spark, kw, metric):
    data = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 5 == 0 else i % 11) for i in range(700)] + [(900, None, 1), (901, "", None), (902, "lone", None)]
    df = spark.createDataFrame(data, "row_id long, desc string, views long").withColumn("views", F.col("views").cast(metric)).withColumns({"k1": F.lit(1), "key": F.lit("x"), "_branch": F.lit(0)})
    got = {r.desc: (r.n_rows, r.first_row, r.top_row, r.total, r.highest) for r in per_key(df.repartition(13), **kw).collect()}
    want = {}
    for key in {d for _, d, _ in data if d is not None}:
        own = [(i, v) for i, d, v in data if d == key]
        top = max(own, key=lambda x: (x[1] is not None, x[1] or 0, -x[0]))[0]
        known = [v for _, v in own if v is not None]
        want[key] = (len(own), min(i for i, _ in own), top, sum(known) if known else None, max(known) if known else None)
    assert got == want


def test_tree_packs_extremes(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, "a", top), (top - 1, "a", top), (-5, "b", low), (7, "b", low), (-(10**17), "c", 0), (3, "c", None)]
    df = spark.createDataFrame(rows, "row_id long, desc string, views long").repartition(5)
    assert sorted((r.desc, r.top_row, r.highest) for r in per_key(df).collect()) == [("a", top - 1, top), ("b", -5, low), ("c", -(10**17), 0)]
    with pytest.raises(Exception, match="can't be packed"):
        per_key(spark.createDataFrame([(low, "a", 1)], df.schema)).collect()


def test_tree_runs_rounds_by_hash(spark, monkeypatch):
    """The query's own plan at sf0.01 has a round before the last and no sort; rounds grow with the logarithm of the chunks."""
    from wordtide.plans import core
    from wordtide.sources import tables

    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = planned(core.QUERIES["p4_found"](spark, "/root/testdata/sf0.01"))
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan
    monkeypatch.setattr(tables, "SPREAD_BELOW_BYTES", 0)
    rows = spark.range(0, 640, 1, 64).selectExpr("id AS row_id", "if(id % 3 = 0, 'x', string(id)) AS desc", "id AS views")
    # Beyond 16 chunks the first round is named twice, once for the light states.
    assert [planned(per_key(rows.repartition(n), with_key=False)).count("Exchange hashpartitioning") for n in (1, 16, 64, 256)] == [0, 2, 4, 5]


def test_tree_edges(spark):
    df = spark.createDataFrame([(1, None, 2), (1, None, 3)], "k int, desc string, _branch int")
    out = tree_aggregate(df, ["desc"], {"n": F.count(F.lit(1)), "m": F.max("_branch")}, {"n": F.sum, "m": F.max}, fan_in=2)
    assert [tuple(r) for r in out.collect()] == [(None, 2, 3)]
    assert per_key(df.selectExpr("k AS row_id", "desc", "k AS views")).collect() == []
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {}, {}, fan_in=1)
