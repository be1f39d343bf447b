"""The text expressions: a table of cases in one job, and the hazards of backtracking regexes."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordtide.functions import patterns as P
from wordtide.functions import text as T

M = P.PAYLOAD_MARKER
# text, emails, urls, mentions, hashtags, words
CASES = [
    ("plain words here", [], [], [], [], "plain words here"),
    ("", [], [], [], [], ""),
    ("   ", [], [], [], [], ""),
    ("mail ann.lee+list@mail.example now", ["ann.lee+list@mail.example"], [], [], [], "mail now"),
    ("ANN@MAIL.EXAMPLE", ["ANN@MAIL.EXAMPLE"], [], [], [], ""),
    ("a-b_c@sub.mail.example.", ["a-b_c@sub.mail.example"], [], [], [], ""),
    ("<x@y.zz>,(q@r.ss)", ["x@y.zz", "q@r.ss"], [], [], [], ""),
    ("no@domain here", [], [], ["@domain"], [], "here"),
    ("2rawww.japan@x.com", ["2rawww.japan@x.com"], [], [], [], ""),
    ("see https://a.example/x?y=1#z.", [], ["https://a.example/x?y=1#z"], [], [], "see"),
    ("HTTPS://A.EXAMPLE and http://b.example", [], ["http://b.example"], [], [], "and"),
    ("go www.site.example/x, then", [], ["www.site.example/x"], [], [], "then"),
    ("bit.ly/abc t.co/x goo.gl/y", [], ["bit.ly/abc", "t.co/x", "goo.gl/y"], [], [], ""),
    ("bit.ly alone", [], [], [], [], "bit alone"),
    ("youtube.com and m.youtube.com/watch?v=1", [], ["youtube.com", "m.youtube.com/watch?v=1"], [], [], "and"),
    ("fooyoutube.combar", [], [], [], [], "fooyoutube combar"),
    ("(see www.a.example/x)", [], ["www.a.example/x"], [], [], "see"),
    ("www.a.example/x_(y) (http://b.example/(z).). https://c.example/))", [], ["www.a.example/x_(y)", "http://b.example/(z)", "https://c.example/"], [], [], ""),
    ("linktr.ee/me amzn.to/1 tinyurl.com/2 youtu.be/3", [], ["linktr.ee/me", "amzn.to/1", "tinyurl.com/2", "youtu.be/3"], [], [], ""),
    ("unknown.example/path", [], [], [], [], "unknown example path"),
    ("more at https://a.example/b\u2026", [], ["https://a.example/b\u2026"], [], [], "more"),
    ("hi @some.one! bye", [], [], ["@some.one!"], [], "bye"),
    ("@a@b", [], [], ["@a", "@b"], [], ""),
    ("@имя сказал", [], [], ["@имя"], [], ""),
    ("@shop.ly/deal😀word next", [], [], ["@shop.ly/deal😀word"], [], "next"),
    ("@x#tag", [], [], ["@x"], ["#tag"], ""),
    ("#one#two three", [], [], [], ["#one", "#two"], "three"),
    ("#été! four", [], [], [], ["#été!"], "four"),
    ("#日本語 five", [], [], [], ["#日本語"], "five"),
    ("#a😀b six", [], [], [], ["#a😀b"], "six"),
    ("İzmir IZMIR", [], [], [], [], "zmir izmir"),
    ("ÉCOLE abcÉdef", [], [], [], [], "cole abc def"),
    ("snake_case x1y2abc", [], [], [], [], "snake case abc"),
    ("𝐛𝐨𝐥𝐝 text", [], [], [], [], "text"),
    (f"keep this {M} drop THIS", [], [], [], [], "keep this"),
    (f"one {M}x\ntwo {M}y\nthree", [], [], [], [], "one two exifmmy three"),
    (f"carriage {M}a\rtail", [], [], [], [], "carriage"),
    (f"line {M}a\u2028tail", [], [], [], [], "line"),
    ("bare ExifMM stays", [], [], [], [], "bare exifmm stays"),
]
CASES += [(f"#tag{c}for you", [], [], [], ["#tag"], "for you") for c in P.SPACES]
ONLY_WORDS = {f"one {M}x\ntwo {M}y\nthree"}  # its second payload starts with what looks like nothing else


def test_table(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string").repartition(2)
    c = F.col("text")
    got = rows.select("i", T.emails(c), T.urls(c), T.mentions(c), T.hashtags(c), T.tokenize(c)).collect()
    for r in got:
        case = CASES[r[0]]
        assert r[5] == case[5].split(), case
        if case[0] not in ONLY_WORDS:
            assert [list(x) for x in r[1:5]] == [list(x) for x in case[1:5]], case


def test_null_stays_null(spark):
    c = F.col("t")
    row = spark.createDataFrame([(None,)], "t string").select(T.clean(c), T.tokenize(c), T.emails(c), T.urls(c), T.strip_payload_to_end(c)).first()
    assert all(x is None for x in row)


def test_payload_to_end(spark):
    df = spark.createDataFrame([(f"a {M}b\nc",), ("none",), ("",)], "t string")
    assert [r[0] for r in df.select(T.strip_payload_to_end(F.col("t"))).collect()] == ["a ", "none", ""]


def test_sequential_differs_where_entities_nest(spark):
    df = spark.createDataFrame([("@shop bit.ly/deal😀word", "@bit.ly/deal😀word")], "a string, b string")
    fused, apart = df.select(T.tokenize(F.col("b")), T.words(T.clean_sequential(F.col("b")))).first()
    assert fused == [] and apart == ["word"]


@pytest.mark.parametrize("text", ["a" * 20_000 + "1", "a.b" * 20_000, "x@" + "a.b" * 20_000, "@" * 5_000, "a-" * 10_000 + "@b.c", "#" * 5_000, ("ab" * 200 + ".") * 50], ids=range(7))
def test_long_texts_end(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(F.length(T.clean(F.col("t")))).first()[0] >= 0


_PARTS = [*"ab1@#.:/-_+ \n\u00a0\u2003É😀\r", "www.", "https://", "bit.ly/", "youtube.com", "@x.yy", M]
_ODD = st.lists(st.sampled_from(_PARTS), max_size=14).map("".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_ODD, min_size=150, max_size=250))
def test_jvm_spelling_matches_portable(spark, texts):
    """The safe and the gated spellings against the plain pattern on a linear-time engine."""
    import duckdb

    from wordtide.plans.core import CLEANED

    df = spark.createDataFrame(list(enumerate(texts)), 'i int, "desc" string'.replace('"', ""))
    ours = {r[0]: r[1] for r in df.select("i", T.clean(F.col("desc"))).collect()}
    con = duckdb.connect()
    con.execute('CREATE TABLE v (i INT, "desc" TEXT)')
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(texts)))
    theirs = dict(con.execute(f"SELECT i, {CLEANED} FROM v").fetchall())
    assert {i: (texts[i], ours[i], theirs[i]) for i in ours if ours[i] != theirs[i]} == {}


def test_spaces_are_the_fixed_25():
    assert len(set(P.SPACES)) == 25 and all(re.match(r"\s", c) for c in P.SPACES)
