"""Queries of the core operators over the project's tables, each with its SQL where SQL can say it.

Queries are functions (spark, folder) -> DataFrame. List columns are joined by U+001F, since engines hash lists differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions import patterns as P
from wordtide.functions import text as T
from wordtide.operators import diagnostics as D
from wordtide.operators import vocabulary as V
from wordtide.operators import wordviews as W
from wordtide.operators.tree import per_key
from wordtide.sources.tables import read_table, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Word whose total is attributed in the diagnostic queries.
PROBE = "storm"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def videos(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "videos")


def vocab(spark: SparkSession, d: str, stop: bool = True) -> DataFrame:
    return V.vocabulary(read_table(spark, d, "vocabulary"), read_table(spark, d, "stopwords") if stop else None)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(videos(spark, d).select("row_id", "desc").where(F.col("desc").isNotNull()))


def _q(text: str) -> str:
    """A string as SQL; control characters by chr()."""
    parts, plain = [], ""
    for c in text:
        if ord(c) < 32 or ord(c) in (0x85, 0xA0, 0xFFFD) or c in P.SPACES[1:]:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return "(" + " || ".join(parts + [f"'{plain}'"] * bool(plain)) + ")"


JOIN = "chr(31)"
FOLDED = f"translate(regexp_replace(\"desc\", {_q(P.PAYLOAD_MARKER)} || '.*', ''), '{P.ASCII_UPPER}', '{P.ASCII_LOWER}')"
CLEANED = f"regexp_replace({FOLDED}, {_q(P.CLEAN_PORTABLE)}, ' ', 'g')"
WORDS = f"regexp_extract_all({CLEANED}, '{P.WORD}')"
DISTINCT = f"list_distinct({WORDS})"
_NORM = f"regexp_replace(word, {_q(f'^[{P.SPACES}]+|[{P.SPACES}]+$')}, '', 'g')"


def _norm_sql(table: str) -> str:
    return f"SELECT DISTINCT lower({_NORM}) AS word FROM {table} WHERE regexp_full_match({_NORM}, '[A-Za-z]{{3,}}')"


VOCAB = f"SELECT word FROM ({_norm_sql('vocabulary')}) WHERE word NOT IN ({_norm_sql('stopwords')})"
TOKENS = f"SELECT views, unnest({DISTINCT}) AS word FROM videos WHERE \"desc\" IS NOT NULL AND views IS NOT NULL"


def totals_sql(source: str = TOKENS, keep: str | None = None) -> str:
    where = f"WHERE word IN ({keep})" if keep else ""
    return f"SELECT word, SUM(views)::BIGINT AS total_views FROM ({source}) {where} GROUP BY word"


# --- the flagship and its variants


@query(f"{totals_sql(keep=VOCAB)} ORDER BY total_views DESC, word LIMIT 5")
def top_words(spark, d):
    return W.top_words(videos(spark, d), vocab(spark, d), 5)


@query(totals_sql(keep=VOCAB))
def word_views_all(spark, d):
    return W.word_views(videos(spark, d), vocab(spark, d))


@query(f"{totals_sql(keep=_norm_sql('vocabulary'))} ORDER BY total_views DESC, word LIMIT 20")
def top_words_with_stopwords(spark, d):
    return W.top_words(videos(spark, d), vocab(spark, d, stop=False), 20)


@query(f"{totals_sql(f'SELECT n_chars AS views, unnest({DISTINCT.replace(chr(34) + "desc" + chr(34), "text")}) AS word FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL', VOCAB)}")
def document_words(spark, d):
    return W.word_views(read_table(spark, d, "documents"), vocab(spark, d), "text", "n_chars")


@query("SELECT word, total_views FROM (SELECT word, views::BIGINT AS total_views FROM (SELECT 1 AS views, 'a' AS word) WHERE FALSE)")
def empty_result(spark, d):
    return W.word_views(videos(spark, d), vocab(spark, d).where(F.lit(False)))


# --- projection and predicates


@query('SELECT views, "desc" FROM videos WHERE "desc" IS NOT NULL AND views IS NOT NULL')
def not_null_projection(spark, d):
    return W.not_null(videos(spark, d))


@query(f'SELECT row_id, contains("desc", {_q(P.PAYLOAD_MARKER)}) AS has_payload FROM videos WHERE "desc" IS NOT NULL')
def payload_rows(spark, d):
    return videos(spark, d).where("desc IS NOT NULL").select("row_id", F.contains("desc", F.lit(P.PAYLOAD_MARKER)).alias("has_payload"))


@query("SELECT row_id, coalesce(\"desc\", '') AS body, channel AS handle FROM videos")
def fill_and_rename(spark, d):
    return videos(spark, d).select("row_id", F.coalesce("desc", F.lit("")).alias("body"), F.col("channel").alias("handle"))


# --- cleaners


@query(f'SELECT row_id, regexp_replace("desc", {_q(P.PAYLOAD_MARKER)} || \'.*\', \'\') AS body FROM videos WHERE "desc" IS NOT NULL')
def strip_payload(spark, d):
    return texts(spark, d).select("row_id", T.strip_payload(F.col("desc")).alias("body"))


@query(f'SELECT row_id, split_part("desc", {_q(P.PAYLOAD_MARKER)}, 1) AS body FROM videos WHERE "desc" IS NOT NULL')
def strip_payload_to_end(spark, d):
    return texts(spark, d).select("row_id", T.strip_payload_to_end(F.col("desc")).alias("body"))


@query(f"SELECT row_id, translate(\"desc\", '{P.ASCII_UPPER}', '{P.ASCII_LOWER}') AS body FROM videos WHERE \"desc\" IS NOT NULL")
def ascii_fold(spark, d):
    return texts(spark, d).select("row_id", T.ascii_fold(F.col("desc")).alias("body"))


@query(f'SELECT row_id, {CLEANED} AS body FROM videos WHERE "desc" IS NOT NULL')
def clean_text(spark, d):
    return texts(spark, d).select("row_id", T.clean(F.col("desc")).alias("body"))


FOLDED_ALL = FOLDED.replace("'.*', '')", "'.*', '', 'g')")
FOLDED_TO_END = f"translate(split_part(\"desc\", {_q(P.PAYLOAD_MARKER)}, 1), '{P.ASCII_UPPER}', '{P.ASCII_LOWER}')"


@query(f'SELECT row_id, regexp_replace("desc", {_q(P.PAYLOAD_MARKER)} || \'.*\', \'\', \'g\') AS body FROM videos WHERE "desc" IS NOT NULL')
def strip_payloads(spark, d):
    return texts(spark, d).select("row_id", T.strip_payloads(F.col("desc")).alias("body"))


def _sequential_sql() -> str:
    out = FOLDED_ALL
    for p in (P.URL_SCHEME, P.URL_BARE, P.EMAIL_PORTABLE, P.MENTION, P.HASHTAG):
        out = f"regexp_replace({out}, {_q(p)}, ' ', 'g')"
    return out


@query(f'SELECT row_id, {_sequential_sql()} AS body FROM videos WHERE "desc" IS NOT NULL')
def clean_text_sequential(spark, d):
    return texts(spark, d).select("row_id", T.clean_sequential(F.col("desc")).alias("body"))


# --- entities

_NO_MAIL = f"regexp_replace(\"desc\", {_q(P.EMAIL_PORTABLE)}, ' ', 'g')"
_NO_LINK = f"regexp_replace({_NO_MAIL}, {_q(P.URL)}, ' ', 'g')"
_NO_MENTION = f"regexp_replace({_NO_LINK}, {_q(P.MENTION)}, ' ', 'g')"


def _facet_sql(name: str, items: str) -> str:
    return f"SELECT row_id, array_to_string({items}, {JOIN}) AS {name} FROM videos WHERE \"desc\" IS NOT NULL AND len({items}) > 0"


def _facet(spark, d, name, f):
    rows = texts(spark, d).select("row_id", f(F.col("desc")).alias(name)).where(F.size(name) > 0)
    return rows.select("row_id", F.array_join(name, "\x1f").alias(name))


@query(_facet_sql("emails", f'regexp_extract_all("desc", {_q(P.EMAIL_PORTABLE)})'))
def extract_emails(spark, d):
    return _facet(spark, d, "emails", T.emails)


_LINKS = f"regexp_extract_all({_NO_MAIL}, {_q(P.URL)})"
_MORE = lambda a, b: f"length(replace(t, '{a}', '')) > length(replace(t, '{b}', ''))"
_CUT = (
    f"CASE WHEN right(t, 1) <> '' AND contains('{P.LINK_TRAIL}', right(t, 1)) OR right(t, 1) = ')' AND {_MORE('(', ')')} OR right(t, 1) = ']' AND {_MORE('[', ']')}"
    f" OR right(t, 1) = '}}' AND {_MORE('{', '}')} THEN left(t, length(t) - 1) ELSE t END"
)
_TIDY = f"list_transform({_LINKS}, lambda x: list_reduce([regexp_replace(x, '^[^\\pL\\pN_]', '')] || list_transform(range(length(x)), lambda i: ''), lambda t, u: {_CUT}))"


@query(_facet_sql("urls", _TIDY))
def extract_urls(spark, d):
    return _facet(spark, d, "urls", T.urls)


@query(_facet_sql("mentions", f"regexp_extract_all({_NO_LINK}, {_q(P.MENTION)})"))
def extract_mentions(spark, d):
    return _facet(spark, d, "mentions", T.mentions)


@query(_facet_sql("hashtags", f"regexp_extract_all({_NO_MENTION}, {_q(P.HASHTAG)})"))
def extract_hashtags(spark, d):
    return _facet(spark, d, "hashtags", T.hashtags)


# --- tokens and arrays


@query(f'SELECT row_id, array_to_string({WORDS}, {JOIN}) AS words FROM videos WHERE "desc" IS NOT NULL')
def tokenize(spark, d):
    return texts(spark, d).select("row_id", F.array_join(T.tokenize(F.col("desc")), "\x1f").alias("words"))


@query(f'SELECT row_id, len({DISTINCT})::INT AS n_distinct FROM videos WHERE "desc" IS NOT NULL')
def token_distinct(spark, d):
    return texts(spark, d).select("row_id", F.size(T.distinct_words(F.col("desc"))).alias("n_distinct"))


@query(f'SELECT row_id, array_to_string(list_sort({DISTINCT}), {JOIN}) AS signature FROM videos WHERE "desc" IS NOT NULL')
def token_signature(spark, d):
    return texts(spark, d).select("row_id", T.signature(T.tokenize(F.col("desc"))).alias("signature"))


@query(TOKENS)
def explode_tokens(spark, d):
    return W.exploded(videos(spark, d))


@query(f"SELECT row_id, list_contains({WORDS}, '{PROBE}') AS holds FROM videos WHERE \"desc\" IS NOT NULL")
def token_membership(spark, d):
    return texts(spark, d).select("row_id", F.array_contains(T.tokenize(F.col("desc")), PROBE).alias("holds"))


@query(
    f"""SELECT row_id, COUNT(w.word)::INT AS n_known FROM videos v LEFT JOIN
    (SELECT row_id, word FROM (SELECT row_id, unnest({DISTINCT}) AS word FROM videos) WHERE word IN ({VOCAB})) w USING (row_id)
    WHERE "desc" IS NOT NULL GROUP BY row_id"""
)
def tokens_in_vocabulary(spark, d):
    known = V.known_words(texts(spark, d), T.tokenize(F.col("desc")), vocab(spark, d), "row_id", "words")
    return known.select("row_id", F.size("words").alias("n_known"))


@query(
    f"""SELECT row_id, array_to_string(list_sort(list_filter({DISTINCT}, lambda w: w NOT IN ('{PROBE}', 'the'))), {JOIN}) AS words
    FROM videos WHERE "desc" IS NOT NULL"""
)
def filter_tokens(spark, d):
    """Membership and its negation element by element, inside each row's array."""
    kept = F.filter(T.distinct_words(F.col("desc")), lambda w: ~w.isin(PROBE, "the"))
    return texts(spark, d).select("row_id", F.array_join(F.sort_array(kept), "\x1f").alias("words"))


# --- joins


def _token_rows(spark, d):
    return W.explode_words(texts(spark, d), "desc", "row_id")


_ROWS = f'SELECT row_id, unnest({DISTINCT}) AS word FROM videos WHERE "desc" IS NOT NULL'


@query(f"SELECT row_id, word FROM ({_ROWS}) WHERE word IN ({VOCAB})")
def semi_join_vocab(spark, d):
    return _token_rows(spark, d).join(V.sized(vocab(spark, d)), "word", "left_semi").select("row_id", "word")


@query(f"SELECT row_id, word FROM ({_ROWS}) JOIN ({VOCAB}) USING (word)")
def inner_join_vocab(spark, d):
    return _token_rows(spark, d).join(V.sized(vocab(spark, d)), "word").select("row_id", "word")


@query(f"SELECT row_id, word FROM ({_ROWS}) WHERE word NOT IN ({VOCAB})")
def anti_join_vocab(spark, d):
    return _token_rows(spark, d).join(V.sized(vocab(spark, d)), "word", "left_anti").select("row_id", "word")


_SEQ_WORDS = f"regexp_extract_all({_sequential_sql()}, '{P.WORD}')"
_END_WORDS = f"regexp_extract_all(regexp_replace({FOLDED_TO_END}, {_q(P.CLEAN_PORTABLE)}, ' ', 'g'), '{P.WORD}')"
_BY = {"fused": WORDS, "sequential": _SEQ_WORDS, "to_end": _END_WORDS}
_SIG = lambda w: f"array_to_string(list_sort(list_distinct({w})), {JOIN})"


@query(
    f"""WITH a AS (SELECT row_id, {_SIG(WORDS)} AS s FROM videos WHERE "desc" IS NOT NULL),
    b AS (SELECT row_id, {_SIG(_SEQ_WORDS)} AS s FROM videos WHERE "desc" IS NOT NULL),
    c AS (SELECT row_id, {_SIG(_END_WORDS)} AS s FROM videos WHERE "desc" IS NOT NULL)
    SELECT v.row_id, v.views, coalesce(a.s, '') AS tokens_fused, coalesce(b.s, '') AS tokens_sequential, coalesce(c.s, '') AS tokens_to_end
    FROM videos v LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN c USING (row_id)"""
)
def left_align(spark, d):
    """Every row beside what three variants made of it, where they made something. Three joins, for results that come from
    different places; ``variants`` gives the same of one table in one projection."""
    out = videos(spark, d).select("row_id", "views")
    for v, clean in D.VARIANTS.items():
        made = texts(spark, d).select("row_id", T.signature(T.words(clean(F.col("desc")))).alias(f"tokens_{v}"))
        out = out.join(made, "row_id", "left")
    return out.fillna("", [f"tokens_{v}" for v in D.VARIANTS])


@query(f"SELECT row_id FROM videos WHERE \"desc\" IS NOT NULL AND len({WORDS}) = 0")
def rows_without_words(spark, d):
    """Anti join of the rows against those with a token."""
    rows = texts(spark, d).select("row_id")
    return rows.join(_token_rows(spark, d).select("row_id"), "row_id", "left_anti")


# --- aggregation


@query(totals_sql())
def partial_final_sum(spark, d):
    """Totals of all words, with or without a vocabulary entry."""
    return W.word_views(videos(spark, d))


@query(totals_sql(keep=VOCAB))
def union_partials(spark, d):
    """The same totals from two halves of the rows, added up."""
    words, rows = vocab(spark, d), videos(spark, d)
    halves = [W.word_views(rows.where(F.col("row_id") % 2 == k), words) for k in (0, 1)]
    return W.merge_partials(halves)


@query("SELECT COUNT(*) AS n_rows, COUNT(\"desc\") AS n_desc, SUM(views)::BIGINT AS sum_views, MAX(row_id) AS last_row FROM videos")
def count_sum_global(spark, d):
    return videos(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count("desc").alias("n_desc"), F.sum("views").alias("sum_views"), F.max("row_id").alias("last_row"))


@query("SELECT COUNT(*) AS n_rows FROM videos")
def row_count(spark, d):
    return videos(spark, d).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT row_id, string_agg(word, {JOIN} ORDER BY word) AS words FROM (SELECT row_id, word FROM ({_ROWS}) WHERE word IN ({VOCAB})) GROUP BY row_id")
def collect_words(spark, d):
    known = V.known_words(texts(spark, d), T.tokenize(F.col("desc")), vocab(spark, d), "row_id", "words")
    return known.where(F.size("words") > 0).select("row_id", F.array_join(F.sort_array("words"), "\x1f").alias("words"))


@query(
    f"""SELECT row_id, views, "desc", string_agg(word, {JOIN} ORDER BY word) AS words FROM
    (SELECT row_id, views, "desc", unnest({DISTINCT}) AS word FROM videos WHERE "desc" IS NOT NULL AND views IS NOT NULL) WHERE word IN ({VOCAB}) GROUP BY ALL"""
)
def collect_rows(spark, d):
    """Words gathered by (row, metric, text), from joined tokens; a row's tokens go through the shuffle that ``collect_words`` spares."""
    rows = videos(spark, d).select("row_id", "views", "desc").where("desc IS NOT NULL AND views IS NOT NULL")
    kept = W.explode_words(spread(rows), "desc", "row_id", "views", "desc").join(V.sized(vocab(spark, d)), "word", "left_semi")
    return kept.groupBy("row_id", "views", "desc").agg(F.array_join(F.sort_array(F.collect_set("word")), "\x1f").alias("words"))


# --- diagnostics


@query(f"SELECT row_id, views, \"desc\" FROM videos WHERE \"desc\" IS NOT NULL AND views IS NOT NULL AND list_contains({WORDS}, '{PROBE}')")
def word_rows(spark, d):
    return D.word_rows(videos(spark, d), PROBE)


#: Word that the tails behind payloads hold in the driver's tables, so that variants differ on it.
TAIL_PROBE = "tail"


def _attribution_sql(word: str) -> str:
    flags = ", ".join(f"list_contains({w}, '{word}') AS in_{v}" for v, w in _BY.items())
    return f'SELECT row_id, views, "desc", {flags} FROM videos WHERE "desc" IS NOT NULL AND views IS NOT NULL'


def _attribution_counts(word: str) -> str:
    each = ", ".join(f"COUNT(*) FILTER (in_{v}) AS n_{v}, coalesce(SUM(views) FILTER (in_{v}), 0)::BIGINT AS views_{v}" for v in _BY)
    more = ", ".join(f"COUNT(*) FILTER (in_{a} AND NOT in_{b}) AS {n}" for n, (a, b) in D.DIFFERENCES.items())
    return f"SELECT '{word}' AS word, {each}, {more} FROM ({_attribution_sql(word)})"


@query(_attribution_counts(PROBE))
def word_attribution(spark, d):
    return D.attribution(videos(spark, d), PROBE)


@query(_attribution_counts(TAIL_PROBE))
def word_attribution_tails(spark, d):
    return D.attribution(videos(spark, d), TAIL_PROBE)


@query(
    f"WITH r AS ({_attribution_sql(TAIL_PROBE)}) "
    + " UNION ALL ".join(
        f"SELECT row_id, views, \"desc\", '{n}' AS difference FROM (SELECT * FROM r WHERE in_{a}) ANTI JOIN (SELECT row_id FROM r WHERE in_{b}) USING (row_id)"
        for n, (a, b) in D.DIFFERENCES.items()
    )
)
def word_differences(spark, d):
    return D.difference_rows(videos(spark, d), TAIL_PROBE)


_VARIANTS = f'SELECT row_id, views, "desc", {", ".join(f"{_SIG(w)} AS tokens_{v}" for v, w in _BY.items())} FROM videos WHERE "desc" IS NOT NULL'
_VARIANTS = f"SELECT *, {', '.join(f'tokens_{a} <> tokens_{b} AS {a}_vs_{b}' for a, b in D.PAIRS)} FROM ({_VARIANTS})"
_DIFFER = " OR ".join(f"{a}_vs_{b}" for a, b in D.PAIRS)


@query(f"SELECT * FROM ({_VARIANTS}) WHERE {_DIFFER}")
def tokenizer_mismatches(spark, d):
    return D.variants(videos(spark, d)).where("differ").drop("differ")


@query(f"SELECT COUNT(*) AS n_rows, COUNT(*) FILTER ({_DIFFER}) AS n_differ, {', '.join(f'COUNT(*) FILTER ({a}_vs_{b}) AS n_{a}_vs_{b}' for a, b in D.PAIRS)} FROM ({_VARIANTS})")
def mismatch_counts(spark, d):
    pairs = [F.count_if(f"{a}_vs_{b}").alias(f"n_{a}_vs_{b}") for a, b in D.PAIRS]
    return D.variants(videos(spark, d)).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("differ").alias("n_differ"), *pairs)


@query(
    f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY "desc" ORDER BY row_id) AS n
    FROM ({_VARIANTS}) WHERE {_DIFFER}) WHERE n = 1 ORDER BY row_id LIMIT 5000"""
)
def mismatch_sample(spark, d):
    return D.mismatch_sample(videos(spark, d))


@query('SELECT row_id, video_id, "desc", views FROM (SELECT *, row_number() OVER (PARTITION BY "desc" ORDER BY row_id) AS n FROM videos WHERE "desc" IS NOT NULL) WHERE n = 1')
def dedup_first(spark, d):
    return D.first_by_text(videos(spark, d).select("row_id", "video_id", "desc", "views"))


@query('SELECT row_id, video_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, "desc" ORDER BY crawled_at DESC NULLS LAST, row_id) AS n FROM videos) WHERE n = 1')
def latest_delivery(spark, d):
    return D.last_delivery(videos(spark, d).select("row_id", "video_id", "desc", "crawled_at")).select("row_id", "video_id")


@query('SELECT row_id, views FROM videos WHERE views IS NOT NULL ORDER BY views DESC, row_id LIMIT 20')
def top_k(spark, d):
    return videos(spark, d).select("row_id", "views").where("views IS NOT NULL").orderBy(F.col("views").desc(), "row_id").limit(20)


# --- vocabulary


@query(VOCAB)
def vocabulary_normalise(spark, d):
    return vocab(spark, d)


@query(_norm_sql("stopwords"))
def stopwords_normalise(spark, d):
    return V.normalise(read_table(spark, d, "stopwords"))


# --- tokenizer cases: what was expected beside what came out

_CASE = {"desc": "text"}


def _case_sql() -> str:
    t = lambda s: s.replace('"desc"', "text")
    mails = t(f'regexp_extract_all("desc", {_q(P.EMAIL_PORTABLE)})')
    links = t(_TIDY)
    ats, tags = t(f"regexp_extract_all({_NO_LINK}, {_q(P.MENTION)})"), t(f"regexp_extract_all({_NO_MENTION}, {_q(P.HASHTAG)})")
    cols = {"emails": mails, "urls": links, "mentions": ats, "hashtags": tags, "words": t(WORDS)}
    out = ", ".join(f"array_to_string({v}, {JOIN}) AS {k}, {v} = expected_{k} AS {k}_ok" for k, v in cols.items())
    return f"SELECT case_id, {out} FROM tokenizer_cases WHERE text IS NOT NULL"


@query(_case_sql())
def tokenizer_case_results(spark, d):
    cases, c = read_table(spark, d, "tokenizer_cases").where("text IS NOT NULL"), F.col("text")
    found = {"emails": T.emails(c), "urls": T.urls(c), "mentions": T.mentions(c), "hashtags": T.hashtags(c), "words": T.tokenize(c)}
    both = [x for k, v in found.items() for x in (F.array_join(v, "\x1f").alias(k), (v == F.col(f"expected_{k}")).alias(f"{k}_ok"))]
    return cases.select("case_id", *both)


# --- run log

_ENGINE = "regexp_replace(lower(trim(engine)), '[^a-z]', '', 'g')"


@query(
    f"""SELECT engine, COUNT(*) AS n_runs, COUNT(elapsed_seconds) AS n_timed, MIN(elapsed_seconds) AS best_seconds, MAX(top_views) AS most_views
    FROM (SELECT {_ENGINE} AS engine, elapsed_seconds, top_word, top_views, started_at FROM run_log) GROUP BY engine"""
)
def run_log_summary(spark, d):
    engine = F.regexp_replace(F.lower(F.trim("engine")), "[^a-z]", "")
    return (
        read_table(spark, d, "run_log").groupBy(engine.alias("engine"))
        .agg(F.count(F.lit(1)).alias("n_runs"), F.count("elapsed_seconds").alias("n_timed"), F.min("elapsed_seconds").alias("best_seconds"), F.max("top_views").alias("most_views"))
    )


# --- problem 4: results per value although a few values hold most rows


@query(
    """SELECT min(row_id) AS first_row_id, arg_max(row_id, (CASE WHEN views IS NULL THEN 0 ELSE 1 END, coalesce(views, 0), -row_id)) AS top_row_id
    FROM videos WHERE "desc" IS NOT NULL GROUP BY "desc" HAVING COUNT(*) >= 2"""
)
def p4_found(spark, d):
    out = per_key(videos(spark, d), with_key=False).where("n_rows >= 2")
    return out.select(F.col("first_row").alias("first_row_id"), F.col("top_row").alias("top_row_id"))


@query(
    """SELECT "desc", COUNT(*) AS n_rows, MIN(row_id) AS first_row, SUM(views)::BIGINT AS total, MAX(views) AS highest
    FROM videos WHERE "desc" IS NOT NULL GROUP BY "desc\""""
)
def p4_per_desc(spark, d):
    return per_key(videos(spark, d)).drop("top_row").withColumn("total", F.col("total").cast("bigint"))
