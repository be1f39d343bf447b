"""Queries of the training-data operators and their SQL, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordtide.llm import encoding_repair as ER
from wordtide.llm import heavy_hitters as HH
from wordtide.llm import language_id as LI
from wordtide.llm import mixing as MX
from wordtide.llm import normal_form as NF
from wordtide.llm import packing as PK
from wordtide.llm import pii as PI
from wordtide.llm import shared_spans as SS
from wordtide.llm import term_frequency as TF
from wordtide.plans.core import WORDS
from wordtide.session import cut_lineage
from wordtide.sources.tables import read_table, spread

#: Size of the mix whose shares ``p9_invariants`` compares with their targets, and how near they must come: a block of 200 and
#: half of one more for the last record.
MIX_TOKENS, MIX_NEAR = 20_000, 0.0075
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _videos(spark, d, *columns):
    return spread(read_table(spark, d, "videos").select(*columns))


def _documents(spark, d, *columns):
    return spread(read_table(spark, d, "documents").select(*columns))


# --- 1: terms

_TERMS = f"""SELECT term, SUM(n)::BIGINT AS occurrences, COUNT(*) AS records FROM
    (SELECT row_id, term, COUNT(*) AS n FROM (SELECT row_id, unnest({WORDS}) AS term FROM videos WHERE "desc" IS NOT NULL) GROUP BY ALL) GROUP BY term"""
_MARKED = f"""SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.05 * (SELECT COUNT("desc") FROM videos) THEN 'common' END AS mark FROM ({_TERMS})"""


@query(f"SELECT term, mark FROM ({_MARKED}) WHERE mark IS NOT NULL")
def p1_found(spark, d):
    return TF.desc_terms(_videos(spark, d, "desc")).where("mark IS NOT NULL").select("term", "mark")


@query(_MARKED)
def p1_terms(spark, d):
    return TF.desc_terms(_videos(spark, d, "desc"))


# --- 2: heavy hitters

_HITS = """WITH g AS (SELECT "desc", COUNT(*) AS n_rows, coalesce(SUM(views), 0) AS total FROM videos WHERE "desc" IS NOT NULL GROUP BY "desc"),
    s AS (SELECT SUM(n_rows) AS r, SUM(total) AS t FROM g)
    SELECT 'rows' AS measure, "desc" FROM g, s WHERE n_rows >= 0.01 * r UNION ALL SELECT 'views', "desc" FROM g, s WHERE total >= 0.01 * t AND total > 0"""


@query(_HITS)
def p2_found(spark, d):
    hits = HH.heavy_hitters(_videos(spark, d, "desc", "views"), "desc", "views")
    measure = F.when(F.col("measure") == "weight", "views").otherwise(F.col("measure"))
    return hits.select(measure.alias("measure"), F.col("value").alias("desc"))


@query(
    """WITH g AS (SELECT "desc", COUNT(*) AS n_rows, coalesce(SUM(views), 0)::BIGINT AS total FROM videos WHERE "desc" IS NOT NULL GROUP BY "desc"),
    s AS (SELECT SUM(n_rows) AS r, SUM(total) AS t FROM g)
    SELECT 'rows' AS measure, "desc", n_rows, total, TRUE AS within_bound FROM g, s WHERE n_rows >= 0.01 * r
    UNION ALL SELECT 'views', "desc", n_rows, total, TRUE FROM g, s WHERE total >= 0.01 * t AND total > 0"""
)
def p2_totals(spark, d):
    """The exact totals, and whether the summary's count kept its bound: never above, short by a 401st of all at most."""
    rows = _videos(spark, d, "desc", "views")
    hits = HH.heavy_hitters(rows, "desc", "views")
    everything = rows.where("desc IS NOT NULL").agg(F.count(F.lit(1)).alias("rows"), F.sum("views").alias("views")).first()
    heavy = F.col("measure") == "weight"
    exact, slack = F.when(heavy, F.col("total")).otherwise(F.col("n_rows")), F.when(heavy, F.lit(everything["views"])).otherwise(F.lit(everything["rows"])) / 401
    kept = (F.col("approximate") <= exact) & (F.col("approximate") >= exact - slack)
    return hits.select(
        F.when(heavy, "views").otherwise("rows").alias("measure"), F.col("value").alias("desc"), "n_rows", F.col("total").cast("bigint").alias("total"), kept.alias("within_bound")
    )


# --- 10: long shared spans

_GRAMS = """SELECT doc_id, hash(substr(text, i::BIGINT, 200)) AS w, i - 1 AS pos FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i
    FROM documents WHERE length(text) >= 200)"""


@query(
    f"""WITH g AS ({_GRAMS}), r AS (SELECT w FROM g GROUP BY w HAVING COUNT(DISTINCT doc_id) > 1),
    k AS (SELECT DISTINCT w, doc_id FROM g WHERE w IN (SELECT w FROM r))
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.w = b.w AND a.doc_id < b.doc_id"""
)
def p10_found(spark, d):
    pairs = SS.shared_pairs(_documents(spark, d, "doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@query()
def p10_spans(spark, d):
    return SS.shared_spans(_documents(spark, d, "doc_id", "text"))


@query(
    f"""WITH g AS ({_GRAMS}), r AS (SELECT w FROM g GROUP BY w HAVING COUNT(DISTINCT doc_id) > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 200)) AS p FROM g WHERE w IN (SELECT w FROM r)),
    n AS (SELECT doc_id, COUNT(*) AS shared FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(shared, 0)::BIGINT AS shared FROM documents LEFT JOIN n USING (doc_id)"""
)
def p10_amount(spark, d):
    amount = SS.shared_amount(_documents(spark, d, "doc_id", "text"))
    return amount.select(F.col("doc").alias("doc_id"), "shared")


# --- 7: wrong encodings


@query()
def p7_found(spark, d):
    return ER.garbled_rows(_videos(spark, d, "row_id", "desc")).select("row_id")


@query()
def p7_repaired(spark, d):
    rows = ER.repair(_videos(spark, d, "row_id", "desc"))
    return rows.select("row_id", "repaired.restored", "repaired.spans", "repaired.lost")


# --- 5: look-alike text


def _both(f, spark, d):
    """f(table, key, text) over videos and over the tokenizer cases, with the table's name."""
    tables = (("videos", "row_id", "desc"), ("tokenizer_cases", "case_id", "text"))
    got = [f(spread(read_table(spark, d, t).select(key, text)), key, text).withColumn("tbl", F.lit(t)) for t, key, text in tables]
    return got[0].unionByName(got[1])


def _all_texts(spark, d):
    """(tbl, id, text) of videos and tokenizer cases; few enough rows are dealt to all cores."""
    tables = (("videos", "row_id", "desc"), ("tokenizer_cases", "case_id", "text"))
    got = [spread(read_table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(key).alias("id"), F.col(text).alias("text"))) for t, key, text in tables]
    return got[0].unionByName(got[1])


def _forms_sql() -> str:
    """Letters by ``translate``, then composition by the database. Characters that vanish come last, without a counterpart."""
    one = {c: n for c in NF._assigned() if c not in "\x00" and len(n := NF.normal(c)) == 1 and n != c}
    gone = [c for c in NF._assigned() if NF.normal(c) == ""]
    plain, tail = [*one], "".join(gone)
    texts = """SELECT 'videos' AS tbl, row_id AS id, "desc" AS text FROM videos UNION ALL SELECT 'tokenizer_cases', case_id, text FROM tokenizer_cases"""
    chars, to = ", ".join(str(ord(c)) for c in [*plain, *tail]), ", ".join(str(ord(one[c])) for c in plain)
    listed = lambda points: f"(SELECT string_agg(chr(c), '' ORDER BY i) FROM (SELECT unnest([{points}]) AS c, generate_subscripts([{points}], 1) AS i))"
    # The database's normalisation ends at a zero, so zeros are something else meanwhile.
    form = f"nfc_normalize(translate(replace(text, chr(0), chr({0xE000})), {listed(chars)}, {listed(to)}))"
    return f"SELECT tbl, id, replace({form}, chr({0xE000}), chr(0)) AS form, text FROM ({texts})"


_FORMS = _forms_sql()


@query(
    f"""WITH f AS (SELECT * FROM ({_FORMS}) WHERE text IS NOT NULL)
    SELECT a.tbl, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM f a JOIN f b ON a.tbl = b.tbl AND a.form = b.form AND a.text < b.text"""
)
def p5_found(spark, d):
    pairs = NF.look_alikes(_all_texts(spark, d), "id", "text", "tbl")
    return pairs.select("tbl", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query(f"SELECT tbl, id, form FROM ({_FORMS})")
def p5_forms(spark, d):
    return NF.normalise(_all_texts(spark, d), "text").select("tbl", "id", "form")


# --- 3: languages


def _language_model(spark, d):
    return LI.train(LI.sample(read_table(spark, d, "documents"), "doc_id", "text", "lang"))


@query()
def p3_found(spark, d):
    return LI.label_problems(_videos(spark, d, "row_id", "desc", "lang"), _language_model(spark, d))


@query()
def p3_languages(spark, d):
    rows = LI.identify(_videos(spark, d, "row_id", "desc"), _language_model(spark, d))
    return rows.select("row_id", "language.lang", F.round("language.confidence", 4).alias("confidence"), F.size("language.segments").alias("n_segments"))


@query()
def p3_segments(spark, d):
    rows = LI.identify(_videos(spark, d, "row_id", "desc"), _language_model(spark, d))
    each = rows.select("row_id", F.posexplode("language.segments").alias("at", "s"))
    return each.select("row_id", "at", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.text", "s.start", "s.stop")


# --- 8: containers


def _packed(spark, d):
    sizes = {r["pack_id"]: r["capacity"] for r in read_table(spark, d, "pack_sizes").collect()}  # a few capacities
    return PK.pack(_documents(spark, d, "doc_id", "text"), sizes)


@query()
def p8_packed(spark, d):
    return _packed(spark, d)


@query()
def p8_fill(spark, d):
    return PK.fill(_packed(spark, d), read_table(spark, d, "pack_sizes"))


@query(
    """SELECT pack_id::BIGINT AS pack_id, n AS n_documents, 0 AS n_overfull, 0 AS n_cut_needlessly, 0 AS n_incomplete
    FROM pack_sizes, (SELECT COUNT(*) AS n FROM documents WHERE text IS NOT NULL)"""
)
def p8_invariants(spark, d):
    """What must hold of any packing, counted from the placed pieces."""
    capacity = read_table(spark, d, "pack_sizes").select(F.col("pack_id").cast("bigint").alias("pack_id"), "capacity")
    placed = cut_lineage(_packed(spark, d))
    full = placed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n")).join(capacity, "pack_id")
    full = full.groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity")).cast("int").alias("n_overfull"))
    each = placed.groupBy("pack_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    each = each.join(capacity, "pack_id").groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).cast("int").alias("n_cut_needlessly"),
        F.count_if(F.col("n") != F.col("end")).cast("int").alias("n_incomplete"),
    )
    return each.join(full, "pack_id")


# --- 9: mixes


@query()
def p9_mix(spark, d):
    return MX.mix(_documents(spark, d, "doc_id", "text", "source"), read_table(spark, d, "mix_targets"))


@query()
def p9_shares(spark, d):
    return MX.shares(p9_mix(spark, d), read_table(spark, d, "mix_targets"))


# --- 6: personal information


def _tagger(spark, d):
    return PI.fit(read_table(spark, d, "documents"), read_table(spark, d, "name_hints"))


@query()
def p6_found(spark, d):
    made = _tagger(spark, d)
    found = _both(lambda df, key, text: PI.kinds(df, made, key, text).withColumnRenamed(key, "id"), spark, d)
    return found.select("tbl", "id", "kind")


@query()
def p6_redacted(spark, d):
    made = _tagger(spark, d)
    rows = _both(lambda df, key, text: PI.find(df, made, text).withColumnRenamed(key, "id").select("id", "pii.redacted"), spark, d)
    return rows.select("tbl", "id", "redacted")


@query(
    """WITH n AS (SELECT source, COUNT(*) AS n_records FROM documents WHERE text <> '' GROUP BY source),
    t AS (SELECT source, target_share, max_repeats, n_records > 0 AS present FROM mix_targets LEFT JOIN n USING (source))
    SELECT source, target_share, max_repeats, TRUE AS repeats_kept, TRUE AS records_real, TRUE AS size_met,
    CASE WHEN present THEN round(target_share / (SELECT SUM(target_share) FROM t WHERE present), 6) ELSE 0 END AS share FROM t"""
)
def p9_invariants(spark, d):
    """What must hold of any mix: caps on repeats, and only records of the source, each listed once. Of a mix of ``MIX_TOKENS``
    tokens the size must be met to a fiftieth; ``share`` is the share reached, rounded to the target where it is within
    ``MIX_NEAR`` of it, so that the SQL can state it."""
    targets, mixed = read_table(spark, d, "mix_targets"), cut_lineage(p9_mix(spark, d))
    asked = MX.shares(MX.mix(_documents(spark, d, "doc_id", "text", "source"), targets, total_tokens=MIX_TOKENS, blocks=200, shard_tokens=2000), targets)
    everything = W.partitionBy()  # one row a target
    asked = asked.withColumns({"all": F.sum("tokens").over(everything), "goal": F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(everything)})
    reached = F.when(F.abs(F.col("actual_share") - F.col("goal")) <= MIX_NEAR, F.col("goal")).otherwise(F.col("actual_share"))
    asked = asked.select("source", (F.abs(F.col("all") / MIX_TOKENS - 1) <= 0.02).alias("size_met"), F.round(reached, 6).alias("share"))
    real = mixed.join(_documents(spark, d, "doc_id", F.col("source").alias("own")), "doc_id")
    by = real.groupBy("source").agg(F.count_if(F.col("own") == F.col("source")).alias("right"), F.max("repeats").alias("most"))
    listed = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"))
    rows = targets.join(by, "source", "left").join(listed, "source", "left").join(asked, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "source", "target_share", "max_repeats", (zero("most") <= F.col("max_repeats")).alias("repeats_kept"), "size_met", "share",
        ((zero("rows") == zero("ids")) & (zero("rows") == zero("right"))).alias("records_real"),
    )
