"""Problem 5: one form for text that looks the same but differs in its characters.

What is disregarded: width, whether accents are composed, invisible characters, the kind of space, and letters of other
scripts that look like Latin ones. Case, accents, punctuation, words and line breaks all count.

Distinct texts that hold anything but plain characters are exploded to positioned code points, joined with a broadcast
table of what each becomes (its size is fixed by Unicode), and put together again. Where combining marks or conjoining
letters occur, all characters are decomposed, marks are ordered by class within their cluster, and clusters recomposed by a
second broadcast table. The texts that need this are dealt to a fixed number of tasks by their hash before they are exploded,
since a planner that merges partitions by bytes does not know that rows are about to be multiplied by characters; exploding,
ordering and rebuilding then shuffle nothing.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordtide.session import cut_lineage

# Letters that look like Latin ones, and characters that do not show.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԚԜасеѕіјорухһԁԛԝӏ", "ABESIJKMHOPCTYXYQWacesijopyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϳ", "ABEZHIKMNOPTYXaivopucj")
ARMENIAN = ("օհոսցյ", "ohnugj")
LATIN = ("ɑɡ", "ag")
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF),
)
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# End of the fixed values.
#: Names of decompositions that change width only.
_WIDTHS = ("<wide>", "<narrow>")


@lru_cache(maxsize=1)
def _alike() -> dict[str, str]:
    out = {a: b for pair in (CYRILLIC, GREEK, ARMENIAN, LATIN) for a, b in zip(*pair, strict=True)}
    out |= {c: " " for c in SPACES}
    return out | {chr(i): "" for low, high in INVISIBLE_RANGES for i in range(low, high + 1)}


def _decomposed(c: str) -> str:
    """Full decomposition by canon and width, then look-alikes; invisible characters vanish."""
    kind, _, points = U.decomposition(c).partition(" ")
    if kind in _WIDTHS:
        c = "".join(chr(int(p, 16)) for p in points.split())
    return "".join(_alike().get(x, x) for x in U.normalize("NFD", c))


@lru_cache(maxsize=1)
def _assigned() -> list[str]:
    """Characters that could be changed: all with a decomposition, a class or an entry."""
    some = [c for c in map(chr, range(0x80, 0x30000)) if U.decomposition(c) or U.combining(c)]
    return [*dict.fromkeys([*some, *(chr(i) for i in range(0xAC00, 0xD7A4)), *_alike()])]


@lru_cache(maxsize=1)
def joining() -> set[str]:
    """Characters that may join the one before: combining marks, and letters that canon composes with it."""
    out = {c for c in _assigned() if U.combining(c)} | {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    out |= {chr(0xFF9E), chr(0xFF9F)}  # of half width
    for c in _assigned():
        if not U.decomposition(c).startswith("<"):
            out |= set(U.normalize("NFD", c)[1:])
    return out


def _first_join(c: str) -> bool:
    return U.combining(c) == 0 and c in joining()


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """What a cluster, or the beginning of one, is recomposed to."""
    pairs = ((U.normalize("NFD", c), c) for c in _assigned() if U.decomposition(c) and not U.decomposition(c).startswith("<") or "가" <= c <= "힣")
    return {d: c for d, c in pairs if len(d) > 1 and U.normalize("NFC", d) == c}


def normal(text: str) -> str:
    """The form of one text; what the DataFrame operators compute, in plain Python."""
    clusters: list[list[tuple[int, int, str]]] = []
    for i, x in enumerate(y for c in text for y in _decomposed(c)):
        if not clusters or not (U.combining(x) or _first_join(x)):
            clusters.append([])
        clusters[-1].append((U.combining(x), i, x))
    return "".join(_compose("".join(x for _, _, x in sorted(c))) for c in clusters)


def _compose(cluster: str) -> str:
    for n in range(len(cluster), 1, -1):
        if cluster[:n] in compositions():
            return compositions()[cluster[:n]] + cluster[n:]
    return cluster


def char_class(chars) -> str:
    """A Java character class, as ranges."""
    points, parts = sorted(map(ord, set(chars))), []
    for p in points:
        if parts and parts[-1][1] == p - 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in parts) + "]"


#: Java patterns that match every text in which something joins or changes, and few others; a handful of ranges, since a
#: class of all these characters costs each character a test of every range.
MAY_JOIN = r"(?=[^\x00-\x7f])[\p{M}\x{1160}-\x{11ff}\x{ff9e}\x{ff9f}]"
MAY_CHANGE = (
    r"(?=[^\x00-\x7f])[\xa0\xad\x{251}\x{261}\x{370}-\x{58f}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{115f}-\x{180f}"
    r"\x{1f00}-\x{1fff}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{2126}-\x{212b}\x{2329}-\x{232a}\x{2adc}\x{3000}\x{3164}"
    r"\x{f900}-\x{ffee}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}\x{e0100}-\x{e01ef}]"
)


@lru_cache(maxsize=1)
def _single() -> dict[str, str]:
    """Characters that change by themselves, where nothing around them joins."""
    return {c: n for c in _assigned() if c not in joining() and (n := normal(c)) != c}


def _keys(text: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds, which stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def _table(spark: SparkSession, columns: dict[str, list], kinds: list[pa.DataType]) -> DataFrame:
    """A broadcast table; its rows are as many as Unicode has such characters."""
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], names=list(columns))))


_PART = pa.struct([("ccc", pa.int32()), ("joins", pa.bool_()), ("n", pa.string())])


@lru_cache(maxsize=1)
def _parts() -> dict[str, list]:
    """Characters that are not their own single part, and what they become."""
    made = {c: [(U.combining(x), _first_join(x), x) for x in _decomposed(c)] for c in dict.fromkeys([*_assigned(), *sorted(joining())])}
    made = {c: p for c, p in made.items() if p != [(0, False, c)]}
    return {"c": list(made), "parts": [[dict(zip(("ccc", "joins", "n"), x, strict=True)) for x in p] for p in made.values()]}


def _points(texts: DataFrame) -> DataFrame:
    return texts.select("k1", "k2", F.posexplode(F.split("text", "")).alias("at", "c"))


def distinct_forms(df: DataFrame, text: str) -> DataFrame:
    """(k1, k2, text, form) of the distinct non-null texts."""
    spark = df.sparkSession
    rows = df.select(*_keys(F.col(text)), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    foreign = F.octet_length("text") > F.length("text")
    joins, changes = foreign & F.col("text").rlike(MAY_JOIN), foreign & F.col("text").rlike(MAY_CHANGE)
    kind = F.when(joins, 2).when(changes, 1).otherwise(0)
    texts = texts.withColumn("kind", kind)
    plain = texts.where("kind = 0").withColumn("form", F.col("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    foreign_texts = texts.where("kind > 0").repartition(tasks, "k1", "k2")

    singles = _table(spark, {"c": list(_single()), "n": list(_single().values())}, [pa.string()] * 2)
    one = _points(foreign_texts.where("kind = 1")).join(singles, "c", "left")
    one = one.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", "c").alias("n")))).alias("p"))
    one = one.select("k1", "k2", F.array_join(F.col("p.n"), "").alias("form"))

    wide = _table(spark, _parts(), [pa.string(), pa.list_(_PART)])
    own = F.array(F.struct(F.lit(0).alias("ccc"), F.lit(False).alias("joins"), F.col("c").alias("n")))
    many = _points(foreign_texts.where("kind = 2")).join(wide, "c", "left").select("k1", "k2", "at", F.posexplode(F.coalesce("parts", own)).alias("sub", "p"))
    along = W.partitionBy("k1", "k2").orderBy("at", "sub")
    starts = ((F.col("p.ccc") == 0) & ~F.col("p.joins")).cast("int")
    many = many.withColumn("cluster", F.sum(starts).over(along)).select("k1", "k2", "cluster", F.struct("p.ccc", "at", "sub", "p.n").alias("p"))
    clusters = many.groupBy("k1", "k2", "cluster").agg(F.array_sort(F.collect_list("p")).alias("p")).select("k1", "k2", "cluster", F.col("p.n").alias("p"))
    longest = max(map(len, compositions()))
    made = _table(spark, {"d": list(compositions()), "made": list(compositions().values())}, [pa.string()] * 2)
    tries = clusters
    best = F.lit(None).cast("string")
    for n in range(2, longest + 1):
        start = F.when(F.size("p") >= n, F.array_join(F.slice("p", 1, n), ""))
        tries = tries.withColumn("d", start).join(made.withColumnRenamed("made", f"made{n}"), "d", "left").drop("d")
        best = F.coalesce(F.when(F.col(f"made{n}").isNotNull(), F.concat(F.col(f"made{n}"), F.array_join(F.slice("p", F.lit(n + 1), F.size("p")), ""))), best)
    tries = tries.select("k1", "k2", "cluster", F.coalesce(best, F.array_join("p", "")).alias("n"))
    many = tries.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("cluster", "n"))).alias("p"))
    many = many.select("k1", "k2", F.array_join(F.col("p.n"), "").alias("form"))

    return plain.select("k1", "k2", "form").unionByName(one).unionByName(many)


def normalise(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """Adds the one form of a text column; null for null, empty for empty. All other columns and all rows stay.

    A text that many rows share is put into form once; the join that brings forms to rows is split where it is skewed.
    """
    k1, k2 = "_form_k1", "_form_k2"
    forms = distinct_forms(df, text).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("form").alias(out))
    keyed = df.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("second"), F.col(text))})
    # The hash of null is no form's.
    return keyed.join(forms, [k1, k2], "left").withColumn(out, F.when(F.col(text).isNotNull(), F.col(out))).drop(k1, k2)


#: Keys of texts with a look-alike that are broadcast, at 16 bytes each; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Parts that the rows of one text are split into where they are joined by shuffle.
SALTS = 32


def _spread_join(many: DataFrame, few: DataFrame, on: list[str], salt: Column) -> DataFrame:
    """Inner join in which the rows of ``many`` with one key are split by ``salt``; ``few`` is repeated for each part."""
    split = F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")
    return many.withColumn("_salt", split).join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt")


def look_alikes(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(within, a, b), a < b: the rows, of one ``within`` if that is given, whose texts differ in their characters but have one
    form. Identical texts are no pair, nulls have none.

    Forms are compared once for each distinct text. Rows come in only for texts that have a look-alike: by a broadcast of
    their keys if these are few, and otherwise by a join in which the rows of one text are split over ``SALTS`` tasks. The
    result is as large as there are such pairs of rows; ``normalise`` says the same in a row for each row.
    """
    forms = distinct_forms(df, text).select("k1", "k2", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit("second"), F.col("form")).alias("f2"))
    shared = F.count(F.lit(1)).over(W.partitionBy("f1", "f2")) > 1  # distinct texts of one form, never a hot group of rows
    members = cut_lineage(forms.withColumn("shared", shared).where("shared").drop("shared"))
    few = members.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    group = [F.col(within).alias("g")] if within else [F.lit(0).alias("g")]
    rows = df.where(F.col(text).isNotNull()).select(*group, F.col(key).alias("id"), *_keys(F.col(text)))
    keys = members.select("k1", "k2")
    own = rows.join(F.broadcast(keys), ["k1", "k2"]) if few else _spread_join(rows, keys, ["k1", "k2"], F.col("id"))
    own = cut_lineage(own)
    left = members.select("f1", "f2", F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    right = members.select("f1", "f2", F.col("k1").alias("y1"), F.col("k2").alias("y2"))
    pairs = left.join(right, ["f1", "f2"]).where("x1 < y1 OR x1 = y1 AND x2 < y2").select("x1", "x2", "y1", "y2")
    first = _spread_join(own.select("g", F.col("id").alias("i"), F.col("k1").alias("x1"), F.col("k2").alias("x2")), pairs, ["x1", "x2"], F.col("i"))
    both = _spread_join(first.select("g", "i", "y1", "y2"), own.select("g", F.col("id").alias("j"), F.col("k1").alias("y1"), F.col("k2").alias("y2")), ["g", "y1", "y2"], F.col("i"))
    out = both.select("g", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return out.withColumnRenamed("g", within) if within else out.drop("g")
