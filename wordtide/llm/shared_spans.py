"""Problem 10: long spans that stand verbatim in more than one record.

The alphabet is code points, as the spans are measured in them; a token k-mer is K consecutive ones. Of every W = MIN - K + 1
consecutive k-mers the ones with the smallest hash are kept, so two texts that share a run of MIN code points keep the same
k-mer inside it: about 2 / (W + 1) of all k-mers stand for the whole graph, and nothing is lost.

The k-mers that occur in two records or more are the nodes of a de Bruijn graph whose edges join neighbours within a
record, distance included. Where a node has one way in and one way out in all records, the path does not branch: it is
compacted into its head, and as all records that hold any node of it then hold all of it, this takes one aggregate, one
join and one window over each record's own nodes, without iteration. Neighbours further than K apart leave text between
them that no k-mer covers and that may differ, so a path ends there; within a path every code point lies in a node. A path
of MIN code points or more is therefore itself a shared span. For a shorter one, the source coordinates fetch the text around it, and every window of MIN code points across the
path is compared. So no pairs are formed within a group before they are known to share a span.

Nulls and texts shorter than MIN share nothing. Records are told apart by their key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordtide.session import cut_lineage

#: Code points that are hashed at once; a longer text goes in overlapping parts.
BLOCK = 1 << 20
#: Buckets that name the records needed again; bounds what is broadcast to some MB.
BUCKETS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.cumprod(np.full(max(n, BLOCK + 1), base, dtype=np.uint64))
    return _powers[name][:n]


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i : i + w] for every i, in a fixed number of passes: prefixes and suffixes of blocks of w."""
    n = len(x)
    padded = np.full(-(-(n + w) // w) * w, fill, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def select_kmers(texts: list[str], k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the kept k-mers. Depends on nothing but the span itself around each."""
    w = span - k + 1
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, n), out=h[1:])
    h = _mix((h[k:] - h[:-k]) * _table("down", pow(_BASE, -1, 1 << 64), n - k + 1))
    # A k-mer that runs into the next text is none; a window of w k-mers is one only if all its k-mers are.
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    of = np.repeat(np.arange(len(texts)), lengths)
    left = (ends[of] - np.arange(n))[: len(h)]
    h[left < k] = top
    low = _slide(h, w, np.minimum, int(top))
    low[left < span] = 0
    # Kept: the k-mers that are smallest in some window, that is, not above the largest of the minima around them.
    back = np.concatenate([np.zeros(w - 1, dtype=np.uint64), low])
    high = _slide(back, w, np.maximum, 0)[: len(h)]
    at = np.flatnonzero((h == high) & (left >= k) & (high > 0))
    return of[at], at - (ends - lengths)[of[at]], h[at].view(np.int64)


def _select_long(text: str, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) for one text in parts of ``BLOCK``: every run of ``span`` lies whole in one of them."""
    found: dict[int, int] = {}
    for at in range(0, len(text) - span + 1, BLOCK):
        _, where, h = select_kmers([text[at : at + BLOCK + span - 1]], k, span)
        found.update(zip((where + at).tolist(), h.tolist(), strict=True))
    where = np.array(sorted(found), dtype=np.int64)
    return where, np.array([found[i] for i in where.tolist()], dtype=np.int64)


def _kmers(k: int, span: int):
    def rows(keys: pa.Array, of: np.ndarray, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), keys.take(pa.array(of)), pa.array(at.astype(np.int32))], names=["h", "doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, owners, total = batch.column(0), [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(text) > BLOCK:
                    at, h = _select_long(text, k, span)
                    yield rows(keys, np.full(len(at), i), at, h)
                else:
                    texts.append(text)
                    owners.append(i)
                    total += len(text)
                if texts and (total >= BLOCK or i == batch.num_rows - 1):
                    of, at, h = select_kmers(texts, k, span)
                    yield rows(keys, np.array(owners)[of], at, h)
                    texts, owners, total = [], [], 0
            if texts:
                of, at, h = select_kmers(texts, k, span)
                yield rows(keys, np.array(owners)[of], at, h)

    return run


def paths(df: DataFrame, key: str, text: str, k: int, span: int) -> DataFrame:
    """(head, doc, start, stop): where each compacted path lies in each record; in code points, stop exclusive."""
    long = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= span)
    kmers = long.mapInArrow(_kmers(k, span), f"h long, doc {dict(df.dtypes)[key]}, at int")
    # Hot k-mers are combined in each task; only (k-mer, two records) moves. The join below may be split by AQE if skewed.
    repeated = kmers.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h")
    nodes = cut_lineage(kmers.join(repeated, "h", "left_semi"))
    along = W.partitionBy("doc").orderBy("at")
    gap_in, gap_out = F.col("at") - F.lag("at").over(along), F.lead("at").over(along) - F.col("at")
    edges = nodes.select(
        "h",
        F.coalesce(F.xxhash64(F.lag("h").over(along), gap_in), F.lit(0)).alias("came"),
        F.coalesce(F.xxhash64(F.lead("h").over(along), gap_out), F.lit(0)).alias("went"),
    )
    ways = edges.groupBy("h").agg((F.min("came") == F.max("came")).alias("one_in"), (F.min("went") == F.max("went")).alias("one_out"))
    joined = nodes.join(ways, "h")
    linked = F.coalesce(F.col("one_in") & F.lag("one_out").over(along) & (gap_in <= k), F.lit(False))
    starts = joined.withColumn("head_at", F.when(~linked, F.col("at"))).withColumn("head_h", F.when(~linked, F.col("h")))
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    named = starts.select("doc", "at", F.last("head_at", True).over(so_far).alias("start"), F.last("head_h", True).over(so_far).alias("head"))
    return named.groupBy("head", "doc", "start").agg((F.max("at") + k).cast("int").alias("stop"))


def windows(df: DataFrame, places: DataFrame, key: str, text: str, span: int, first, last) -> DataFrame:
    """(w1, w2, doc, at): hashes of the windows of ``span`` code points that begin from ``first`` to ``last`` in each place."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    needed = F.broadcast(places.select(bucket("doc").alias("bucket")).distinct())  # at most BUCKETS rows
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= span)
    texts = texts.withColumn("bucket", bucket("doc")).join(needed, "bucket", "left_semi").drop("bucket")
    bounds = places.select("doc", F.greatest(first, F.lit(0)).cast("int").alias("lo"), last.cast("int").alias("hi")).where("lo <= hi").distinct()
    around = texts.join(bounds, "doc")
    around = around.select("doc", "lo", F.least("hi", F.length("text") - span).alias("hi"), F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo") + span).alias("part"))
    each = around.where("lo <= hi").select("doc", "lo", "part", F.explode(F.sequence("lo", "hi")).alias("at"))
    window = F.substring("part", F.col("at") - F.col("lo") + 1, F.lit(span))
    return each.select(F.xxhash64(window).alias("w1"), F.hash(window).alias("w2"), "doc", "at").distinct()


def shared_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(a, b), a < b: all pairs of records that share a run of at least ``span`` code points, whole copies included.

    The rows are as many as there are such pairs; where groups of copies are large, ``shared_amount`` says for each record
    what it shares without listing partners.
    """
    if not 0 < k <= span:
        raise ValueError("k must be from 1 to span")
    found = cut_lineage(paths(df, key, text, k, span))
    long = found.where(F.col("stop") - F.col("start") >= span).select("head", "doc").distinct()
    short = found.where(F.col("stop") - F.col("start") < span)
    near = windows(df, short, key, text, span, F.col("stop") - span, F.col("start"))
    cross = lambda rows, on: (
        rows.select(*on, F.col("doc").alias("a")).join(rows.select(*on, F.col("doc").alias("b")), on).where("a < b").select("a", "b")
    )
    return cross(long, ["head"]).unionByName(cross(near.select("w1", "w2", "doc").distinct(), ["w1", "w2"])).distinct()


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(doc, start, stop): the parts of each record, merged, whose every point lies in a run shared with another record."""
    found = cut_lineage(paths(df, key, text, k, span))
    inside = found.where(F.col("stop") - F.col("start") >= span).select("doc", "start", "stop")
    ends = [(F.col("start") - (span - k), F.least(F.col("start"), F.col("stop") - k)), (F.greatest(F.col("stop") - span, F.col("start") - (span - k)), F.col("stop") - k)]
    near = [windows(df, found, key, text, span, lo, hi) for lo, hi in ends]
    around = near[0].unionByName(near[1]).distinct()
    twice = around.groupBy("w1", "w2").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("w1", "w2")
    outer = around.join(twice, ["w1", "w2"], "left_semi").select("doc", F.col("at").alias("start"), (F.col("at") + span).alias("stop"))
    runs = inside.unionByName(outer)
    order = W.partitionBy("doc").orderBy("start", "stop")
    new = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    numbered = runs.withColumn("new", new.cast("int")).withColumn("n", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("n")


def shared_amount(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(doc, n_spans, shared, share): for every record how many code points of it are shared; share is null for no text."""
    spans = shared_spans(df, key, text, span, k).groupBy("doc").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("stop") - F.col("start")).alias("shared"))
    rows = df.select(F.col(key).alias("doc"), F.length(text).alias("n")).join(spans, "doc", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc", F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("shared", zero).alias("shared"), F.try_divide(F.coalesce("shared", zero), F.col("n")).alias("share"))
