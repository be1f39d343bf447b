"""Problem 9: a mix of sources that meets target shares of the total size.

The size asked for is cut into equal-token blocks, which are apportioned to the sources by highest quotients (Sainte-Lague),
with the repetitions allowed as a cap. A source's records are dealt by a seeded hash into shards of bounded size, put into
seeded order, and each shard is cut into equally many blocks, a record belonging to the block in which its middle lies. As
all shards of a source have the same number of blocks, highest quotients give each shard one block a round, in seeded order
of the shards. A source's quota is filled by all its blocks equally often, and for the rest round by round, each shard
beginning at a seeded block of its own. The rounds are counted by the tokens that their blocks really hold, so neither the
size of shards nor records that stand out of a block shift the shares.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordtide.llm import tokens
from wordtide.session import cut_lineage

#: Blocks that the mix is apportioned in; shares are met to one part in so many.
BLOCKS = 20_000
#: Tokens of a shard, about: what one task sorts.
SHARD_TOKENS = 64_000_000
#: Steps in which a source's blocks are counted and taken, which is the most that the driver gets for each target; and
#: blocks that a shard has at least. Few shards have more, so that a step is never a larger part of the source.
STEPS, SHARD_BLOCKS = 4096, 64


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Integer quotas that sum to ``seats``, or to all caps if these are fewer: each next seat to the highest quotient
    weight / (2 * quota + 1), ties to the first. Caps and weights of zero take none."""
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    quotas = [0] * len(weights)
    seats = min(seats, sum(caps[i] for i in open_))
    # A start below the result: rounding down can't pass it, as quotas differ from the exact share by less than one a party.
    while open_ and seats - sum(quotas) > 4 * len(open_):
        left, total = seats - sum(quotas), sum(weights[i] for i in open_)
        scale = (sum(quotas[i] for i in open_) + left) / total
        goal = {i: min(caps[i], max(quotas[i], math.floor(weights[i] * scale) - len(weights))) for i in open_}
        if all(goal[i] == quotas[i] for i in open_):
            break
        for i in open_:
            quotas[i] = goal[i]
        open_ = [i for i in open_ if quotas[i] < caps[i]]
    heap = [(-weights[i] / (2 * quotas[i] + 1), i) for i in open_]
    heapq.heapify(heap)
    for _ in range(seats - sum(quotas)):
        _, i = heapq.heappop(heap)
        quotas[i] += 1
        if quotas[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * quotas[i] + 1), i))
    return quotas


def mix(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    blocks: int = BLOCKS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = 0,
    **tokenizer,
) -> DataFrame:
    """(key, source, n_tokens, repeats): the records of the mix and how often each is used, never above ``max_repeats``.

    ``targets`` (source, target_share, max_repeats) is small. Without ``total_tokens`` the mix is the largest in which all
    sources that have records can reach their targets; if more is asked for than caps allow, the others fill up. Records
    with null or empty text, a null source or one without a target are not used. An empty table gives an empty mix.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect() if r["source"] is not None}
    spark = df.sparkSession
    sized = tokens.sized(df.where(F.col(source).isin(*goals)), key, text, (source,), **tokenizer).where("n_tokens > 0")
    sized = cut_lineage(sized.select(F.col(key).alias("k"), F.col(source).alias("s"), "n_tokens"))
    supply = {r["s"]: r["n"] for r in sized.groupBy("s").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a target
    quotas = token_quotas({s: (n, *goals[s]) for s, n in supply.items()}, total_tokens, blocks)

    dealing = [(s, n, max(1, math.ceil(n / shard_tokens))) for s, n in supply.items()]
    # A shard's blocks, and the parts that a round of all shards is cut into: their product is STEPS.
    dealing = [(s, n, b := max(SHARD_BLOCKS, 1 << max(0, (STEPS // n).bit_length() - 1)), STEPS // b) for s, _, n in dealing]
    shards = spark.createDataFrame(dealing, "s string, shards int, blocks int, parts int")
    dealt = sized.join(F.broadcast(shards), "s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "k"), "shards").cast("int"))
    shard = W.partitionBy("s", "shard")
    along = shard.orderBy(F.xxhash64(F.lit(seed), "k"), "k").rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("n_tokens").over(along), F.lit(0)) + F.col("n_tokens") / 2
    block = F.floor(middle * F.col("blocks") / F.sum("n_tokens").over(shard)).cast("int")
    start = lambda n, width: F.pmod(F.xxhash64(F.lit(n), "s", "shard"), F.col(width)).cast("int")
    turn = F.pmod(F.least(block, F.col("blocks") - 1) - start(seed + 2, "blocks"), F.col("blocks"))
    step = turn * F.col("parts") + start(seed + 3, "parts")
    cut = cut_lineage(dealt.withColumn("step", step).select("k", "s", "n_tokens", "step"))

    held: dict[str, list[tuple[int, int]]] = {s: [] for s in supply}
    for r in cut.groupBy("s", "step").agg(F.sum("n_tokens").alias("n")).orderBy("s", "step").collect():  # at most STEPS a target
        held[r["s"]].append((r["step"], r["n"]))
    taken = spark.createDataFrame([(s, step) for s in supply for step in _steps(held[s], quotas[s] % supply[s])], "s string, step int")
    every = spark.createDataFrame([(s, quotas[s] // supply[s]) for s in supply], "s string, every long")
    out = cut.join(F.broadcast(every), "s").join(F.broadcast(taken.withColumn("once", F.lit(1))), ["s", "step"], "left")
    out = out.withColumn("repeats", (F.col("every") + F.coalesce("once", F.lit(0))).cast("int")).where("repeats > 0")
    return out.select(F.col("k").alias(key), F.col("s").alias(source), "n_tokens", "repeats")


def token_quotas(supply: dict[str, tuple[int, float, int]], total: int | None, blocks: int) -> dict[str, int]:
    """Tokens that each source (supply, target share, repetitions allowed) gives to the mix: whole blocks by highest
    quotients, or all that it may give."""
    names = sorted(supply)
    most = [supply[s][0] * supply[s][2] for s in names]
    weights = [supply[s][1] for s in names]
    if total is None:
        total = math.floor(min((m / (w / sum(weights)) for m, w in zip(most, weights, strict=True) if w > 0), default=0))
    block = max(1, total / blocks)
    seats = sainte_lague(weights, round(total / block), [math.ceil(m / block) for m in most])
    return {s: min(m, round(n * block)) for s, n, m in zip(names, seats, most, strict=True)}


def _steps(held: list[tuple[int, int]], goal: int) -> list[int]:
    """Steps in order whose tokens come to the goal; one that holds more than is open is passed over, unless no other brings
    the sum as near."""
    taken, open_, over = [], goal, None
    for step, n in held:
        if n <= open_:
            taken.append(step)
            open_ -= n
        elif over is None or n < over[1]:
            over = (step, n)
    if over and over[1] - open_ < open_ and over[0] not in taken:
        taken.append(over[0])
    return taken


def shares(mixed: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, n_records, tokens, actual_share, most_repeats) for every target."""
    got = mixed.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    zero = F.lit(0).cast("bigint")
    rows = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(got, source, "left")
    rows = rows.withColumns({"n_records": F.coalesce("n_records", zero), "tokens": F.coalesce("tokens", zero), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    return rows.withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy())))
