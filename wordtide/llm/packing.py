"""Problem 8: items of varying length into containers of fixed capacity.

Documents are put in an order in which neighbours are alike: their hashed token counts are projected to ``DIMENSIONS``
dimensions, the direction is laid on a grid, and the grid's cells are numbered along a Hilbert curve. Range-sorting by that
number gives every task a stretch of the curve. Along it, the documents of a block are packed by best fit from the largest
down, into containers that stay open for the next blocks while they have room. Only what exceeds the capacity by itself is
cut, into full containers and one rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm import tokens
from wordtide.session import cut_lineage

DIMENSIONS, BITS, BUCKETS = 3, 10, 1 << 12
#: Documents of one task at most, and at least if all cores have that many; a task leaves some open containers unfilled for
#: each capacity, so shorter stretches of the curve waste more.
ROWS_PER_TASK, LEAST_ROWS = 200_000, 1_000
#: Documents that are packed together, and containers kept open between such blocks.
BLOCK, OPEN = 4096, 512


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of grid cells, one a row (after Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            flip = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ flip)
            x[i] = np.where(on, x[i], x[i] ^ flip)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The curve number of each document from its token ids; the same ids give the same number everywhere."""
    directions = np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS))
    lengths = np.array([len(x) for x in ids])
    sums = np.zeros((len(ids), DIMENSIONS))
    full = np.flatnonzero(lengths)
    if len(full):
        hashed = (np.concatenate([ids[i] for i in full]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        starts = np.cumsum([0, *lengths[full]])[:-1]
        sums[full] = np.add.reduceat(directions[hashed.astype(np.int64)], starts, axis=0)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    cells = np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_index(cells, BITS)


class Packer:
    """Containers of one capacity; ``add`` takes a block of items and gives the rows placed."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.made = capacity, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by free space
        self.mask = 0  # bit s: there is one with s free

    def _place(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            container = self.open[free].pop()
            if not self.open[free]:
                self.mask &= ~(1 << free)
        else:
            free, container = self.capacity, self.made
            self.made += 1
        free -= size
        if free:
            self.open[free].append(container)
            self.mask |= 1 << free
        return container

    def add(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(item, piece, first token, tokens, container) of each piece."""
        rows, rests = [], []
        for i, size in enumerate(sizes):
            piece = at = 0
            while size - at > self.capacity or size - at == self.capacity:
                rows.append((i, piece, at, self.capacity, self.made))
                self.made += 1
                piece, at = piece + 1, at + self.capacity
            if size > at or size == 0:
                rests.append((size - at, i, piece, at))
        for size, i, piece, at in sorted(rests, key=lambda r: (-r[0], r[1])):
            rows.append((i, piece, at, size, self._place(size)))
        self._close()
        return rows

    def _close(self) -> None:
        """Keeps the ``OPEN`` containers with the most room."""
        kept = 0
        for free in range(self.capacity, 0, -1):
            have = self.open[free]
            if have and kept + len(have) > OPEN:
                self.open[free] = have[len(have) - max(0, OPEN - kept) :] if kept < OPEN else []
                if not self.open[free]:
                    self.mask &= ~(1 << free)
            kept += len(have)


def pack(df: DataFrame, capacities: dict[int, int], key: str = "doc_id", text: str = "text", rows_per_task: int = ROWS_PER_TASK, **tokenizer) -> DataFrame:
    """(pack_id, container, key, piece, first_token, n_tokens): where every part of every text lies, for each capacity.

    ``capacities`` names capacities in tokens by id. Null texts are no items; empty ones are, of size 0. No container
    holds more than its capacity, and a text is in several pieces only if it is longer. The key must be unique.
    """
    items = tokens.sized(df, key, text, describe=("curve", T.LongType(), curve_keys), **tokenizer)
    items = cut_lineage(items)  # three numbers a document; the sort would otherwise encode all texts twice
    count = items.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(count / rows_per_task), min(cores, count // LEAST_ROWS))
    tie = F.xxhash64(key)  # splits a cell that holds many documents
    line = items.repartitionByRange(parts, "curve", tie).sortWithinPartitions("curve", tie).withColumn("task", F.spark_partition_id())
    key_field = items.schema[key]
    schema = T.StructType(
        [T.StructField("pack_id", T.LongType()), T.StructField("container", T.LongType()), key_field]
        + [T.StructField(n, T.LongType()) for n in ("piece", "first_token", "n_tokens")]
    )
    names = [f.name for f in schema.fields]
    wanted = sorted(capacities.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = {i: Packer(c) for i, c in wanted}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sizes, task = part.column(1).to_pylist(), part.column(2)[0].as_py()
                for pack_id, packer in packers.items():
                    rows = np.array(packer.add(sizes), dtype=np.int64).reshape(-1, 5)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), pack_id)), pa.array((task << 40) + rows[:, 4]), part.column(0).take(pa.array(rows[:, 0])), *(pa.array(rows[:, j]) for j in (1, 2, 3))],
                        names=names,
                    )

    return line.select(key, "n_tokens", "task").mapInArrow(run, schema)


def fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_id, capacity, containers, tokens, filled): the share of space used, for each capacity; keyed as ``pack_sizes``."""
    used = placed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n"))
    total = used.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    sized = capacities.select(F.col("pack_id").cast("bigint").alias("pack_id"), F.col("capacity").cast("bigint").alias("capacity"))
    return sized.join(total, "pack_id").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
