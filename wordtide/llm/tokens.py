"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's folder is a parameter and is not part of this library."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie, unless the environment names another folder.
FOLDER = os.environ.get("WORDTIDE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return _encoding(f.read()).encode_ordinary


def small_words(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> set[str]:
    """Words in small letters that have a token of their own: ordinary words of many languages, hardly any names."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        raw = [base64.b64decode(line.split()[0]) for line in f.read().splitlines()]
    listed = (x.decode("utf-8", "replace") for x in raw if x.startswith(b" ") and len(x) > 3)
    return {w for x in listed if (w := x[1:]).isalpha() and w.islower()}


def sized(
    df: DataFrame,
    key: str,
    text: str,
    also: tuple[str, ...] = (),
    folder: str = FOLDER,
    vocabulary: str = VOCABULARY,
    describe: tuple[str, T.DataType, Callable[[list[np.ndarray]], np.ndarray]] | None = None,
) -> DataFrame:
    """(key, also..., n_tokens) of the rows whose text is not null; an empty text has no tokens.

    ``describe`` adds a column made from a batch's token ids. The file is read on the driver and broadcast (about a
    megabyte), so executors need no copy of the folder. Whole texts are encoded, in Arrow batches; nothing is shuffled.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.where(F.col(text).isNotNull()).select(key, *also, text)
    fields = [*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]
    if describe:
        fields.append(T.StructField(describe[0], describe[1]))
    names, kept, make = [f.name for f in fields], len(also) + 1, describe and describe[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds the ids held at once
                part = batch.slice(at, 1024)
                ids = [np.array(encode(t), dtype=np.int32) for t in part.column(kept).to_pylist()]
                columns = [*part.columns[:kept], pa.array([len(x) for x in ids], pa.int64())]
                if make:
                    columns.append(pa.array(make(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, T.StructType(fields))
