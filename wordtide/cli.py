"""Command line: ``python -m wordtide.cli run|sweep|csv|rows|diff``.

Options given on the line override those from the environment (prefix ``WORDTIDE_``, unknown names ignored), which
override those of a file ``.env`` in the working folder, which override the defaults. ``-q`` takes ``top``, ``all``, or the
name of any query of ``plans.core``, which reads the tables of the dataset's folder.
"""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from wordtide.monitor import SystemMonitor
from wordtide.operators import diagnostics, vocabulary, wordviews
from wordtide.plans import core
from wordtide.session import CONF, ship
from wordtide.sources import tables


@dataclasses.dataclass(frozen=True)
class Settings:
    dataset: str = "datasets/videos.parquet"
    vocab: str | None = None
    stopwords: str | None = None
    min_word_length: int = 3
    results_dir: str = "results"
    top_k: int = 5
    text: str = "desc"
    metric: str = "views"
    master: str = "local[*]"

    def __post_init__(self):
        if self.min_word_length <= 0 or self.top_k <= 0:
            raise ValueError("min_word_length and top_k must be positive")


def env_file(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, if there is one; comments and other lines are passed over, quotes around a value dropped."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {name.strip(): value.strip().strip("\"'") for name, _, value in pairs}


def settings(given: dict) -> Settings:
    """Defaults, then the file ``.env``, then the environment, then what was given and is not None."""
    fields = {f.name: f.type for f in dataclasses.fields(Settings)}
    named = env_file() | os.environ
    env = {n: named[f"WORDTIDE_{n.upper()}"] for n in fields if f"WORDTIDE_{n.upper()}" in named}
    both = env | {k: v for k, v in given.items() if v is not None and k in fields}
    return Settings(**{k: int(v) if fields[k] == "int" else v for k, v in both.items()})


def words_of(spark: SparkSession, s: Settings) -> DataFrame | None:
    """The vocabulary without the stopwords; either file may be missing."""
    if not s.vocab:
        return None
    stop = tables.read_word_lines(spark, s.stopwords) if s.stopwords else None
    return vocabulary.vocabulary(tables.read_word_lines(spark, s.vocab), stop, s.min_word_length)


#: Named queries of the command line.
RUNS: dict[str, Callable[[SparkSession, Settings], DataFrame]] = {
    "top": lambda spark, s: wordviews.top_words(spark.read.parquet(s.dataset), words_of(spark, s), s.top_k, s.text, s.metric),
    "all": lambda spark, s: wordviews.word_views(spark.read.parquet(s.dataset), words_of(spark, s), s.text, s.metric),
}


def find_run(name: str) -> Callable[[SparkSession, Settings], DataFrame]:
    """A query by its name."""
    if name in RUNS:
        return RUNS[name]
    if name in core.QUERIES:
        return lambda spark, s: core.QUERIES[name](spark, os.path.dirname(s.dataset) or ".")
    raise ValueError(f"{name}: expected one of {sorted([*RUNS, *core.QUERIES])}")


@contextmanager
def progress(spark: SparkSession, report: Callable[[float], None] | None) -> Iterator[None]:
    """Reports the share of finished tasks of the running stages, some times a second, while the block runs."""
    done = threading.Event()

    def watch() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not done.wait(0.3):
            stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
            total = sum(x.numTasks for x in stages if x)
            if total:
                report(100 * sum(x.numCompletedTasks for x in stages if x) / total)

    thread = threading.Thread(target=watch, daemon=True)
    if report:
        thread.start()
    try:
        yield
    finally:
        done.set()
        if report:
            thread.join()


def timed_run(spark: SparkSession, name: str, s: Settings, report: Callable[[float], None] | None = None) -> tuple[list, float]:
    """Runs a query; the clock covers the collection of its rows only. Writes the result and the run log afterwards."""
    df = find_run(name)(spark, s)
    with progress(spark, report):
        t = time.perf_counter()
        rows = df.collect()
        took = time.perf_counter() - t
    os.makedirs(s.results_dir, exist_ok=True)
    tables.write_table(spark.createDataFrame(rows, df.schema), f"{s.results_dir}/{name}.parquet")
    best = min(rows, key=lambda r: (-r["total_views"], r["word"]), default=None) if {"word", "total_views"} <= set(df.columns) else None
    tables.append_run_log(f"{s.results_dir}/runs.csv", name, took, best and (best["word"], best["total_views"]))
    return rows, took


def sweep(spark: SparkSession, name: str, s: Settings, partition_mib: list[int]) -> list[tuple[int, float]]:
    """Seconds of a query for several sizes of file splits."""
    out = []
    for mib in partition_mib:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{mib}m")
        out.append((mib, timed_run(spark, name, s)[1]))
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wordtide")
    parser.add_argument("action", choices=("run", "sweep", "csv", "rows", "diff"))
    parser.add_argument("-q", "--query", default="top")
    parser.add_argument("-k", "--top-k", type=int)
    parser.add_argument("-m", "--monitor", action="store_true", help="show progress")
    parser.add_argument("--word", help="for rows: the word whose rows are shown")
    parser.add_argument("--key", default="row_id")
    parser.add_argument("--out", help="for diff: where the sample goes, .parquet or .csv")
    for name in ("dataset", "vocab", "stopwords", "results-dir", "text", "metric", "master"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--min-word-length", type=int)
    args = parser.parse_args(argv)
    s = settings(vars(args))
    spark = ship(SparkSession.builder.master(s.master).appName("wordtide").config(map=CONF).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if args.action == "csv":
        print(tables.parquet_to_csv(spark, s.dataset))
    elif args.action == "rows":
        diagnostics.attribution(spark.read.parquet(s.dataset), args.word, args.key, s.text, s.metric).show(truncate=False)
        diagnostics.difference_rows(spark.read.parquet(s.dataset), args.word, args.key, s.text, s.metric).limit(20).show(truncate=80)
        diagnostics.word_rows(spark.read.parquet(s.dataset), args.word, args.key, s.text, s.metric).limit(20).show(truncate=80)
    elif args.action == "diff":
        sample = diagnostics.mismatch_sample(spark.read.parquet(s.dataset), key=args.key, text=s.text, metric=s.metric)
        print(tables.write_table(sample, args.out or f"{s.results_dir}/tokenizer_mismatches.parquet"))
    elif args.action == "sweep":
        for mib, seconds in sweep(spark, args.query, s, [16, 64, 128, 256]):
            print(f"{mib} MiB: {seconds:.3f} s")
    else:
        report = (lambda p: print(f"\r{p:5.1f} %", end="", file=sys.stderr)) if args.monitor else None
        with SystemMonitor() as system:
            rows, took = timed_run(spark, args.query, s, report)
        for r in rows[: s.top_k]:
            print("\t".join(map(str, r)))
        print(f"Query time: {took:.3f} s")
        if args.monitor:
            print(f"Peak: {system.peak_cpu:.0f} % CPU, {system.peak_mb} MB of memory", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
