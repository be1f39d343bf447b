"""Sources, sinks, command line, streams, sessions and the driver's entry."""

import csv
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from differential import compare, duck
from wordtide import cli
from wordtide.monitor import SystemMonitor
from wordtide.plans import core
from wordtide.session import cut_lineage
from wordtide.sources import tables
from wordtide.streaming import word_views as S

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_word_lines_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes(b"good\nba\xffd\n\nlast")
    assert [r.word for r in tables.read_word_lines(spark, str(tmp_path / "w.txt")).collect()] == ["good", "bad", "", "last"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2]), ('q"', [])], "w string, l array<int>").withColumn("l", F.transform("l", lambda x: x.cast("string")))
    tables.write_table(df, f"{tmp_path}/o.parquet")
    tables.write_table(df, f"{tmp_path}/o.parquet")
    assert tables.row_count(spark, f"{tmp_path}/o.parquet").first().n_rows == 2
    out = tables.parquet_to_csv(spark, f"{tmp_path}/o.parquet")
    got = spark.read.option("escape", '"').csv(out, header=True).collect()
    assert sorted((r.w, r.l) for r in got) == [("a", "1 2"), ('q"', None)]
    with pytest.raises(ValueError):
        tables.write_table(df, f"{tmp_path}/o.txt")
    with pytest.raises(FileNotFoundError):
        tables.parquet_to_csv(spark, f"{tmp_path}/none.parquet")


def test_run_log(tmp_path):
    path = str(tmp_path / "log.csv")
    tables.append_run_log(path, "e", 1.25, ("w", 3))
    tables.append_run_log(path, "e", 2, None)
    assert list(csv.reader(open(path))) == [["engine", "elapsed_seconds", "top_word", "top_views"], ["e", "1.250000", "w", "3"], ["e", "2.000000", "", ""]]


def test_spread_leaves_large_inputs(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/videos.parquet")
    assert "RoundRobin" in tables.spread(df)._jdf.queryExecution().toString()
    monkeypatch.setattr(tables, "SPREAD_BELOW_BYTES", 1)
    assert "RoundRobin" not in tables.spread(df)._jdf.queryExecution().toString()


def test_temp_table(spark):
    with tables.temp_table(spark.range(3), "held") as held:
        assert spark.table("held").count() == 3 and held.is_cached
    assert not spark.catalog.tableExists("held") and not held.is_cached


def test_system_monitor(tmp_path):
    (tmp_path / "stat").write_text("cpu  1 0 1 8 0 0 0 0\n")
    (tmp_path / "meminfo").write_text("MemTotal: 4096 kB\nMemAvailable: 1024 kB\n")
    seen = []
    with SystemMonitor(lambda *x: seen.append(x), 0.01, str(tmp_path)) as m:
        time.sleep(0.2)
    assert seen and m.memory() == (3, 4) and m.peak_mb == 3
    with SystemMonitor(seconds=0.01, proc=str(tmp_path / "none")) as none:
        time.sleep(0.05)
    assert none.peak_mb == 0


def test_env_file(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# comment\nWORDTIDE_TOP_K=7\nexport WORDTIDE_TEXT='body'\nOTHER=1\nno pair\n")
    assert (cli.settings({}).top_k, cli.settings({}).text) == (7, "body")
    monkeypatch.setenv("WORDTIDE_TOP_K", "9")
    assert cli.settings({}).top_k == 9 and cli.settings({"top_k": 2}).top_k == 2


def test_queries_by_name(spark, tmp_path):
    s = cli.Settings(dataset=f"{SMALL}/videos.parquet", results_dir=str(tmp_path))
    rows, _ = cli.timed_run(spark, "row_count", s)
    assert rows[0].n_rows > 0
    with pytest.raises(ValueError):
        cli.find_run("no such query")


def test_cut_lineage_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Frame:
        class sparkSession:
            sparkContext = Context
            conf = {}

    with pytest.raises(ValueError, match="share"):
        cut_lineage(Frame)


def test_entry_without_what_the_subpackage_needs():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'top_words' in q and 'p7_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_settings(monkeypatch):
    monkeypatch.setenv("WORDTIDE_TOP_K", "9")
    monkeypatch.setenv("WORDTIDE_OTHER", "x")
    assert cli.settings({}).top_k == 9 and cli.settings({"top_k": 2, "word": "x", "vocab": None}).top_k == 2
    with pytest.raises(ValueError):
        cli.settings({"top_k": 0})


def test_runs(spark, tmp_path):
    (tmp_path / "v.txt").write_text("storm\nriver\nthe\n")
    s = cli.settings({"dataset": f"{SMALL}/videos.parquet", "vocab": str(tmp_path / "v.txt"), "results_dir": str(tmp_path / "r"), "top_k": 1})
    seen = []
    rows, took = cli.timed_run(spark, "top", s, seen.append)
    assert len(rows) == 1 and took > 0 and spark.read.parquet(f"{tmp_path}/r/top.parquet").count() == 1
    assert len((tmp_path / "r" / "runs.csv").read_text().splitlines()) == 2
    assert [m for m, _ in cli.sweep(spark, "all", s, [16, 64])] == [16, 64]
    with pytest.raises(ValueError):
        cli.timed_run(spark, "none", s)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("WORDTIDE_RESULTS_DIR", str(tmp_path))
    common = ["--dataset", f"{SMALL}/videos.parquet"]
    assert cli.main(["run", *common, "-k", "2", "-m"]) == 0
    assert "Query time:" in capsys.readouterr().out
    assert cli.main(["diff", *common, "--out", f"{tmp_path}/d.csv"]) == 0 and (tmp_path / "d.csv").is_dir()
    assert cli.main(["rows", *common, "--word", "storm"]) == 0
    assert "views_fused" in capsys.readouterr().out


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/videos.parquet").select("desc", "views", "posted_at")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    vocab = core.vocab(spark, SMALL)
    S.to_memory(S.streaming_word_views(stream, vocab), "totals").awaitTermination()
    assert {tuple(r) for r in spark.table("totals").collect()} == {tuple(r) for r in core.word_views_all(spark, SMALL).collect()}
    S.to_memory(S.windowed_word_views(stream.withColumn("posted_at", F.col("posted_at").cast("timestamp")), "posted_at", "365 days", "36500 days"), "windows", "append").awaitTermination()
    assert spark.table("windows").columns == ["start", "word", "total_views"]


def test_checkpoint_goes_to_the_session_folder(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_core_queries_against_sql(spark, name):
    assert compare(spark, duck(SMALL), name, core.QUERIES[name], core.SQL[name], SMALL) == ""


def test_queries_on_empty_tables(spark, tmp_path):
    for name in ("videos", "documents", "vocabulary", "stopwords", "tokenizer_cases", "run_log"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in core.QUERIES.items():
        assert query(spark, str(tmp_path)).count() in (0, 1), name


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_the_training_operators(tmp_path):
    code = (
        "import sys; sys.modules['wordtide.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'top_words' in q and 'p4_found' in q and 'p1_found' not in q\n"
        "assert not any(m.startswith('wordtide.llm.') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
