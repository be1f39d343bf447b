"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What suits text work: small splits, adaptive re-planning, Arrow batches that keep a Python worker small.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, name: str = "wordtide", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    spark = builder.config(map=CONF | {"spark.sql.shuffle.partitions": str(cores)}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoints into the cluster's shared folder, so that a lost executor costs no recomputation and no data.

    The folder is the session's. Where none is set, one of this machine is, but only if all executors run on it; it is
    removed at the end.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or _own_folder("wordtide-checkpoint-"))
    return df.checkpoint(eager=True)


def _own_folder(prefix: str) -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once a session; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_wordtide_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        folder = _own_folder("wordtide-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "wordtide"), "zip", os.path.dirname(package), os.path.basename(package)))
        sc._wordtide_shipped = True
    return spark
