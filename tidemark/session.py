"""Session helpers: a local builder for tests and the lineage cut every iterative operator uses."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the oracle comparison needs (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session in which none is set gets its own.

    A ``RuntimeError`` where executors on other machines could not read what is written.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        have = spark.sparkContext.getCheckpointDir()
    return found or have


_written: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Unlike a cache this survives the loss of executors and cuts the lineage of iterative
    plans. Catalyst sees compressed file sizes, many times smaller than the rows in memory:
    joins of such tables carry a ``merge`` hint or are ``bounded``, so that none is broadcast
    by its file size. The files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_delete_written)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` written once and counted: to be broadcast if it has at most ``most`` rows, to be merge-joined beyond."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df``, the rows of a scan, in as many partitions as the cluster has cores at least, for work that is heavy a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete_written() -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    try:
        for path in _written:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def ship(spark: SparkSession) -> None:
    """Makes this package importable on Python workers that don't have it on their path.

    Does nothing where PYTHONPATH already holds it (as on a cluster that is set up for it);
    else the driver serves the package to the executors.
    """
    home = Path(__file__).resolve().parents[1]
    held = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if home in held or getattr(sc, "_tidemark_shipped", False):
        return
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark"), "zip", home, "tidemark")
    sc.addPyFile(archive)
    sc._tidemark_shipped = True
