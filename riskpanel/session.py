"""Session helpers: a local session for tests and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskpanel")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the one the cluster names in `spark.checkpoint.dir`, removed when its JVM ends.

    Only a local master may fall back to a temporary folder, because executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_riskpanel_folder", None) is None:
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            base = tempfile.mkdtemp(prefix="riskpanel-")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/panel-{uuid.uuid4().hex}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._riskpanel_folder = fs.makeQualified(path).toString()
    return sc._riskpanel_folder


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What `cut_lineage` writes inside is removed at the end, unless it is told to keep it."""
    sc, path = spark.sparkContext, f"{shared_folder(spark)}/passing-{uuid.uuid4().hex}"
    before, sc._riskpanel_passing = getattr(sc, "_riskpanel_passing", None), path
    try:
        yield
    finally:
        sc._riskpanel_passing = before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, keep: bool = False, lean: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read on from there: later steps read only the columns they use.

    `lean` is for large tables: the shuffles behind them are removed once they are written.
    """
    spark = df.sparkSession
    folder = None if keep else getattr(spark.sparkContext, "_riskpanel_passing", None)
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}"
    with _shuffles_removed(spark) if lean else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python tasks can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_riskpanel_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="riskpanel-code-"), "riskpanel"), "zip", root, "riskpanel")
    sc.addPyFile(archive)
    sc._riskpanel_shipped = True
