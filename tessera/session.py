"""Session settings shared by the library, its tests and its benches."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tessera", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster, pass your own session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. A local session that names none (tests, a
    laptop) gets a folder of its own; a cluster must name one, since a machine's own folder isn't shared.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data go: the folder in ``spark.checkpoint.dir``, or one of this machine if the session is local; an error on a cluster that names none."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder(sc.applicationId)


@functools.cache
def _own_folder(application: str) -> str:
    at = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    atexit.register(shutil.rmtree, at, True)
    return at


def task_count(spark: SparkSession) -> int:
    """Partitions for a shuffle that Spark can't size by itself: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan of fewer partitions than there are cores, spread over them; others stay as they are.

    For expensive work per row on small tables. Pass a scan with its columns chosen, no plan that shuffles.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@functools.cache
def _ship(application: str, sc) -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    at = tempfile.mkdtemp(prefix="tessera-package-")  # the driver serves it from here as long as it runs
    atexit.register(shutil.rmtree, at, True)
    name = os.path.basename(here)
    shutil.copytree(here, f"{at}/root/{name}", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(f"{at}/{name}", "zip", f"{at}/root"))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers of a session, once: they may not find it where the driver does."""
    _ship(spark.sparkContext.applicationId, spark.sparkContext)
    return spark
