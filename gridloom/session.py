"""Session factory and the few helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gridloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, Arrow and UTC; None for ``master`` or ``shuffle_partitions`` keeps what the cluster set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="gridloom-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)


_TABLES: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Remove all tables and files that were written so far; results that aren't collected or written yet can't be read
    afterwards. A long session calls it between its jobs, else they go when the driver's Python ends."""
    while _TABLES:
        _remove(*_TABLES.pop())


atexit.register(release)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, for sessions whose workers can't import it; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="gridloom-package-")  # on the driver, from where Spark serves it while the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "gridloom"), "zip", root, "gridloom"))
    sc._gridloom_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, removed by release()."""
    path = f"{checkpoint_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once, write it to the shared checkpoint folder and return the written table.

    Cuts the lineage so that a lost executor costs a re-read and not a re-run, and gives the optimizer exact sizes.
    The files go with release() or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
