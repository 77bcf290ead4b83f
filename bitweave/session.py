"""Session helpers: a tuned session for tests and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bitweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use the one you are given."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BITWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint directory.

    Only where neither is set and all runs in this process, as in tests, a temporary one; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="bitweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scopes = threading.local()


class Staging:
    """What :func:`stage` writes while it is entered, in this thread; innermost first. Nothing else is ever deleted.

        with Staging(spark) as own:
            result = stage(f(...))
        own.sweep(result)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Staging:
        _scopes.open = [*getattr(_scopes, "open", []), self]
        return self

    def __exit__(self, *_) -> None:
        _scopes.open = _scopes.open[:-1]

    def sweep(self, *keep: DataFrame) -> None:
        """Deletes the tables of this scope, but for those that ``keep`` reads; for use once a result is written."""
        held = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in keep for f in df.inputFiles()}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for at in list(self.paths):
            if at.split(":", 1)[-1].lstrip("/") not in held:
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)
                self.paths.remove(at)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def unshuffled(spark: SparkSession):
    """Shuffle files of what runs meanwhile are removed at its end; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write as a table in the shared folder and read it back: cuts lineage, columnar and compressed.

    The shuffle files of the write are no use afterwards and are removed at its end.
    """
    spark = df.sparkSession
    at = fresh_path(spark, name)
    with unshuffled(spark):
        df.write.parquet(at)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].paths.append(at)
    return spark.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
