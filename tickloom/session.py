"""Session helpers: sessions for tests and benches, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import Executor, Future

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "8g", app: str = "tickloom", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need not find it on
    their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tickloom.zip")  # served by the driver
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("tickloom", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._tickloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where that setting is absent (a local session) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def started(pool: Executor, spark: SparkSession, f: Callable, *args) -> Future:
    """A function called in a thread of a pool, with a copy of this thread's Spark properties."""
    inherit = inheritable_thread_target(spark)
    return pool.submit(f if inherit is spark else inherit(f), *args)


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation and
    plans stay short. `drop` removes a table once nothing lazy depends on it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.numbers = itertools.count(1)  # threads may write side by side

    def write(self, df: DataFrame) -> DataFrame:
        return self.counted(df)[0]

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table and its number of rows, counted while it is written."""
        path = f"{self.root}/t{next(self.numbers)}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tickloom_path = path  # type: ignore[attr-defined]
        return out, int(seen.get["n"])

    def drop(self, *tables: DataFrame | None) -> None:
        sc = self.spark.sparkContext
        for t in tables:
            path = getattr(t, "_tickloom_path", None)
            if path:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory; missing tables raise when they are used."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
