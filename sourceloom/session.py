"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", app: str = "sourceloom", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    sizing = {} if cores == "*" else {"spark.sql.shuffle.partitions": str(cores)}
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **sizing, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a scratch folder that ends with
    the process, because there driver and executors are one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="sourceloom-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none while it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name in the same file system, in one step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(path), hadoop.Path(to)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")


def give_back() -> None:
    """What Python has freed goes back to the system, where the C library can do that."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Workspace:
    """Written tables that cut the lineage of an iterative job.

    A table is written once, in columns, and survives the loss of executors.  Reading it back
    gives the planner its true size, so joins in the next round are planned on facts.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self._saved = 0
        self._tables: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._saved:05d}"
        self._saved += 1
        df.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def save_counted(self, df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
        """Save and return what the write itself counted: ``rows`` plus the given aggregates."""
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows")] + [m.alias(k) for k, m in metrics.items()]
        saved = self.save(df.observe(seen, *counts))
        return saved, seen.get

    def release(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing will read any more."""
        for i, (table, path) in reversed(list(enumerate(self._tables))):
            if any(table is t for t in tables):
                delete_path(self.spark, path)
                del self._tables[i]

    def tidy(self) -> None:
        """Let go of the plans of finished rounds, so that Spark's cleaner deletes their shuffle files and broadcasts now.

        It does so when the driver collects its garbage, which may otherwise be many rounds later.
        """
        give_back()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Delete all tables of the job, once its result has been written elsewhere."""
        delete_path(self.spark, self.root)
        self._tables.clear()
