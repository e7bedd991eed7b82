"""Snapshot partitions and their transaction log on shared storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators import history
from sourceloom.session import delete_path, scratch_path
from sourceloom.sources import tables

LOG_SCHEMA = "action string, phase string, path string, ts timestamp_ntz"


def log_transaction(spark: SparkSession, root: str, entries: DataFrame) -> None:
    """Append rows of action, phase, path, ts as JSON lines."""
    entries.select("action", "phase", "path", F.col("ts").cast("timestamp_ntz").alias("ts")).write.mode("append").json(
        f"{root}/transaction_log"
    )


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_or_empty(spark, f"{root}/transaction_log", LOG_SCHEMA, "json")


def create_snapshot(
    spark: SparkSession, root: str, phase: str, source: DataFrame | None, at: datetime, keys: list[str],
    description: str = "",
) -> DataFrame:
    """Store a version as its own partition and log it; returns the point with its file count.

    A second snapshot of the phase within the same second is merged in: its rows replace those
    with equal keys.  Without a source the snapshot is empty.
    """
    name = f"{phase}_{int(at.timestamp())}"
    path = f"{root}/snapshots/snapshot_id={name}"
    count = 0
    if source is not None:
        if tables.exists(spark, path):
            old = spark.read.schema(source.schema).parquet(path)
            source = old.join(source.select(*keys), keys, "left_anti").unionByName(source)
        staged = scratch_path(spark, "snapshot")
        source.write.parquet(staged)
        spark.read.schema(source.schema).parquet(staged).write.mode("overwrite").parquet(path)
        delete_path(spark, staged)
        count = spark.read.schema(source.schema).parquet(path).count()
    point = spark.range(1).select(
        F.lit("CREATE_ROLLBACK").alias("action"), F.lit(phase).alias("phase"), F.lit(name).alias("path"),
        F.lit(at.replace(tzinfo=None)).cast("timestamp_ntz").alias("ts"),
    )
    log_transaction(spark, root, point)
    return point.select(
        "phase", F.col("path").alias("snapshot_id"), "ts", F.lit(count).cast("bigint").alias("file_count"),
        F.lit(description or f"Snapshot before {phase}").alias("description"),
    )


def restore_snapshot(spark: SparkSession, root: str, phase: str, schema) -> DataFrame | None:
    """The rows of the newest live snapshot of a phase, or None; the restore is logged."""
    points = history.list_snapshots(read_log(spark, root)).filter(F.col("phase") == phase)
    newest = points.orderBy(F.desc("ts"), F.desc("path")).head()
    if newest is None:
        return None
    path = f"{root}/snapshots/snapshot_id={newest.path}"
    log_transaction(spark, root, spark.range(1).select(
        F.lit("ROLLBACK").alias("action"), F.lit(phase).alias("phase"), F.lit(newest.path).alias("path"),
        F.lit(newest.ts).cast("timestamp_ntz").alias("ts"),
    ))
    return tables.read_or_empty(spark, path, schema, "parquet")


def cleanup(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all but the newest ``keep`` snapshots and log each deletion.

    Walks points, of which there are as many as snapshots were taken, never table rows.
    """
    points = history.list_snapshots(read_log(spark, root))
    for point in points.orderBy(F.desc("ts"), F.desc("path")).offset(keep).toLocalIterator():
        delete_path(spark, f"{root}/snapshots/snapshot_id={point.path}")
        log_transaction(spark, root, spark.range(1).select(
            F.lit("CLEANUP").alias("action"), F.lit(point.phase).alias("phase"), F.lit(point.path).alias("path"),
            F.lit(point.ts).cast("timestamp_ntz").alias("ts"),
        ))
