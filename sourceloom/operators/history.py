"""Snapshot points and versions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules


def snapshot_name(phase: Column, ts: Column) -> Column:
    """Points of one phase within a second share a name."""
    return F.concat(phase, F.lit("_"), F.unix_seconds(ts.cast("timestamp")).cast("string"))


def snapshot_file_count(entries: DataFrame) -> DataFrame:
    return entries.groupBy("snapshot_id").agg(F.count("*").alias("file_count"))


def latest_snapshot(points: DataFrame) -> DataFrame:
    """Newest point per phase; the later arrival wins a tie."""
    rest = [c for c in points.columns if c not in ("phase", "ts", "seq")]
    return points.groupBy("phase").agg(F.max(F.struct("ts", "seq", *rest)).alias("p")).select("phase", "p.*")


def retain_latest(points: DataFrame, keep: int = rules.KEEP_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` points over all phases, and a CLEANUP row for each other point."""
    kept = points.orderBy(F.desc("ts"), F.desc("seq")).limit(keep)
    # exactly ``keep`` rows, so the broadcast has a fixed bound
    dropped = points.join(F.broadcast(kept.select("seq")), "seq", "left_anti")
    return kept, dropped.select(F.lit("CLEANUP").alias("action"), "phase", F.col("snapshot_id").alias("path"), "ts", "seq")


def list_snapshots(log: DataFrame) -> DataFrame:
    """Points created and not cleaned up, read from the transaction log."""
    created = log.filter("action = 'CREATE_ROLLBACK'").select("phase", "path", "ts").dropDuplicates(["path"])
    cleaned = log.filter("action = 'CLEANUP'").select("path").distinct()
    return created.join(cleaned, "path", "left_anti").select("phase", "path", "ts")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added, removed or changed between two versions with the same columns."""
    values = [c for c in old.columns if c not in keys]

    def digest(df: DataFrame, name: str) -> DataFrame:
        row = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
        return df.select(*keys, F.sha2(row, 256).alias(name))

    both = digest(old, "before").join(digest(new, "after"), keys, "full")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")
