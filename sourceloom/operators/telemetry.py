"""Metrics, spans, jobs and progress from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import ordered
from sourceloom.session import Workspace


def metric_counters(metrics: DataFrame) -> DataFrame:
    """Sum per key; a missing value counts as one."""
    return metrics.groupBy("key").agg(F.sum(F.coalesce("value", F.lit(1.0))).alias("total"))


def metric_gauges(metrics: DataFrame) -> DataFrame:
    """Value of the last event per key."""
    return metrics.groupBy("key").agg(F.max_by("value", F.struct("ts", "seq")).alias("last_value"))


def metric_histograms(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("key").agg(F.count("value").alias("n"), F.avg("value").alias("avg_value"))


def _plain_number(value: Column) -> Column:
    """A double without exponent and with at least one decimal."""
    digits = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)


def prometheus_lines(counters: DataFrame, gauges: DataFrame, histograms: DataFrame) -> DataFrame:
    """Text exposition, one entry per row with its kind and key."""
    def head(kind: str) -> list[Column]:
        return [F.lit("# TYPE "), F.col("key"), F.lit(f" {kind}\n"), F.col("key")]

    average = F.col("avg_value").cast("decimal(38,18)").cast("decimal(38,2)").cast("string")
    parts = [
        counters.select(
            F.lit("counter").alias("kind"), "key",
            F.concat(*head("counter"), F.lit(" "), _plain_number(F.col("total"))).alias("line"),
        ),
        gauges.select(
            F.lit("gauge").alias("kind"), "key",
            F.concat(*head("gauge"), F.lit(" "), _plain_number(F.col("last_value"))).alias("line"),
        ),
        histograms.select(
            F.lit("histogram").alias("kind"), "key",
            F.concat(
                *head("histogram"), F.lit("_count "), F.col("n").cast("string"),
                F.lit("\n"), F.col("key"), F.lit("_avg "), average,
            ).alias("line"),
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def span_durations(spans: DataFrame) -> DataFrame:
    return spans.withColumn("duration_ms", T.duration_ms(F.col("started_at"), F.col("ended_at")))


def span_stats(spans: DataFrame) -> DataFrame:
    return span_durations(spans).groupBy("operation", "status").agg(
        F.count("*").alias("spans"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms")
    )


def latest_status(statuses: DataFrame) -> DataFrame:
    """Newest status of each job."""
    return statuses.groupBy("job").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("updated_at")
    )


def job_counts(statuses: DataFrame) -> DataFrame:
    """Jobs per current status, finished ones included."""
    return latest_status(statuses).groupBy("status").agg(F.count("*").alias("jobs"))


def progress_series(ws: Workspace, outcomes: DataFrame) -> DataFrame:
    """Completed files, percentage and remaining seconds after each outcome of a job.

    ``outcomes`` has job, ts, seq and ok; failed files do not advance the count.
    """
    joined = ordered.running_totals(
        ws, outcomes, ["job"], [F.col("ts"), F.col("seq")], {"completed": F.when(F.col("ok"), 1).otherwise(0)},
        {"total": (F.count("*"), F.sum), "started_at": (F.min("ts"), F.min)},
    )
    elapsed = T.micros_between(F.col("started_at"), F.col("ts")) / 1_000_000.0
    left = F.col("total") - F.col("completed")
    return joined.select(
        "job", "seq", "ok", "completed", "total",
        (F.col("completed") / F.col("total") * 100).alias("progress_pct"),
        (elapsed / F.greatest("completed", F.lit(1)) * left).alias("eta_seconds"),
    )


def batch_assign(ws: Workspace, remaining: DataFrame, size: int = rules.BATCH_SIZE) -> DataFrame:
    """Batch number from 0 for files in path order, ``size`` files per batch."""
    placed = ordered.positions(ws, remaining.select("repo", "path"), ["repo"], [F.col("path")], "position")
    return placed.select("repo", "path", F.floor((F.col("position") - 1) / size).cast("bigint").alias("batch"))


def remaining_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without a completed entry; failed ones are tried again."""
    done = ledger.filter(F.col("status") == "completed").select("repo", "path").distinct()
    return files.join(done, ["repo", "path"], "left_anti")


def priority_order(rules_table: DataFrame) -> DataFrame:
    """Enabled rules by ascending priority; equal priorities keep their order of arrival."""
    return rules_table.filter("enabled").orderBy("priority", "seq")
