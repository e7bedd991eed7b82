"""Event-time jobs: windows over metrics and spans put together from two streams.

Both keep state only as long as the watermark allows, say what came too late, and write each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.streaming.tables import change_log, newest, read_batches, run_available, write_batch, write_progress

WINDOW = "key string, started_at timestamp, n bigint, total double, least double, most double"
JOINED = "span_id bigint, operation string, started_at timestamp, ended_at timestamp, status string"


# --- windows ------------------------------------------------------------------------------------
def stream_metric_windows(metrics: DataFrame, out: str, size: str, slide: str | None = None, lateness: str = "1 hour") -> None:
    """Values of (key, value, ts) by key and window of event time; a value of null counts one.

    Windows lie end to end, or overlap if ``slide`` is shorter than ``size``.  A window changes while events for it come in, until the
    watermark, ``lateness`` behind the newest event, has passed its end; then its state goes, and what still comes for it is counted as late
    (``late_events``) and left out.
    """
    value = F.coalesce("value", F.lit(1.0))
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    current = metrics.select("key", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness).groupBy(span.alias("w"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    change_log(current.select("key", F.col("w.start").alias("started_at"), "n", "total", "least", "most"), out)


def metric_windows(spark: SparkSession, out: str) -> DataFrame:
    """Every window as it stands."""
    return newest(spark, out, ["key", "started_at"], WINDOW)


def late_events(spark: SparkSession, out: str) -> DataFrame:
    """batch_id, watermark and late rows of each batch of a job that has a watermark."""
    return read_batches(spark, f"{out}/progress", "watermark string, late bigint, state_rows bigint").select("batch_id", "watermark", "late", "state_rows")


# --- spans --------------------------------------------------------------------------------------
def stream_joined_spans(starts: DataFrame, ends: DataFrame, out: str, longest: str = "1 day", lateness: str = "1 hour") -> None:
    """Put starts (span_id, operation, started_at) and ends (span_id, ended_at, status) of spans together as either comes in.

    An end belongs to a start if it is not before it and at most ``longest`` after.  A start without an end is given up, and an end
    without a start is late, once both watermarks have passed what could still come; their state goes then.
    """
    begun = starts.select("span_id", "operation", "started_at").withWatermark("started_at", lateness)
    over = ends.select(F.col("span_id").alias("end_id"), "ended_at", "status").withWatermark("ended_at", lateness)
    belongs = (F.col("span_id") == F.col("end_id")) & (F.col("ended_at") >= F.col("started_at")) & (
        F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}"))
    joined = begun.join(over, belongs, "full_outer").select(F.coalesce("span_id", "end_id").alias("span_id"), "operation", "started_at", "ended_at", "status")
    query = run_available(joined, lambda batch, i: write_batch(batch, f"{out}/joined", i), f"{out}/checkpoint")
    write_progress(starts.sparkSession, query, out)


def joined_spans(spark: SparkSession, out: str, starts: DataFrame) -> DataFrame:
    """All spans begun so far; the first of several ends counts, and what has none yet is running."""
    joined = read_batches(spark, f"{out}/joined", JOINED).where("started_at IS NOT NULL AND ended_at IS NOT NULL")
    closed = joined.groupBy("span_id").agg(F.min(F.struct("ended_at", "status")).alias("end")).select("span_id", "end.*")
    return starts.select("span_id", "operation", "started_at").join(closed, "span_id", "left").select(
        "span_id", "operation", "started_at", "ended_at", F.coalesce("status", F.lit("running")).alias("status"))


def given_up(spark: SparkSession, out: str) -> DataFrame:
    """Starts whose end can no longer come in time."""
    return read_batches(spark, f"{out}/joined", JOINED).where("ended_at IS NULL").select("span_id", "operation", "started_at", "batch_id")


def late_ends(spark: SparkSession, out: str) -> DataFrame:
    """Ends that no start takes: too late, too early, or of a span never begun."""
    return read_batches(spark, f"{out}/joined", JOINED).where("started_at IS NULL").select("span_id", "ended_at", "status", "batch_id")
