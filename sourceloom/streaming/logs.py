"""Event logs as streams: statuses, metrics, cache hits and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.operators import usage
from sourceloom.session import Workspace
from sourceloom.streaming.tables import change_log, compact, newest, read_batches, run_available, write_batch

FINISHED = ["completed", "failed"]


STATUS = "job {}, status string, updated_at timestamp_ntz, seq bigint"
METRIC = "key string, total double, last_value double, n bigint, avg_value double"


def stream_latest_status(statuses: DataFrame, out: str) -> None:
    """Keep the newest status of each job; each batch logs the jobs that changed."""
    current = statuses.groupBy("job").agg(F.max(F.struct("ts", "seq", "status")).alias("s"))
    change_log(current.select("job", "s.status", F.col("s.ts").alias("updated_at"), F.col("s.seq").alias("seq")), out)


def latest_status(spark: SparkSession, out: str, job_type: str = "bigint") -> DataFrame:
    return newest(spark, out, ["job"], STATUS.format(job_type))


def compact_status(spark: SparkSession, out: str, job_type: str = "bigint") -> None:
    """Between two runs of the stream: one row a job instead of its changes so far."""
    compact(spark, out, ["job"], STATUS.format(job_type))


def stream_metrics(metrics: DataFrame, out: str) -> None:
    """Counter, gauge and histogram values of each key, updated as events come in."""
    value = F.coalesce("value", F.lit(1.0))
    current = metrics.groupBy("key").agg(
        F.sum(value).alias("total"), F.max(F.struct("ts", "seq", "value")).alias("last"),
        F.count("value").alias("n"), F.avg("value").alias("avg_value"),
    )
    change_log(current.select("key", "total", F.col("last.value").alias("last_value"), "n", "avg_value"), out)


def current_metrics(spark: SparkSession, out: str) -> DataFrame:
    return newest(spark, out, ["key"], METRIC)


def compact_metrics(spark: SparkSession, out: str) -> None:
    """Between two runs of the stream: one row a key instead of its changes so far."""
    compact(spark, out, ["key"], METRIC)


# --- cache hits ---------------------------------------------------------------------------------
def stream_ttl_hits(requests: DataFrame, out: str) -> None:
    """Log requests of (key, at in microseconds, seq) while they come in, each batch in one folder.

    Whether a request is a hit depends on all earlier ones of its key, whenever they arrive, so no
    request is marked before the log is read and none is ever too late.
    """
    run_available(requests.select("key", "at", "seq"), lambda batch, i: write_batch(batch, f"{out}/requests", i), f"{out}/checkpoint")


def marked_requests(ws: Workspace, out: str, ttl_seconds: int = rules.DEFAULT_TTL_SECONDS) -> DataFrame:
    """All requests so far as hit or miss, in order of time; keys of any length are cut by ranges."""
    logged = read_batches(ws.spark, f"{out}/requests", "key string, at bigint, seq bigint").drop("batch_id")
    return usage.ttl_hits(ws, logged, ttl_seconds)


# --- spans ----------------------------------------------------------------------------------------
ENDS = "span_id bigint, ended_at timestamp, status string"


def stream_spans(ends: DataFrame, out: str) -> None:
    """Log the ends of spans; a span may last any time, and its end may come at any time."""
    run_available(ends.select("span_id", "ended_at", "status"), lambda batch, i: write_batch(batch, f"{out}/ends", i), f"{out}/checkpoint")


def spans(spark: SparkSession, out: str, starts: DataFrame) -> DataFrame:
    """All spans begun so far; those without an end are still running.  Of several ends the first counts, none before the start."""
    ends = read_batches(spark, f"{out}/ends", ENDS).select("span_id", F.struct("ended_at", "status").alias("end"))
    timely = starts.select("span_id", "started_at").join(ends, "span_id").where("end.ended_at >= started_at")
    closed = timely.groupBy("span_id").agg(F.min("end").alias("end")).select("span_id", "end.*")
    return starts.join(closed, "span_id", "left").select(
        "span_id", "operation", "started_at", "ended_at", F.coalesce("status", F.lit("running")).alias("status")
    )
