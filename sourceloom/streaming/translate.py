"""Rewriting a stream of files with a ledger, dead letters and run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.operators import ordered, rewrite
from sourceloom.session import Workspace
from sourceloom.streaming.tables import read_batches, run_available, write_batch

LEDGER = "repo string, path string, status string"
MIGRATED = (
    "repo string, original_path string, new_path string, original_content string, migrated_content string, "
    "target_language string, confidence_score double, warnings array<string>"
)


def stream_translate(files: DataFrame, target: str, out: str, translate: Column | None = None) -> None:
    """Rewrite files batch by batch; ``translate`` gives NULL for a file it cannot handle.

    Each batch writes its results, its dead letters and last its ledger, all under the number of
    the batch, so a repeated batch replaces itself.  Files that an earlier batch completed are
    skipped; files that failed are tried again when they come in again.  Of rows with one path in a batch, one is
    taken, the same in every attempt.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = ledger(spark, out).filter((F.col("batch_id") < batch_id) & (F.col("status") == "completed"))
        # only keys meet the ledger; the texts then lose the few repeated files
        ws = Workspace(spark, "repeated")
        repeated = ws.save(
            batch.select("repo", "path").join(done.select("repo", "path"), ["repo", "path"], "left_semi")
        )
        fresh = _one_each(ws, batch).join(repeated, ["repo", "path"], "left_anti")
        write_batch(rewrite.render_migrated(fresh, target, translate), f"{out}/tried", batch_id)
        tried = spark.read.schema(MIGRATED).parquet(f"{out}/tried/batch_id={batch_id}")
        failed = F.col("migrated_content").isNull()
        status = F.when(failed, "failed").otherwise("completed").alias("status")
        write_batch(tried.select("repo", F.col("original_path").alias("path"), status), f"{out}/ledger", batch_id)
        ws.close()

    run_available(files, sink, f"{out}/checkpoint")


def _one_each(ws: Workspace, batch: DataFrame) -> DataFrame:
    """One row per path; only the rows of paths that come several times meet in a shuffle."""
    mark = F.xxhash64("content")
    several = ws.save(batch.select("repo", "path", mark.alias("mark")).groupBy("repo", "path").agg(
        F.count("*").alias("n"), F.min("mark").alias("mark")).where("n > 1").select("repo", "path", "mark"))
    chosen = batch.withColumn("mark", mark).join(several, ["repo", "path", "mark"], "left_semi").drop("mark").dropDuplicates(["repo", "path"])
    return batch.join(several, ["repo", "path"], "left_anti").unionByName(chosen)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/ledger", LEDGER)


def migrated(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/tried", MIGRATED).filter("migrated_content IS NOT NULL")


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/tried", MIGRATED).filter("migrated_content IS NULL").select(
        "repo", F.col("original_path").alias("path"), "batch_id"
    )


def latest_outcome(spark: SparkSession, out: str) -> DataFrame:
    """Newest status of each file over all batches."""
    return ledger(spark, out).groupBy("repo", "path").agg(F.max_by("status", "batch_id").alias("status"))


def run_events(spark: SparkSession, out: str, total: DataFrame) -> DataFrame:
    """Events of a run: start, one per file, a checkpoint per batch, complete.

    ``total`` has repo and the number of files.  Progress is known at each checkpoint, so the
    running count goes over batches, not over files.
    """
    entries = ledger(spark, out)
    nothing, no_path, no_batch = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    per_file = entries.select(
        "repo", F.when(F.col("status") == "completed", "file_complete").otherwise("file_error").alias("event_type"),
        F.col("path").alias("file_path"), "batch_id", nothing.alias("progress_pct"),
        F.lit(None).cast("map<string,bigint>").alias("data"),
    )
    batches = entries.groupBy("repo", "batch_id").agg(F.count_if(F.col("status") == "completed").alias("n"))
    upto = Window.partitionBy("repo").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    checkpoints = batches.withColumn("done", F.sum("n").over(upto)).join(total, "repo").select(
        "repo", F.lit("checkpoint").alias("event_type"), no_path.alias("file_path"), "batch_id",
        (F.col("done") / F.col("total") * 100).alias("progress_pct"),
        F.lit(None).cast("map<string,bigint>").alias("data"),
    )
    outcomes = entries.groupBy("repo").agg(
        F.count_if(F.col("status") == "completed").alias("translated"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    known = total.join(outcomes, "repo", "left").fillna(0)
    start = known.select(
        "repo", F.lit("start").alias("event_type"), no_path.alias("file_path"), no_batch.alias("batch_id"),
        F.lit(0.0).alias("progress_pct"), F.create_map(F.lit("total"), F.col("total")).alias("data"),
    )
    complete = known.select(
        "repo", F.lit("complete").alias("event_type"), no_path.alias("file_path"), no_batch.alias("batch_id"),
        F.lit(100.0).alias("progress_pct"),
        F.create_map(F.lit("translated"), F.col("translated"), F.lit("failed"), F.col("failed")).alias("data"),
    )
    return per_file.unionByName(checkpoints).unionByName(start).unionByName(complete)


def progress_events(ws: Workspace, out: str, total: DataFrame, seconds: DataFrame | None = None, resumed_before: int = 0) -> DataFrame:
    """Progress of a run file by file: repo, event_type, file_path, batch_id, done, remaining, resumed, progress_pct, eta_seconds.

    ``total`` has repo and its number of files; files that batches before ``resumed_before`` completed are resumed.  Completed files
    count in order of batch and path, failed ones do not count.  ``seconds`` (batch_id, seconds: how long the batches up to this one
    took) gives the time that is left, by the average of the files completed so far; it is null without.  A file counts when it is completed first.
    """
    first = ledger(ws.spark, out).groupBy("repo", "path", "status").agg(F.min("batch_id").alias("batch_id"))
    entries = ws.save(first.join(total, "repo"))
    resumed = entries.where((F.col("status") == "completed") & (F.col("batch_id") < resumed_before)).groupBy("repo").agg(F.count("*").alias("resumed"))
    begun = total.join(resumed, "repo", "left").select("repo", "total", F.coalesce("resumed", F.lit(0).cast("bigint")).alias("resumed"))
    counted = ordered.running_totals(ws, entries, ["repo"], [F.col("batch_id"), F.col("path"), F.col("status")],
                                     {"done": F.when(F.col("status") == "completed", 1).otherwise(0)})
    counted = counted.where(F.col("batch_id") >= resumed_before).join(begun.select("repo", "resumed"), "repo")
    no_time = F.lit(None).cast("double")
    if seconds is None:
        timed = counted.withColumn("seconds", no_time)
    else:
        timed = counted.join(seconds.select("batch_id", F.col("seconds").cast("double").alias("seconds")), "batch_id", "left")
    left = (F.col("total") - F.col("done")).cast("bigint")
    share = F.col("done") / F.greatest(F.col("total"), F.lit(1)) * 100
    good = F.col("status") == "completed"
    per_file = timed.select(
        "repo", F.when(good, "file_complete").otherwise("file_error").alias("event_type"), F.col("path").alias("file_path"), "batch_id",
        F.col("done").cast("bigint").alias("done"), left.alias("remaining"), "resumed", F.when(good, share).alias("progress_pct"),
        F.when(good, F.col("seconds") / F.greatest(F.col("done"), F.lit(1)) * left).alias("eta_seconds"))
    start = begun.select(
        "repo", F.lit("start").alias("event_type"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("bigint").alias("batch_id"),
        F.col("resumed").alias("done"), (F.col("total") - F.col("resumed")).alias("remaining"), "resumed",
        (F.col("resumed") / F.greatest(F.col("total"), F.lit(1)) * 100).alias("progress_pct"), no_time.alias("eta_seconds"))
    return per_file.unionByName(start)
