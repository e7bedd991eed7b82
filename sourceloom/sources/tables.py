"""Sinks and logs: rewritten files, ledger, JSON logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import delete_path

LEDGER_SCHEMA = "repo string, path string, status string, ts timestamp_ntz"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A table, or no rows of its schema while it has not been written."""
    if exists(spark, path):
        return spark.read.format(fmt).schema(schema).load(path)
    return spark.createDataFrame([], schema)


def write_migrated(files: DataFrame, path: str) -> None:
    """Write rewritten files, one folder per target language; takes one row per new path."""
    files.write.mode("overwrite").partitionBy("target_language").parquet(path)


def write_map(mapping_json: DataFrame, path: str) -> None:
    """Write the mapping as JSON lines."""
    mapping_json.write.mode("overwrite").text(path)


def ledger_write(entries: DataFrame, path: str) -> None:
    """Append file outcomes: repo, path, status (completed or failed), ts."""
    entries.select("repo", "path", "status", "ts").write.mode("append").parquet(path)


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, LEDGER_SCHEMA)


def ledger_clear(spark: SparkSession, path: str) -> None:
    delete_path(spark, path)


def ledger_totals(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Completed, failed and total files per repository."""
    per_repo = ledger.groupBy("repo").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return files.groupBy("repo").agg(F.count("*").alias("total")).join(per_repo, "repo", "left").select(
        "repo", F.coalesce("completed", F.lit(0)).alias("completed"),
        F.coalesce("failed", F.lit(0)).alias("failed"), "total",
    )


def json_log(entries: DataFrame, extra: list[Column]) -> DataFrame:
    """One JSON object per log entry: timestamp, level, run_id, message and further fields."""
    return entries.select(F.to_json(F.struct("timestamp", "level", "run_id", "message", *extra)).alias("value"))


def parse_json_log(lines: DataFrame) -> DataFrame:
    """The fixed fields as columns; the whole entry stays available as a variant."""
    parsed = F.try_parse_json("value")
    return lines.select(
        *[
            F.try_variant_get(parsed, f"$.{name}", kind).alias(name)
            for name, kind in [("timestamp", "double"), ("level", "string"), ("run_id", "string"), ("message", "string")]
        ],
        parsed.alias("entry"),
    )
