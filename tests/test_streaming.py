"""Streams over split input give what the batch form gives over all of it."""

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import rewrite, telemetry, usage
from sourceloom.session import scratch_path
from sourceloom.streaming import logs, translate
from sourceloom.streaming.tables import read_stream


@pytest.fixture
def events(spark):
    return spark.range(400).select(
        (F.col("id") % 9).alias("job"), F.when(F.col("id") % 5 == 0, "failed").otherwise("running").alias("status"),
        F.timestamp_seconds(86_400 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"),
        F.concat(F.lit("k"), (F.col("id") % 9).cast("string")).alias("key"), (F.col("id") % 11).cast("double").alias("value"),
    )


def split_stream(spark, df, column, parts=4):
    """A stream that takes the rows in ``parts`` batches, by ranges of ``column``."""
    folder = scratch_path(spark, "input")
    bounds = df.agg(F.max(column)).head()[0] + 1
    for i in range(parts):
        lo, hi = bounds * i // parts, bounds * (i + 1) // parts
        df.filter((F.col(column) >= lo) & (F.col(column) < hi)).coalesce(1).write.mode("append").parquet(folder)
    return read_stream(spark, folder, df.schema, files_per_batch=1)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_status_and_metrics(spark, events):
    out = scratch_path(spark, "status")
    logs.stream_latest_status(split_stream(spark, events, "seq"), out)
    assert same(logs.latest_status(spark, out).select("job", "status"), telemetry.latest_status(events).select("job", "status"))
    out = scratch_path(spark, "metrics")
    logs.stream_metrics(split_stream(spark, events, "seq"), out)
    current = logs.current_metrics(spark, out)
    assert same(current.select("key", "total"), telemetry.metric_counters(events))
    assert same(current.select("key", "last_value"), telemetry.metric_gauges(events))
    assert same(current.select("key", "n", "avg_value"), telemetry.metric_histograms(events))


def test_ttl_hits(spark, ws, events):
    requests = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq")
    for order in ("seq", "shuffled", "backwards"):
        mixed = requests.withColumn("shuffled", F.pmod(F.xxhash64("seq"), F.lit(400))).withColumn("backwards", 399 - F.col("seq"))
        out = scratch_path(spark, "hits")
        logs.stream_ttl_hits(split_stream(spark, mixed, order, parts=5), out)
        assert same(logs.marked_requests(ws, out, 1200).select("key", "at", "seq", "hit"), usage.ttl_hits(ws, requests, 1200))


def test_spans(spark, events):
    starts = events.select(F.col("seq").alias("span_id"), F.col("status").alias("operation"), F.col("ts").cast("timestamp").alias("started_at"))
    ends = starts.filter("span_id % 4 <> 0").select(
        "span_id", F.timestamp_micros(F.unix_micros("started_at") + 5_000_000).alias("ended_at"), F.lit("ok").alias("status")
    )
    out = scratch_path(spark, "spans")
    late = ends.filter("span_id % 40 = 1").withColumn("ended_at", F.timestamp_micros(F.unix_micros("ended_at") + 40 * 86_400_000_000))
    early = ends.filter("span_id % 40 = 2").withColumn("ended_at", F.timestamp_micros(F.unix_micros("ended_at") - 40_000_000))
    logs.stream_spans(split_stream(spark, ends.filter("span_id % 40 <> 1").union(late).union(early), "span_id"), out)
    found = logs.spans(spark, out, starts)
    assert found.filter("ended_at < started_at").count() == 0 and found.filter("ended_at > started_at + interval 30 days").count() == 10
    assert found.filter("status = 'running'").count() == 100 and found.filter("status = 'ok'").count() == 300


def test_translate_resumes_and_retries(spark):
    schema = "repo string, path string, content string, language string, file_type string, size_bytes bigint"
    folder, out = scratch_path(spark, "files"), scratch_path(spark, "translated")
    row = lambda i, text: ("r", f"f{i}.py", text, "python", "source", 1)
    text = F.when(~F.contains("content", F.lit("bad")), rewrite.stand_in_text("go"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        translate.stream_translate(read_stream(spark, folder, schema), "go", out, text)

    arrive([row(1, "a"), row(2, "bad")])
    arrive([row(2, "fine now"), row(1, "again"), row(3, "c")])
    done = {r.original_path: r.original_content for r in translate.migrated(spark, out).collect()}
    assert done == {"f1.py": "a", "f2.py": "fine now", "f3.py": "c"}
    assert [r.path for r in translate.dead_letters(spark, out).collect()] == ["f2.py"]
    assert {r.status for r in translate.latest_outcome(spark, out).collect()} == {"completed"}
    total = spark.createDataFrame([("r", 3)], "repo string, total bigint")
    kinds = [r.event_type for r in translate.run_events(spark, out, total).collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "start": 1, "file_complete": 3, "file_error": 1, "checkpoint": 2, "complete": 1,
    }
    steps = translate.run_events(spark, out, total).filter("event_type = 'checkpoint'").orderBy("batch_id").collect()
    assert [round(s.progress_pct) for s in steps] == [33, 100]


def test_progress_over_several_batches_and_a_second_run(spark, ws):
    schema = "repo string, path string, content string, language string, file_type string, size_bytes bigint"
    folder, out = scratch_path(spark, "files"), scratch_path(spark, "translated")
    row = lambda i, text: ("r", f"f{i}.py", text, "python", "source", 1)
    text = F.when(~F.contains("content", F.lit("bad")), rewrite.stand_in_text("go"))

    def run(*batches):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        translate.stream_translate(read_stream(spark, folder, schema, files_per_batch=1), "go", out, text)

    run([row(3, "a"), row(1, "b"), row(1, "b"), row(1, "other")], [row(2, "bad"), row(0, "c")], [row(4, "d")])
    tried = [r.original_path for r in translate.migrated(spark, out).collect()]
    assert sorted(tried) == ["f0.py", "f1.py", "f3.py", "f4.py"]
    total = spark.createDataFrame([("r", 6), ("empty", 2)], "repo string, total bigint")
    seconds = spark.createDataFrame([(0, 10.0), (1, 30.0), (2, 40.0)], "batch_id bigint, seconds double")
    rows = {(r.event_type, r.file_path): (r.batch_id, r.done, r.remaining, r.resumed, r.progress_pct and round(r.progress_pct), r.eta_seconds)
            for r in translate.progress_events(ws, out, total, seconds).where("repo = 'r'").collect()}
    assert rows == {
        ("start", None): (None, 0, 6, 0, 0.0, None), ("file_complete", "f1.py"): (0, 1, 5, 0, 17, 50.0), ("file_complete", "f3.py"): (0, 2, 4, 0, 33, 20.0),
        ("file_complete", "f0.py"): (1, 3, 3, 0, 50, 30.0), ("file_error", "f2.py"): (1, 3, 3, 0, None, None), ("file_complete", "f4.py"): (2, 4, 2, 0, 67, 20.0)}
    run([row(2, "fine now"), row(3, "again")])
    rows = translate.progress_events(ws, out, total, resumed_before=3).collect()
    assert {(r.repo, r.event_type, r.file_path, r.done, r.remaining, r.resumed) for r in rows} == {
        ("r", "start", None, 4, 2, 4), ("r", "file_complete", "f2.py", 5, 1, 4), ("empty", "start", None, 0, 2, 0)}
