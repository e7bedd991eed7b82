"""Event-time jobs over several batches, some of them out of order."""

import pytest
from pyspark.sql import functions as F

from sourceloom.session import folder_names, scratch_path
from sourceloom.streaming import logs, windows
from sourceloom.streaming.tables import read_batches, read_stream

METRICS = "key string, value double, ts timestamp"
STARTS = "span_id bigint, operation string, started_at timestamp"
ENDS = "span_id bigint, ended_at timestamp, status string"


class Feed:
    """A folder whose files come in one after the other, one a batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.folder = spark, schema, scratch_path(spark, "feed")

    def add(self, *rows):
        at = self.schema.split(", ").index(next(c for c in self.schema.split(", ") if c.endswith("timestamp")))
        plain = self.schema.replace("timestamp", "bigint")
        df = self.spark.createDataFrame(list(rows), plain)
        name = df.columns[at]
        df.withColumn(name, F.timestamp_seconds(name)).select(*df.columns).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return read_stream(self.spark, self.folder, self.schema, files_per_batch=1)


def values(spark, out):
    rows = windows.metric_windows(spark, out).select("key", F.unix_seconds("started_at").alias("s"), "n", "total", "least", "most").collect()
    return {(r.key, r.s): tuple(r)[2:] for r in rows}


def test_tumbling_windows_out_of_order_and_late(spark):
    feed, out = Feed(spark, METRICS), scratch_path(spark, "windows")
    feed.add(("a", 1.0, 10), ("a", 2.0, 70), ("b", None, 5))
    feed.add(("a", 5.0, 20), ("a", 7.0, 130))  # 20 comes out of order, but in time
    feed.add(("a", 1.0, 1000))
    windows.stream_metric_windows(feed.stream(), out, "1 minute", lateness="100 seconds")
    first = {("a", 0): (2, 6.0, 1.0, 5.0), ("a", 60): (1, 2.0, 2.0, 2.0), ("b", 0): (1, 1.0, 1.0, 1.0), ("a", 120): (1, 7.0, 7.0, 7.0), ("a", 960): (1, 1.0, 1.0, 1.0)}
    assert values(spark, out) == first
    progress = windows.late_events(spark, out)
    assert progress.agg(F.sum("late")).head()[0] == 0
    # a later run goes on: 30 is behind the watermark of 900, 950 is not
    feed.add(("a", 9.0, 30), ("a", 9.0, 950))
    windows.stream_metric_windows(feed.stream(), out, "1 minute", lateness="100 seconds")
    assert values(spark, out) == {**first, ("a", 900): (1, 9.0, 9.0, 9.0)}
    assert windows.late_events(spark, out).agg(F.sum("late")).head()[0] == 1
    # of the closed windows nothing is kept
    assert windows.late_events(spark, out).orderBy(F.col("batch_id").desc()).head().state_rows == 2


def test_sliding_windows(spark):
    feed, out = Feed(spark, METRICS), scratch_path(spark, "windows")
    feed.add(("a", 1.0, 100), ("a", 2.0, 130))
    feed.add(("a", 4.0, 90))
    windows.stream_metric_windows(feed.stream(), out, "1 minute", "30 seconds", "10 minutes")
    assert {k[1]: v[:2] for k, v in values(spark, out).items()} == {60: (2, 5.0), 90: (3, 7.0), 120: (1, 2.0)}


def test_spans_close_in_later_batches(spark):
    starts, ends, out = Feed(spark, STARTS), Feed(spark, ENDS), scratch_path(spark, "joined")
    begun = [(k, "read", 100 * k + 10) for k in range(6)]  # after the epoch, where watermarks begin
    starts.add(*begun)
    ends.add((0, 50, "ok"))
    run = lambda: windows.stream_joined_spans(starts.stream(), ends.stream(), out, "1000 seconds", "10 seconds")
    known = lambda: spark.createDataFrame(begun, STARTS.replace("timestamp", "bigint")).withColumn("started_at", F.timestamp_seconds("started_at"))
    state = lambda: {r.span_id: r.status for r in windows.joined_spans(spark, out, known()).collect()}
    run()
    assert state() == {0: "ok", **{k: "running" for k in range(1, 6)}}
    # two ends of one span, one before its start, one of a span that is not known
    ends.add((1, 500, "ok"), (1, 450, "error"), (2, 100, "ok"), (77, 600, "ok"))
    run()
    assert state() == {0: "ok", 1: "error", 2: "running", 3: "running", 4: "running", 5: "running"}
    # both streams move on: what is still open is given up, what no start took is late
    begun.append((9, "read", 50_000))
    starts.add(begun[-1])
    ends.add((9, 50_100, "ok"), (3, 49_000, "ok"))
    run()
    starts.add((10, "read", 90_000))
    ends.add((10, 90_001, "ok"))
    run()
    assert state() == {0: "ok", 1: "error", 2: "running", 3: "running", 4: "running", 5: "running", 9: "ok"}
    assert sorted(r.span_id for r in windows.given_up(spark, out).collect()) == [2, 3, 4, 5]
    assert {r.span_id for r in windows.late_ends(spark, out).collect()} >= {2, 77}


def test_change_log_is_compacted_between_runs(spark):
    feed, out = Feed(spark, "key string, value double, ts timestamp, seq bigint"), scratch_path(spark, "metrics")
    for k in range(3):
        feed.add(("a", float(k), k, k), (f"b{k}", None, k, k))
    metrics = lambda: feed.stream().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    logs.stream_metrics(metrics(), out)
    before = sorted(map(tuple, logs.current_metrics(spark, out).collect()))
    assert len(folder_names(spark, f"{out}/log")) >= 3
    logs.compact_metrics(spark, out)
    assert not [n for n in folder_names(spark, f"{out}/log") if n.startswith("batch_id=")]
    assert sorted(map(tuple, logs.current_metrics(spark, out).collect())) == before
    logs.compact_metrics(spark, out)
    feed.add(("a", 10.0, 9, 9))
    logs.stream_metrics(metrics(), out)
    logs.compact_metrics(spark, out)
    found = {r.key: r for r in logs.current_metrics(spark, out).collect()}
    assert len(folder_names(spark, f"{out}/compacted")) == 1 and len(found) == 4
    assert (found["a"].total, found["a"].last_value, found["a"].n) == (13.0, 10.0, 4)
    assert read_batches(spark, f"{out}/progress", "late bigint").count() >= 4


@pytest.mark.parametrize("column", ["key", "started_at"])
def test_windows_of_no_events(spark, column):
    feed, out = Feed(spark, METRICS), scratch_path(spark, "windows")
    feed.add()
    windows.stream_metric_windows(feed.stream(), out, "1 minute")
    assert windows.metric_windows(spark, out).select(column).count() == 0
