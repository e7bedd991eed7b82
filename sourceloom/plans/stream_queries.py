"""Streaming queries; each runs over its whole table and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import rewrite
from sourceloom.plans import corpus
from sourceloom.plans.common import FILES, Inputs, TARGET, micros, migrated_sql, query, r6
from sourceloom.plans.log_queries import LATEST, METRICS, SPAN_MS, STATUS, TTL, TTL_SECONDS
from sourceloom.session import scratch_path
from sourceloom.sources import files as S
from sourceloom.streaming import logs, translate, windows
from sourceloom.streaming.tables import read_stream


def _shuffled_events(x: Inputs, files: int = 6):
    """The whole table as several micro-batches that do not follow time."""
    folder = scratch_path(x.spark, "events")
    events = x.table("events")
    events.repartition(files, F.xxhash64("event_id")).write.parquet(folder)
    return read_stream(x.spark, folder, events.schema, files_per_batch=2)


JITTER_DAYS = 1


def _late_events(x: Inputs, files: int = 6):
    """The whole table as several micro-batches that follow time but for a day at most."""
    folder = scratch_path(x.spark, "events")
    events = x.table("events")
    moved = events.withColumn("_due", F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(JITTER_DAYS * 86_400)))
    low, high = moved.agg(F.min("_due"), F.max("_due")).head()
    part = F.floor((F.col("_due") - low) * files / (high - low + 1)) if low is not None else F.lit(0)
    moved = moved.withColumn("_part", part)
    for k in range(files):  # files are taken in the order in which they were written
        moved.where(F.col("_part") == k).drop("_due", "_part").coalesce(1).write.mode("append").parquet(folder)
    return read_stream(x.spark, folder, events.schema, files_per_batch=2)


def _streamed(x: Inputs, **tables) -> Inputs:
    """The same inputs with some tables as streams."""
    class Streamed(Inputs):
        def table(self, name: str):
            return tables[name] if name in tables else super().table(name)

    return Streamed(x.spark, x.sf_dir)


def _file_stream(x: Inputs):
    documents = read_stream(x.spark, x.sf_dir, x.table("documents").schema, "documents.parquet")
    documents.createOrReplaceTempView("documents")
    raw = x.spark.sql(corpus.CODE_CORPUS_SQL).select(F.lit(corpus.REPO).alias("repo"), "path", "content", "size_bytes")
    return S.load_corpus(raw)


FAILS = "size_bytes % 13 = 0"


def _translated(x: Inputs) -> str:
    out = scratch_path(x.spark, "translate")
    text = F.when(~F.expr(FAILS), rewrite.stand_in_text(TARGET))
    translate.stream_translate(_file_stream(x), TARGET, out, text)
    return out


@query("stream_translate", f"""WITH {migrated_sql()} SELECT m.original_path, m.new_path, md5(m.migrated_content) AS digest
  FROM migrated m JOIN files f ON f.path = m.original_path WHERE NOT {FAILS}""")
def _(x: Inputs):
    done = translate.migrated(x.spark, _translated(x))
    return done.select("original_path", "new_path", F.md5("migrated_content").alias("digest"))


@query("stream_errors", f"WITH {FILES} SELECT repo, path, CASE WHEN {FAILS} THEN 'failed' ELSE 'completed' END AS status FROM files")
def _(x: Inputs):
    return translate.latest_outcome(x.spark, _translated(x))


@query("stream_events", f"""WITH {FILES}, n AS (SELECT count(*) AS total, count_if(NOT {FAILS}) AS good, count_if({FAILS}) AS bad FROM files)
  SELECT CASE WHEN {FAILS} THEN 'file_error' ELSE 'file_complete' END AS event_type, path AS file_path, NULL AS progress_pct,
    NULL AS total, NULL AS translated, NULL AS failed FROM files
  UNION ALL SELECT 'start', NULL, 0.0::DOUBLE, total, NULL, NULL FROM n
  UNION ALL SELECT 'checkpoint', NULL, round(good / total * 100, 6), NULL, NULL, NULL FROM n
  UNION ALL SELECT 'complete', NULL, 100.0::DOUBLE, NULL, good, bad FROM n""")
def _(x: Inputs):
    out = _translated(x)
    total = x.paths.groupBy("repo").agg(F.count("*").alias("total"))
    events = translate.run_events(x.spark, out, total)
    return events.select(
        "event_type", "file_path", r6(F.col("progress_pct")).alias("progress_pct"),
        *[F.try_element_at("data", F.lit(k)).alias(k) for k in ("total", "translated", "failed")],
    )


@query("stream_progress", f"""WITH {FILES}, n AS (SELECT count(*) AS total FROM files),
  done AS (SELECT path, {FAILS} AS bad, count_if(NOT {FAILS}) OVER (ORDER BY path) AS done, total FROM files, n)
  SELECT CASE WHEN bad THEN 'file_error' ELSE 'file_complete' END AS event_type, path AS file_path, done, total - done AS remaining, 0 AS resumed,
    CASE WHEN NOT bad THEN round(done / total * 100, 6) END AS progress_pct FROM done
  UNION ALL SELECT 'start', NULL, 0, total, 0, 0.0::DOUBLE FROM n""")
def _(x: Inputs):
    total = x.paths.groupBy("repo").agg(F.count("*").alias("total"))
    events = translate.progress_events(x.ws, _translated(x), total)
    return events.select("event_type", "file_path", "done", "remaining", "resumed", r6(F.col("progress_pct")).alias("progress_pct"))


@query("stream_latest_status", LATEST)
def _(x: Inputs):
    out = scratch_path(x.spark, "status")
    logs.stream_latest_status(_streamed(x, events=_shuffled_events(x)).statuses, out)
    logs.compact_status(x.spark, out)
    return logs.latest_status(x.spark, out).select("job", "status", micros("updated_at").alias("updated_at"))


@query("stream_metrics", f"""WITH {METRICS} SELECT key, round(sum(coalesce(value, 1.0)), 6) AS total, arg_max(value, (ts, seq)) AS last_value,
  count(value) AS n, round(avg(value), 6) AS avg_value FROM metrics GROUP BY key""")
def _(x: Inputs):
    out = scratch_path(x.spark, "metrics")
    logs.stream_metrics(_streamed(x, events=_shuffled_events(x)).metrics, out)
    logs.compact_metrics(x.spark, out)
    current = logs.current_metrics(x.spark, out)
    return current.withColumns({c: r6(F.col(c)) for c in ("total", "avg_value")})


@query("stream_ttl_hits", f'WITH RECURSIVE {TTL} SELECT key, "at", seq, hit FROM walk')
def _(x: Inputs):
    out = scratch_path(x.spark, "hits")
    logs.stream_ttl_hits(_streamed(x, events=_shuffled_events(x)).requests, out)
    return logs.marked_requests(x.ws, out, TTL_SECONDS)


@query("stream_spans", f"""SELECT event_id AS span_id, event_type AS operation, CASE WHEN event_id % 7 = 0 THEN 'running' ELSE {STATUS} END AS status,
  CASE WHEN event_id % 7 <> 0 THEN round({SPAN_MS}, 3)::DOUBLE END AS duration_ms FROM events""")
def _(x: Inputs):
    out = scratch_path(x.spark, "spans")
    # every seventh span never ends
    ends = _streamed(x, events=_shuffled_events(x)).spans.filter("span_id % 7 <> 0")
    logs.stream_spans(ends, out)
    found = logs.spans(x.spark, out, x.spans.select("span_id", "operation", "started_at"))
    return found.select(
        "span_id", "operation", "status",
        F.round(T.duration_ms(F.col("started_at"), F.col("ended_at")), 3).alias("duration_ms"),
    )


def _windows(hours: int, slide: int) -> str:
    """SQL of the windows of ``hours`` that start every ``slide`` hours."""
    return f"""SELECT event_type AS key, (epoch_us(ts) // ({slide} * 3600000000) - k) * {slide} * 3600000000 AS started_at, count(*) AS n,
    round(sum(coalesce(value, 1.0)), 6) AS total, min(coalesce(value, 1.0)) AS least, max(coalesce(value, 1.0)) AS most
  FROM events, (SELECT unnest(range(0, {hours // slide})) AS k) GROUP BY ALL"""


def _metric_windows(x: Inputs, size: str, slide: str | None):
    out = scratch_path(x.spark, "windows")
    events = _late_events(x).select(F.col("event_type").alias("key"), "value", "ts")
    windows.stream_metric_windows(events, out, size, slide, f"{JITTER_DAYS * 24 + 1} hours")
    found = windows.metric_windows(x.spark, out)
    return found.select("key", micros("started_at").alias("started_at"), "n", r6(F.col("total")).alias("total"), "least", "most")


@query("stream_tumbling_metrics", _windows(6, 6))
def _(x: Inputs):
    return _metric_windows(x, "6 hours", None)


@query("stream_sliding_metrics", _windows(12, 4))
def _(x: Inputs):
    return _metric_windows(x, "12 hours", "4 hours")


@query("stream_joined_spans", f"""SELECT event_id AS span_id, event_type AS operation, CASE WHEN event_id % 7 = 0 THEN 'running' ELSE {STATUS} END AS status,
  CASE WHEN event_id % 7 <> 0 THEN round({SPAN_MS}, 3)::DOUBLE END AS duration_ms FROM events""")
def _(x: Inputs):
    out = scratch_path(x.spark, "joined")
    # every seventh span never ends
    spans = _streamed(x, events=_late_events(x)).spans
    windows.stream_joined_spans(spans.select("span_id", "operation", "started_at"), spans.where("span_id % 7 <> 0").select("span_id", "ended_at", "status"),
                                out, "1 day", f"{JITTER_DAYS * 24 + 1} hours")
    found = windows.joined_spans(x.spark, out, x.spans)
    return found.select("span_id", "operation", "status", F.round(T.duration_ms(F.col("started_at"), F.col("ended_at")), 3).alias("duration_ms"))
