"""Queries over request, metric, span, job and snapshot logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import history, telemetry, usage
from sourceloom.plans.common import FILES, Inputs, micros, query, r6, sql_case, sql_text
from sourceloom.session import scratch_path
from sourceloom.sources import snapshots, tables

# --- prompts and usage ---------------------------------------------------------------------------
_P = rules.PROVIDERS
_NAMES = list(_P)
WORDS = f"len(regexp_extract_all(user_prompt, {sql_text(f'[^{rules.SPACE}]+')}))"


def _value(i: int) -> str:
    return "CASE provider " + " ".join(f"WHEN '{n}' THEN {v[i]}" for n, v in _P.items()) + " END"


PROMPTS = f"""prompts AS MATERIALIZED (SELECT p.*, sha256(concat_ws(':', model, coalesce(system_prompt, ''), coalesce(user_prompt, ''))) AS prompt_key
  FROM (SELECT u.conv_id, u.turn, u.text AS user_prompt, s.system_prompt, a.answer,
    list_extract({_NAMES!r}, CAST(u.conv_id % {len(_NAMES)} + 1 AS BIGINT)) AS provider,
    list_extract({_NAMES!r}, CAST(u.conv_id % {len(_NAMES)} + 1 AS BIGINT)) || '-model' AS model
  FROM conversations u LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = u.conv_id
  LEFT JOIN (SELECT conv_id, turn - 1 AS turn, min(text) AS answer FROM conversations WHERE role = 'assistant' GROUP BY ALL) a ON a.conv_id = u.conv_id AND a.turn = u.turn
  WHERE u.role = 'user') p)"""
ANSWERED = f"""{PROMPTS}, answered AS MATERIALIZED (SELECT *, CASE WHEN cached THEN 0 ELSE {WORDS} * {_value(3)} END AS input_tokens,
  CASE WHEN cached THEN 0 ELSE {_value(2)} END AS output_tokens, coalesce(length(answer), 0) / 4.0 AS latency_ms, answer IS NULL AS failed
  FROM (SELECT *, row_number() OVER (PARTITION BY prompt_key ORDER BY conv_id, turn) > 1 AS cached FROM prompts) p)"""
COST = f"(input_tokens * {_value(0)} / 1000000.0 + output_tokens * {_value(1)} / 1000000.0)"


@query("token_estimate", f"WITH {PROMPTS} SELECT conv_id, turn, CAST({WORDS} * {_value(3)} AS BIGINT) AS input_tokens, CAST({_value(2)} AS BIGINT) AS output_tokens FROM prompts")
def _(x: Inputs):
    return x.prompts.select(
        "conv_id", "turn", usage.token_estimate(F.col("user_prompt"), F.col("provider")).alias("input_tokens"),
        usage.output_tokens(F.col("provider")).alias("output_tokens"),
    )


@query("cost_estimate", f"WITH {ANSWERED} SELECT conv_id, turn, provider, round({COST}, 6) AS cost_usd FROM answered")
def _(x: Inputs):
    return x.answered.select("conv_id", "turn", "provider", r6(F.col("cost_usd")).alias("cost_usd"))


@query("prompt_key", f"WITH {PROMPTS} SELECT conv_id, turn, prompt_key FROM prompts")
def _(x: Inputs):
    return x.prompts.select("conv_id", "turn", "prompt_key")


@query("prompt_dedup", f"""WITH {PROMPTS} SELECT prompt_key, min(conv_id * 100000 + turn) // 100000 AS conv_id, min(conv_id * 100000 + turn) % 100000 AS turn,
  count(*) - 1 AS hit_count, md5(arg_min(user_prompt, conv_id * 100000 + turn)) AS prompt FROM prompts GROUP BY prompt_key""")
def _(x: Inputs):
    rows = x.prompts.select("prompt_key", "conv_id", "turn", "user_prompt")
    return usage.prompt_dedup(rows, ["conv_id", "turn"]).select(
        "prompt_key", "conv_id", "turn", "hit_count", F.md5("user_prompt").alias("prompt")
    )


@query("usage_totals", f"""WITH {ANSWERED} SELECT count_if(NOT failed) AS total_requests, CAST(coalesce(sum(input_tokens) FILTER (NOT failed), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(output_tokens) FILTER (NOT failed), 0) AS BIGINT) AS total_output_tokens, round(coalesce(sum({COST}) FILTER (NOT failed), 0), 6) AS total_cost_usd,
  round(coalesce(sum(latency_ms) FILTER (NOT failed), 0)::DOUBLE, 6) AS total_latency_ms, count_if(NOT failed AND cached) AS cache_hits, count_if(failed) AS errors FROM answered""")
def _(x: Inputs):
    totals = usage.usage_totals(x.answered)
    return totals.withColumns({c: r6(F.col(c)) for c in ("total_cost_usd", "total_latency_ms")})


@query("requests_per_model", f"WITH {ANSWERED} SELECT model, count(*) AS requests FROM answered WHERE NOT failed GROUP BY model")
def _(x: Inputs):
    return usage.requests_per_model(x.answered)


# --- cache -------------------------------------------------------------------------------------------
TTL_SECONDS = 259200
TTL = f"""requests AS MATERIALIZED (SELECT event_type || ':' || user_id AS key, epoch_us(ts) AS "at", event_id AS seq,
    row_number() OVER (PARTITION BY event_type || ':' || user_id ORDER BY ts, event_id) AS rn FROM events),
  walk AS (SELECT key, "at", seq, rn, "at" AS created, false AS hit FROM requests WHERE rn = 1
    UNION ALL SELECT r.key, r."at", r.seq, r.rn, CASE WHEN r."at" - w.created <= {TTL_SECONDS}000000 THEN w.created ELSE r."at" END,
      r."at" - w.created <= {TTL_SECONDS}000000 FROM walk w JOIN requests r ON r.key = w.key AND r.rn = w.rn + 1)"""
CACHE_STATS = """SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses, count(DISTINCT key) AS size,
  round(count_if(hit) / greatest(count(*), 1) * 100, 6) AS hit_rate FROM walk"""


@query("ttl_hits", f"WITH RECURSIVE {TTL} SELECT key, \"at\", seq, hit FROM walk")
def _(x: Inputs):
    return usage.ttl_hits(x.ws, x.requests, TTL_SECONDS)


@query("cache_stats", f"WITH RECURSIVE {TTL} {CACHE_STATS}")
def _(x: Inputs):
    stats = usage.cache_stats(usage.ttl_hits(x.ws, x.requests, TTL_SECONDS))
    return stats.withColumn("hit_rate", r6(F.col("hit_rate")))


@query("retry_log", """WITH a AS (SELECT event_id // 5 AS request_id, event_id % 5 AS attempt, event_type NOT IN ('error', 'click') AS ok FROM events),
  ends AS (SELECT request_id, min(attempt) FILTER (ok) AS first_ok, count(*) AS n FROM a GROUP BY request_id)
  SELECT request_id, coalesce(first_ok + 1, n) AS attempts, coalesce(first_ok, n) AS errors,
    CASE coalesce(first_ok, n) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 4.0::DOUBLE WHEN 3 THEN 8.5::DOUBLE WHEN 4 THEN 17.0::DOUBLE ELSE 33.5::DOUBLE END AS wait_seconds,
    first_ok IS NULL AND n >= 3 AS gave_up FROM ends""")
def _(x: Inputs):
    attempts = x.table("events").select(
        F.floor(F.col("event_id") / 5).cast("bigint").alias("request_id"), (F.col("event_id") % 5).alias("attempt"),
        (~F.col("event_type").isin("error", "click")).alias("ok"),
    )
    return usage.retry_log(attempts)


# --- metrics --------------------------------------------------------------------------------------------
METRICS = """metrics AS MATERIALIZED (SELECT event_type || '{k="' || json_extract_string(props, '$.k') || '",user="' || user_id || '"}' AS key,
  value, ts, event_id AS seq FROM events)"""
COUNTERS = "SELECT key, round(sum(coalesce(value, 1.0)), 6) AS total FROM metrics GROUP BY key"
GAUGES = "SELECT key, arg_max(value, (ts, seq)) AS last_value FROM metrics GROUP BY key"
HISTOGRAMS = "SELECT key, count(value) AS n, round(avg(value), 6) AS avg_value FROM metrics GROUP BY key"


@query("metric_key", f"WITH {METRICS} SELECT seq, key FROM metrics")
def _(x: Inputs):
    return x.metrics.select("seq", "key")


@query("metric_counters", f"WITH {METRICS} {COUNTERS}")
def _(x: Inputs):
    return telemetry.metric_counters(x.metrics).withColumn("total", r6(F.col("total")))


@query("metric_gauges", f"WITH {METRICS} {GAUGES}")
def _(x: Inputs):
    return telemetry.metric_gauges(x.metrics)


@query("metric_histograms", f"WITH {METRICS} {HISTOGRAMS}")
def _(x: Inputs):
    return telemetry.metric_histograms(x.metrics).withColumn("avg_value", r6(F.col("avg_value")))


def _number(v: str) -> str:
    digits = f"regexp_replace(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38,10))::VARCHAR, '0+$', '')"
    return f"CASE WHEN ends_with({digits}, '.') THEN {digits} || '0' ELSE {digits} END"


@query("prometheus_lines", f"""WITH {METRICS} SELECT 'counter' AS kind, key, '# TYPE ' || key || ' counter' || chr(10) || key || ' ' || {_number('total')} AS line FROM ({COUNTERS}) c
  UNION ALL SELECT 'gauge', key, '# TYPE ' || key || ' gauge' || chr(10) || key || ' ' || {_number('last_value')} FROM ({GAUGES}) g
  UNION ALL SELECT 'histogram', key, '# TYPE ' || key || ' histogram' || chr(10) || key || '_count ' || n || chr(10) || key || '_avg ' ||
    CAST(CAST(avg_value AS VARCHAR) AS DECIMAL(38,18))::DECIMAL(38,2)::VARCHAR FROM ({HISTOGRAMS}) h""")
def _(x: Inputs):
    return telemetry.prometheus_lines(
        telemetry.metric_counters(x.metrics).withColumn("total", r6(F.col("total"))),
        telemetry.metric_gauges(x.metrics),
        telemetry.metric_histograms(x.metrics).withColumn("avg_value", r6(F.col("avg_value"))),
    )


# --- spans, jobs, progress --------------------------------------------------------------------------------
SPAN_MS = "CAST(round(value * 1000000) AS BIGINT) / 1000.0"
STATUS = "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END"


@query("span_duration", f"SELECT event_id AS span_id, event_type AS operation, {STATUS} AS status, round({SPAN_MS}, 3)::DOUBLE AS duration_ms FROM events")
def _(x: Inputs):
    return telemetry.span_durations(x.spans).select(
        "span_id", "operation", "status", F.round("duration_ms", 3).alias("duration_ms")
    )


@query("span_stats", f"""SELECT event_type AS operation, {STATUS} AS status, count(*) AS spans, round(avg({SPAN_MS}), 3)::DOUBLE AS avg_ms,
  round(max({SPAN_MS}), 3)::DOUBLE AS max_ms FROM events GROUP BY ALL""")
def _(x: Inputs):
    stats = telemetry.span_stats(x.spans)
    return stats.withColumns({c: F.round(c, 3) for c in ("avg_ms", "max_ms")})


LATEST = "SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS updated_at FROM events GROUP BY user_id"


@query("latest_status", LATEST)
def _(x: Inputs):
    return telemetry.latest_status(x.statuses).withColumn("updated_at", micros("updated_at"))


@query("job_counts", f"SELECT status, count(*) AS jobs FROM ({LATEST}) l GROUP BY status")
def _(x: Inputs):
    return telemetry.job_counts(x.statuses)


@query("progress_series", """SELECT job, seq, ok, completed, total, completed / total * 100 AS progress_pct,
  ("at" - started) / 1000000.0::DOUBLE / greatest(completed, 1) * (total - completed) AS eta_seconds FROM
  (SELECT user_id AS job, event_id AS seq, event_type <> 'error' AS ok, epoch_us(ts) AS "at",
    CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS completed, count(*) OVER (PARTITION BY user_id) AS total,
    epoch_us(min(ts) OVER (PARTITION BY user_id)) AS started FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) s""")
def _(x: Inputs):
    outcomes = x.statuses.withColumn("ok", F.col("status") != "error")
    series = telemetry.progress_series(x.ws, outcomes)
    return series.select("job", "seq", "ok", "completed", "total", "progress_pct", "eta_seconds")


REMAINING = "SELECT * FROM files WHERE CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT) % 3 <> 1"


def _remaining(x: Inputs):
    doc = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint")
    ledger = x.paths.withColumn("status", F.when(doc % 3 == 1, "completed").when(doc % 3 == 2, "failed"))
    return telemetry.remaining_files(x.paths, ledger.filter("status IS NOT NULL"))


@query("remaining_files", f"WITH {FILES} SELECT repo, path FROM ({REMAINING}) r")
def _(x: Inputs):
    return _remaining(x)


BATCHES = f"SELECT repo, path, CAST((row_number() OVER (PARTITION BY repo ORDER BY path) - 1) // {rules.BATCH_SIZE} AS BIGINT) AS batch FROM ({REMAINING}) r"


@query("batch_assign", f"WITH {FILES} {BATCHES}")
def _(x: Inputs):
    return telemetry.batch_assign(x.ws, _remaining(x))


@query("priority_order", "SELECT p_partkey AS seq, p_name AS name, CAST(p_size AS BIGINT) AS priority FROM part WHERE p_partkey % 3 <> 0")
def _(x: Inputs):
    hooks = x.table("part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("priority"),
        (F.col("p_partkey") % 3 != 0).alias("enabled"),
    )
    return telemetry.priority_order(hooks).select("seq", "name", "priority")


@query("json_log", """SELECT epoch_us(ts) / 1000000.0 AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'run-' || user_id AS run_id, event_type || ' done' AS message, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(x: Inputs):
    entries = x.table("events").select(
        (micros("ts") / 1_000_000.0).alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat("event_type", F.lit(" done")).alias("message"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    parsed = tables.parse_json_log(tables.json_log(entries, [F.col("k")]))
    return parsed.select(
        "timestamp", "level", "run_id", "message", F.try_variant_get("entry", "$.k", "bigint").alias("k")
    )


# --- snapshots ------------------------------------------------------------------------------------------------
NAME = "o_orderpriority || '_' || CAST(epoch(o_orderdate) AS BIGINT)"
POINTS = f"points AS MATERIALIZED (SELECT o_orderpriority AS phase, {NAME} AS snapshot_id, o_orderdate AS ts, o_orderkey AS seq FROM orders)"


@query("snapshot_file_count", f"WITH {POINTS} SELECT snapshot_id, count(*) AS file_count FROM points GROUP BY snapshot_id")
def _(x: Inputs):
    return history.snapshot_file_count(x.points)


@query("latest_snapshot", f"WITH {POINTS} SELECT phase, arg_max(snapshot_id, (ts, seq)) AS snapshot_id, arg_max(seq, (ts, seq)) AS seq FROM points GROUP BY phase")
def _(x: Inputs):
    return history.latest_snapshot(x.points).select("phase", "snapshot_id", "seq")


@query("retain_latest", f"""WITH {POINTS} SELECT CASE WHEN rn <= {rules.KEEP_SNAPSHOTS} THEN 'KEEP' ELSE 'CLEANUP' END AS action, phase, snapshot_id AS path, seq FROM
  (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS rn FROM points) p""")
def _(x: Inputs):
    kept, dropped = history.retain_latest(x.points)
    return kept.select(F.lit("KEEP").alias("action"), "phase", F.col("snapshot_id").alias("path"), "seq").unionByName(
        dropped.select("action", "phase", "path", "seq")
    )


LOG = f"""{POINTS}, log AS (SELECT 'CREATE_ROLLBACK' AS action, phase, snapshot_id AS path, ts FROM points
  UNION ALL SELECT 'CLEANUP', phase, snapshot_id, ts FROM points WHERE seq % 5 = 0)"""


def _log(x: Inputs):
    root = scratch_path(x.spark, "rollbacks")
    created = x.points.select(F.lit("CREATE_ROLLBACK").alias("action"), "phase", F.col("snapshot_id").alias("path"), "ts")
    cleaned = x.points.filter("seq % 5 = 0").select(F.lit("CLEANUP").alias("action"), "phase", F.col("snapshot_id").alias("path"), "ts")
    snapshots.log_transaction(x.spark, root, created)
    snapshots.log_transaction(x.spark, root, cleaned)
    return snapshots.read_log(x.spark, root)


@query("txn_log", f"WITH {LOG} SELECT action, phase, path, epoch_us(ts) AS ts FROM log")
def _(x: Inputs):
    return _log(x).withColumn("ts", micros("ts"))


@query("list_snapshots", f"WITH {LOG} SELECT DISTINCT phase, path, epoch_us(ts) AS ts FROM log WHERE path NOT IN (SELECT path FROM log WHERE action = 'CLEANUP')")
def _(x: Inputs):
    return history.list_snapshots(_log(x)).withColumn("ts", micros("ts"))


PHASES = ["1-URGENT", "5-LOW"]
_AT = datetime.fromisoformat("2024-01-01T00:00:00+00:00")


@query("create_snapshot", f"""SELECT o_orderpriority AS phase, o_orderpriority || '_1704067200' AS snapshot_id, count(*) AS file_count,
  'Snapshot before ' || o_orderpriority AS description FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY o_orderpriority""")
def _(x: Inputs):
    root = scratch_path(x.spark, "rollbacks")
    orders = x.table("orders")
    points = [
        snapshots.create_snapshot(x.spark, root, p, orders.filter(F.col("o_orderpriority") == p), _AT, ["o_orderkey"])
        for p in PHASES
    ]
    return points[0].unionByName(points[1]).drop("ts")


@query("restore_snapshot", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(x: Inputs):
    root = scratch_path(x.spark, "rollbacks")
    orders = x.table("orders").filter("o_orderpriority = '1-URGENT'")
    old = orders.withColumn("o_orderstatus", F.lit("?"))
    snapshots.create_snapshot(x.spark, root, PHASES[0], old, _AT.replace(year=2023), ["o_orderkey"])
    snapshots.create_snapshot(x.spark, root, PHASES[0], orders, _AT, ["o_orderkey"])
    restored = snapshots.restore_snapshot(x.spark, root, PHASES[0], orders.schema)
    return restored.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("snapshot_diff", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'added' ELSE 'changed' END AS change
  FROM orders WHERE o_orderkey % 10 IN (0, 1) OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'F')""")
def _(x: Inputs):
    orders = x.table("orders")
    old = orders.filter("o_orderkey % 10 <> 1")
    status = F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus"))
    new = orders.filter("o_orderkey % 10 <> 0").withColumn("o_orderstatus", status)
    return history.snapshot_diff(old, new, ["o_orderkey"])


