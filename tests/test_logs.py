from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import history, telemetry, usage
from sourceloom.session import Workspace, scratch_path
from sourceloom.sources import snapshots, tables


def test_counters_and_keys(spark):
    rows = spark.createDataFrame([("files", {"b": "2", "a": "1"}, None), ("files", {"a": "1", "b": "2"}, None), ("n", None, 4.0)],
                                 "name string, labels map<string,string>, value double")
    metrics = rows.withColumn("key", T.metric_key(F.col("name"), F.col("labels")))
    assert {r.key: r.total for r in telemetry.metric_counters(metrics).collect()} == {'files{a="1",b="2"}': 2.0, "n": 4.0}


def test_prometheus_text(spark):
    keyed = lambda c, v: spark.createDataFrame([("k", v)], f"key string, {c} double")
    hist = spark.createDataFrame([("k", 2, 1.005)], "key string, n bigint, avg_value double")
    lines = {r.kind: r.line for r in telemetry.prometheus_lines(keyed("total", 2.0), keyed("last_value", 12345678.5), hist).collect()}
    assert lines["counter"] == "# TYPE k counter\nk 2.0" and lines["gauge"] == "# TYPE k gauge\nk 12345678.5"
    assert lines["histogram"].startswith("# TYPE k histogram\nk_count 2\nk_avg 1.0")


def test_costs(spark):
    row = spark.range(1).select(
        usage.cost_estimate(F.lit("anthropic"), F.lit(1_000_000), F.lit(500)).alias("a"),
        usage.token_estimate(F.lit("one two\nthree"), F.lit("openai")).alias("t"),
        usage.token_estimate(F.lit("one two"), F.lit("ollama")).alias("o"),
    ).head()
    assert row.a == pytest.approx(3.0075) and (row.t, row.o) == (6, 0)


def test_retry_log(spark):
    rows = [(1, 0, True), (2, 0, False), (2, 1, True), (2, 2, True), (3, 0, False), (3, 1, False), (3, 2, False), (3, 3, False), (4, 0, False), (4, 1, False), (4, 2, False), (4, 3, True)]
    log = usage.retry_log(spark.createDataFrame(rows, "request_id bigint, attempt int, ok boolean"))
    assert sorted(map(tuple, log.collect())) == [(1, 1, 0, 0.0, False), (2, 2, 1, 1.5, False), (3, 4, 4, 17.0, True), (4, 4, 3, 8.5, False)]


def test_prompts_that_differ_late_have_different_keys(spark):
    row = spark.range(1).select(*[T.prompt_key(F.lit("m"), F.lit("s" * 300 + a), F.lit("u" * 600 + b)).alias(n)
                                  for n, a, b in (("x", "", ""), ("y", "", "!"), ("z", "!", ""), ("w", "", ""))]).head()
    assert row.x == row.w and len({row.x, row.y, row.z}) == 3


def test_prompt_dedup_keeps_first(spark):
    rows = [("k", 3, 0, "c"), ("k", 1, 2, "a"), ("k", 1, 5, "b"), ("x", 9, 9, "z")]
    found = usage.prompt_dedup(spark.createDataFrame(rows, "prompt_key string, conv_id int, turn int, user_prompt string"), ["conv_id", "turn"])
    assert sorted((r.prompt_key, r.user_prompt, r.hit_count) for r in found.collect()) == [("k", "a", 2), ("x", "z", 0)]


def test_ledger(spark):
    path = scratch_path(spark, "ledger")
    assert tables.ledger_read(spark, path).count() == 0
    files = spark.createDataFrame([("r", p) for p in "abc"], "repo string, path string")
    now = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    entries = spark.createDataFrame([("r", "a", "completed"), ("r", "b", "failed")], "repo string, path string, status string")
    tables.ledger_write(entries.select("*", now), path)
    ledger = tables.ledger_read(spark, path)
    assert sorted(r.path for r in telemetry.remaining_files(files, ledger).collect()) == ["b", "c"]
    assert tuple(tables.ledger_totals(ledger, files).head()) == ("r", 1, 1, 3)
    tables.ledger_clear(spark, path)
    assert tables.ledger_read(spark, path).count() == 0


def test_batches(spark, ws, many_pieces):
    files = spark.range(50).select(F.lit("r").alias("repo"), F.format_string("p%03d", "id").alias("path"))
    got = telemetry.batch_assign(ws, files, 4).collect()
    assert {(r.path, r.batch) for r in got} == {(f"p{i:03d}", i // 4) for i in range(50)}


def test_snapshots(spark):
    root = scratch_path(spark, "rollbacks")
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    one = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    two = spark.createDataFrame([("b", 9), ("c", 3)], "path string, v int")
    point = snapshots.create_snapshot(spark, root, "intake", one, at(100), ["path"], "first stock count").head()
    assert (point.file_count, point.description, point.snapshot_id) == (2, "first stock count", "intake_100")
    # same phase and second: merged
    assert snapshots.create_snapshot(spark, root, "intake", two, at(100), ["path"]).head().file_count == 3
    assert snapshots.create_snapshot(spark, root, "sorting", None, at(150), ["path"]).head().file_count == 0
    snapshots.create_snapshot(spark, root, "intake", one, at(200), ["path"])
    restored = snapshots.restore_snapshot(spark, root, "intake", one.schema)
    assert sorted(map(tuple, restored.collect())) == [("a", 1), ("b", 2)]
    assert snapshots.restore_snapshot(spark, root, "nothing", one.schema) is None
    snapshots.cleanup(spark, root, 1)
    left = history.list_snapshots(snapshots.read_log(spark, root)).collect()
    assert [p.path for p in left] == ["intake_200"]
    actions = [r.action for r in snapshots.read_log(spark, root).collect()]
    assert (actions.count("CREATE_ROLLBACK"), actions.count("ROLLBACK"), actions.count("CLEANUP")) == (4, 1, 2)


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 1), (4, "d", 1)], "id int, x string, y int")
    found = history.snapshot_diff(old, new, ["id"])
    assert sorted(map(tuple, found.collect())) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_priority_order(spark):
    hooks = spark.createDataFrame(
        [("ship", 70, 0, True), ("pack", 30, 1, True), ("idle", 1, 2, False), ("label", 30, 3, True)],
        "name string, priority int, seq int, enabled boolean",
    )
    assert [r.name for r in telemetry.priority_order(hooks).collect()] == ["pack", "label", "ship"]


def test_json_log_round_trip(spark):
    entries = spark.createDataFrame([(1.5, "INFO", "run", "say \"hi\"\n", 7)], "timestamp double, level string, run_id string, message string, k int")
    parsed = tables.parse_json_log(tables.json_log(entries, [F.col("k")]))
    row = parsed.select("*", F.try_variant_get("entry", "$.k", "int").alias("k")).head()
    assert (row.timestamp, row.level, row.message, row.k) == (1.5, "INFO", 'say "hi"\n', 7)


def test_workspace_releases_tables(spark):
    ws = Workspace(spark, "drop")
    first, counted = ws.save_counted(spark.range(3), top=F.max("id"))
    second = ws.save(spark.range(4))
    assert (counted["rows"], counted["top"], first.count()) == (3, 2, 3)
    ws.release(first)
    assert second.count() == 4 and not tables.exists(spark, f"{ws.root}/00000")
