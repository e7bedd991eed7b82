"""Two small repositories: exact values of every stage, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import analysis, checks, classify, context, diff, graph, imports, rewrite


@pytest.fixture(scope="module")
def edges(spark, two_repos):
    return imports.dependency_edges(two_repos).cache()


@pytest.fixture(scope="module")
def migrated(two_repos):
    return rewrite.render_migrated(two_repos, "typescript").cache()


def test_languages(two_repos):
    assert {tuple(r) for r in analysis.language_counts(two_repos).collect()} == {("warehouse", "python", 5), ("kiosk", "java", 2)}


def test_imports_and_edges(two_repos, edges):
    assert imports.extract_imports(two_repos).count() == 8
    assert {(e.repo, e.source_file, e.target_file) for e in edges.collect()} == {
        ("warehouse", "stock/levels.py", "stock/units.py"), ("warehouse", "stock/levels.py", "stock/limits.py"),
        ("warehouse", "stock/units.py", "stock/levels.py"), ("warehouse", "gate/main.py", "stock/limits.py"),
        ("warehouse", "gate/main.py", "stock/levels.py"), ("warehouse", "checks/levels_test.py", "stock/levels.py"),
    }


def test_framework_entry_points_complexity_modules(ws, two_repos):
    assert {r.repo: r.framework for r in analysis.detect_framework(two_repos).collect()} == {"warehouse": None, "kiosk": "spring-boot"}
    assert [(r.repo, r.path) for r in classify.entry_points(two_repos).collect()] == [("warehouse", "gate/main.py")]
    assert {r.repo: r.avg_complexity for r in analysis.avg_complexity(two_repos).collect()} == {"warehouse": 0.75, "kiosk": 0.0}
    groups = {(r.repo, r.module): r.files for r in analysis.module_groups(ws, two_repos).collect()}
    assert groups == {("warehouse", "stock"): 3, ("warehouse", "gate"): 1, ("warehouse", "checks"): 1, ("kiosk", "menu"): 2}


def test_framework_of_a_late_file_and_a_late_line(spark):
    rows = [("r", f"f{i:03d}.py", "x = 1\n") for i in range(80)] + [("r", "z.py", "#\n" * 5000 + "from flask import Flask\n")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    assert analysis.detect_framework(files).head().framework == "flask"


def test_graph(ws, two_repos, edges):
    cyclic = {r.repo: r.has_cycle for r in graph.has_cycle(ws, two_repos, graph.simple_edges(edges)).collect()}
    assert cyclic == {"warehouse": True, "kiosk": False}
    found = graph.components(ws, graph.simple_edges(edges)).collect()
    assert {(r.path, r.component) for r in found} == {("stock/levels.py", "stock/levels.py"), ("stock/units.py", "stock/levels.py")}
    layers = graph.topo_layers(ws, two_repos, edges)
    assert {r.path for r in layers.collect() if r.layer == 0} == {"stock/limits.py", "menu/Board.java", "menu/Price.java"}


def test_checks_and_report(ws, two_repos, edges, migrated):
    cycles = graph.components(ws, graph.simple_edges(edges))
    found = checks.run_checks(ws, migrated, edges, classify.entry_points(two_repos), cycles, "typescript").cache()
    failed = {(r.repo, r.check_name): r.details for r in found.filter("NOT passed").collect()}
    assert failed == {
        ("warehouse", "Orphaned Files Detection"): "Found 1 potentially orphaned files: checks/levels_test.ts",
        ("warehouse", "Circular Dependency Check"): "Pre-existing circular dependencies found: 1 cycles.",
    }
    report = {r.repo: (r.total_checks, r.passed_checks, r.success_rate) for r in checks.validation_report(found).collect()}
    assert report == {"warehouse": (10, 8, 80.0), "kiosk": (7, 7, 100.0)}
    assert rewrite.migration_report(migrated, found)["mapping"].count() == 7


def test_context(ws, two_repos, edges, migrated):
    layers = graph.topo_layers(ws, two_repos, edges)
    rows = {r.path: r.context for r in context.dep_context(edges, layers, migrated).collect()}
    assert rows["gate/main.py"].startswith("\n### Already translated: stock/limits.py\n```\n")
    assert not any(path.startswith("menu/") for path in rows)


def test_contexts_are_cut_only_where_asked(ws, two_repos, edges):
    long = two_repos.withColumn("content", F.concat("content", F.repeat(F.lit("x"), 5000)))
    texts = rewrite.render_migrated(long, "typescript")
    layers = ws.save(graph.topo_layers(ws, long, edges))
    sizes = lambda *chars: {r.path: len(r.context) for r in context.dep_context(edges, layers, texts, *chars).collect()}
    whole, cut = sizes(), sizes(100)
    assert whole["gate/main.py"] > 5000 and cut["gate/main.py"] < 300
    facts = long.groupBy("repo").agg(F.lit("").alias("languages"), F.count("*").alias("total_files"), F.lit(0).alias("dependency_edges"), F.lit(0).alias("cyclic_files"))
    frameworks = long.select("repo", F.lit("none").alias("framework")).distinct()
    summaries = lambda *cuts: {r.repo: len(r.summary) for r in context.corpus_summary(long, facts, frameworks, *cuts).collect()}
    assert summaries()["warehouse"] > 25_000 and summaries(2, 50)["warehouse"] < 500


def test_added_header_is_the_only_difference(migrated):
    row = migrated.filter("original_path = 'stock/limits.py'").head()
    assert row.new_path == "stock/limits.ts" and row.migrated_content.endswith("TOP = 40  # pallets in one aisle\n")
    assert all(r.lines_added == 3 and r.lines_removed == 0 for r in diff.line_diff_stats(migrated).collect())


def test_custom_translation_and_confidence(two_repos):
    upper = rewrite.translate_with(two_repos, "go", F.upper("content"))
    assert upper.filter("migrated_content = upper(original_content)").count() == 7
    assert {r.new_path.rsplit(".", 1)[1] for r in upper.collect()} == {"go"}
    good, bad = rewrite.confidence_range(upper.withColumn("confidence_score", F.lit(1.5)))
    assert good.count() == 0 and bad.count() == 7


def test_last_writer_wins(spark, ws):
    rows = [("r", p, t, "x", "source", 1) for p, t in [("a.js", "one"), ("a.py", "two"), ("b.js", "three")]]
    files = spark.createDataFrame(
        rows, "repo string, path string, content string, language string, file_type string, size_bytes bigint"
    )
    layers = spark.createDataFrame(
        [("r", "a.js", 1), ("r", "a.py", 0), ("r", "b.js", 0)], "repo string, path string, layer bigint"
    )
    kept = rewrite.last_writers(ws, rewrite.render_migrated(files, "typescript"), layers)
    assert sorted((r.new_path, r.original_path) for r in kept.collect()) == [("a.ts", "a.js"), ("b.ts", "b.js")]
