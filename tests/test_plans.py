"""The physical plans the operators are written for."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourceloom.operators import (
    analysis, checks, classify, diff, graph, imports, ordered, rewrite, symbols, usage,
)
from sourceloom.sources import files as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, two_repos, tmp_path_factory):
    """The fixture as a table on disk, so that scans show in the plans."""
    path = str(tmp_path_factory.mktemp("stored") / "files")
    two_repos.write.parquet(path)
    return spark.read.parquet(path)


def test_row_local_operators_do_not_shuffle(stored):
    migrated = rewrite.render_migrated(stored, "go")
    for df in (
        S.load_corpus(stored), imports.extract_imports(stored), symbols.classes(stored), symbols.functions(stored),
        symbols.exports(stored), symbols.python_imports(stored), symbols.js_imports(stored), migrated,
        diff.batch_diff(migrated), diff.semantic_changes(migrated), checks.migrated_refs(migrated),
        classify.entry_points(stored),
    ):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_text_is_not_read_where_only_keys_are_needed(stored):
    edges = imports.dependency_edges(stored)
    assert "content" not in plan(graph.graph_degrees(stored, edges.select("repo", "source_file", "target_file").limit(0)))
    assert "content" not in plan(analysis.language_counts(stored))


def test_top_rows_are_cut_before_the_shuffle(stored):
    assert "WindowGroupLimit" in plan(analysis.first_n_files(stored, 5, 10))
    assert "WindowGroupLimit" in plan(ordered.first_rows(stored, 5, ["repo"], [F.col("path")]))


def test_aggregates_combine_before_the_shuffle(stored):
    text = plan(analysis.avg_complexity(stored))
    assert "partial_sum" in text
    requests = stored.select(F.col("path").alias("prompt_key"), F.col("size_bytes").alias("turn"))
    assert "partial_min" in plan(usage.prompt_dedup(requests, ["turn"]))


def test_size_filter_reaches_the_file_scan(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x")
    assert "LessThanOrEqual(length,512000)" in plan(S.size_filter(S.read_tree(spark, str(tmp_path)), 500))


def test_repositories_stay_apart(spark, ws, two_repos):
    one = two_repos.filter("repo = 'warehouse'").withColumn("repo", F.lit("r"))
    both = one.unionByName(one.withColumn("repo", F.lit("r2")))
    edges = imports.dependency_edges(both).cache()
    assert sorted(r.repo for r in edges.collect()) == ["r"] * 6 + ["r2"] * 6
    layers = graph.topo_layers(ws, both, edges)
    order = graph.migration_order(ws, layers).groupBy("repo").agg(F.max("position").alias("m")).collect()
    assert {r.repo: r.m for r in order} == {"r": 5, "r2": 5}
    found = checks.run_checks(
        ws, rewrite.render_migrated(both, "typescript"), edges, classify.entry_points(both),
        graph.components(ws, graph.simple_edges(edges)), "typescript",
    )
    report = {r.repo: r.total_checks for r in checks.validation_report(found).collect()}
    assert report == {"r": 10, "r2": 10}


def test_arrow_function_as_translation(two_repos):
    @F.pandas_udf("string")
    def shout(text: pd.Series) -> pd.Series:
        return text.str.upper()

    out = rewrite.translate_with(two_repos, "rust", shout("content"))
    assert out.filter("migrated_content = upper(original_content)").count() == 7
    assert "ArrowEvalPython" in plan(out)


def test_all_checks_read_the_texts_once(spark, tmp_path, monkeypatch):
    """Counted over every table that is written on the way and the result."""
    from sourceloom.plans.common import Inputs
    from sourceloom.session import Workspace

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plans, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    found = Inputs(spark, str(tmp_path)).checks
    plans.append(plan(found))
    # a scan is named in the tree and again in its details, by one of the two
    scans = sum(p.count("FileScan parquet [doc_id#") for p in plans)
    assert found.count() > 60 and 1 <= scans <= 2


@pytest.mark.parametrize("name, passes", [("cyclic_files", 1), ("corpus_summary", 2), ("assemble_prompts", 4), ("migration_report", 1)])
def test_queries_read_the_texts_in_few_passes(spark, tmp_path, monkeypatch, name, passes):
    """Scans of the texts in every table that is written on the way and in the result."""
    import re

    from sourceloom.plans import catalog
    from sourceloom.session import Workspace

    docs = spark.range(48).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plans, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    plans.append(plan(catalog.run(name, spark, str(tmp_path))))
    # a plan that is not run yet shows each scan once as a node of its tree
    assert sum(len(re.findall(r"FileScan parquet \[doc_id#\d+L?,text#", p)) for p in plans) <= passes
