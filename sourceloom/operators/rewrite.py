"""Rewritten files: target templates, new paths, rendered text, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import graph
from sourceloom.session import Workspace

TEMPLATE_FIELDS = ["file_extension", "import_style", "package_manager", "type_system"]


def template_field(target: Column, field: str) -> Column:
    i = TEMPLATE_FIELDS.index(field)
    table = {name: values[i] for name, values in rules.TARGET_TEMPLATES.items()}
    return F.coalesce(T.lookup(target, table), F.lit(table[rules.DEFAULT_TARGET]))


def target_template(df: DataFrame, target: str = "target") -> DataFrame:
    """Add the template of a target language; unknown targets use the default one."""
    return df.withColumns({f: template_field(F.col(target), f) for f in TEMPLATE_FIELDS})


def stand_in_text(target: str) -> Column:
    a, b, c, d = rules.MIGRATED_HEADER
    return F.concat(F.lit(a), "language", F.lit(b + target + c), "path", F.lit(d), "content")


def render_migrated(files: DataFrame, target: str, translate: Column | None = None) -> DataFrame:
    """The ``migrated`` relation; ``translate`` is any column expression or Arrow UDF over a file row."""
    extension = template_field(F.lit(target), "file_extension")
    return files.select(
        "repo",
        F.col("path").alias("original_path"),
        T.target_path(F.col("path"), extension).alias("new_path"),
        F.col("content").alias("original_content"),
        (stand_in_text(target) if translate is None else translate).alias("migrated_content"),
        F.lit(target).alias("target_language"),
        F.lit(rules.STAND_IN_CONFIDENCE).alias("confidence_score"),
        F.array().cast("array<string>").alias("warnings"),
    )


def translate_with(files: DataFrame, target: str, translate: Column) -> DataFrame:
    return render_migrated(files, target, translate)


def staged(df: DataFrame, stages: list[tuple[str, object]]) -> DataFrame:
    """Apply named DataFrame functions in order."""
    for _, stage in stages:
        df = df.transform(stage)
    return df


def confidence_range(migrated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a confidence in [0, 1], and the rest for quarantine."""
    ok = F.coalesce(F.col("confidence_score").between(0.0, 1.0), F.lit(False))
    return migrated.filter(ok), migrated.filter(~ok)


def last_writers(ws: Workspace, migrated: DataFrame, layers: DataFrame) -> DataFrame:
    """Keep, per new path, the file that comes last in dependency order.

    Only keys are grouped.  The overwritten files, if any, form a saved table that is taken
    off the wide rows, so contents move only if that table is too large to broadcast.
    """
    keyed = migrated.select("repo", "original_path", "new_path").join(
        layers.withColumnRenamed("path", "original_path"), ["repo", "original_path"], "left"
    ).withColumn("ord", graph.order_key(F.col("layer"), F.col("original_path")))
    shared = keyed.groupBy("repo", "new_path").agg(F.count("*").alias("n"), F.max("ord").alias("last")).filter("n > 1")
    overwritten = ws.save(
        keyed.join(shared, ["repo", "new_path"]).filter("ord < last").select("repo", "original_path")
    )
    return migrated.join(overwritten, ["repo", "original_path"], "left_anti")


def migration_map(migrated: DataFrame) -> DataFrame:
    return migrated.select(
        "repo", F.col("original_path").alias("original"), F.col("new_path").alias("migrated"),
        F.col("confidence_score").alias("confidence"), "warnings",
    )


def map_json(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.to_json(F.struct("original", "migrated", "confidence", "warnings")).alias("value"))


def report_summary(migrated: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per repository: what the run report puts on top."""
    files = migrated.groupBy("repo").agg(
        F.count("*").alias("files_migrated"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.count_if(F.size("warnings") > 0).alias("files_with_warnings"),
    )
    passed = checks.groupBy("repo").agg(
        F.count_if("passed").alias("passed_checks"), F.count("*").alias("total_checks")
    )
    rate = F.col("passed_checks") / F.greatest(F.col("total_checks"), F.lit(1)) * 100
    return files.join(passed, "repo").withColumn("success_rate", rate)


def migration_report(migrated: DataFrame, checks: DataFrame) -> dict[str, DataFrame]:
    """The parts of a run report as tables: check lines, files with warnings, file mapping."""
    return {
        "checks": checks.select("repo", "check_name", "passed", "severity", "details"),
        "warnings": migrated.select("repo", "new_path", F.explode("warnings").alias("warning")),
        "mapping": migrated.select("repo", "original_path", "new_path", "confidence_score"),
    }
