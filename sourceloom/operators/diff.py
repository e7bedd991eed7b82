"""Differences between two versions of a text, row by row and without a shuffle.

A file is bounded by the size filter, so its two line lists are compared inside the row: both
are sorted together and one pass over them keeps a balance per line value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T

_STATE = "struct<line:string,balance:bigint,added:bigint,removed:bigint>"


def _bag_difference(old: Column, new: Column) -> Column:
    """Struct of lines only in ``new`` (added) and only in ``old`` (removed), counted as bags."""
    def tagged(values: Column, side: int) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("line"), F.lit(side).alias("side")))

    both = F.array_sort(F.concat(tagged(old, 0), tagged(new, 1)))

    def step(state: Column, item: Column) -> Column:
        same = item["line"].eqNullSafe(state["line"])
        carried = F.when(same, state["balance"]).otherwise(F.lit(0))
        unmatched = F.when(same, F.lit(0)).otherwise(state["balance"])
        is_old = item["side"] == 0
        paired = carried > 0
        return F.struct(
            item["line"].alias("line"),
            F.when(is_old, carried + 1).when(paired, carried - 1).otherwise(carried).alias("balance"),
            (state["added"] + F.when(~is_old & ~paired, 1).otherwise(0)).alias("added"),
            (state["removed"] + unmatched).alias("removed"),
        ).cast(_STATE)

    start = F.struct(F.lit(None), F.lit(0), F.lit(0), F.lit(0)).cast(_STATE)
    return F.aggregate(
        both, start, step,
        lambda s: F.struct(s["added"].alias("added"), (s["removed"] + s["balance"]).alias("removed")),
    )


def line_diff_stats(migrated: DataFrame, *more: Column) -> DataFrame:
    """Lines added, removed and unchanged per file; a moved line counts as unchanged.

    ``change_ratio`` is 1 - 2M/T with M the lines in common and T the lines of both sides.
    """
    counted = (
        migrated.withColumn("_old", T.kept_lines(F.col("original_content")))
        .withColumn("_new", T.kept_lines(F.col("migrated_content")))
        .withColumn("_d", _bag_difference(F.col("_old"), F.col("_new")))
        .withColumn("_n_old", F.size("_old").cast("bigint"))
        .withColumn("_n_new", F.size("_new").cast("bigint"))
    )
    total = F.col("_n_old") + F.col("_n_new")
    changed = (F.col("_d.added") + F.col("_d.removed")) / F.greatest(total, F.lit(1))
    return counted.select(
        "repo", F.col("original_path").alias("path"),
        T.extension_label(F.col("original_path")).alias("original_language"), "target_language",
        F.col("_d.added").alias("lines_added"), F.col("_d.removed").alias("lines_removed"),
        F.greatest(F.col("_n_old") - F.col("_d.removed"), F.lit(0)).alias("lines_unchanged"),
        changed.alias("change_ratio"), *more,
    )


def defined_names(text: Column) -> Column:
    return F.array_distinct(T.find_all(text, rules.DEFINITION_PATTERN, 1, multiline=False))


def semantic_changes(migrated: DataFrame) -> DataFrame:
    """Names defined on one side only: repo, path, type, name."""
    old, new = defined_names(F.col("original_content")), defined_names(F.col("migrated_content"))

    def labelled(names: Column, label: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(label).alias("type"), n.alias("name")))

    changes = F.concat(
        labelled(F.array_except(new, old), "function_added"),
        labelled(F.array_except(old, new), "function_removed_or_renamed"),
    )
    return migrated.select("repo", F.col("original_path").alias("path"), F.explode(changes).alias("c")).select(
        "repo", "path", "c.type", "c.name"
    )


def batch_diff(migrated: DataFrame) -> DataFrame:
    """Line statistics with the number of semantic changes per file."""
    old, new = defined_names(F.col("original_content")), defined_names(F.col("migrated_content"))
    changes = F.size(F.array_except(new, old)) + F.size(F.array_except(old, new))
    return line_diff_stats(migrated, changes.cast("bigint").alias("semantic_changes"))


def diff_totals(diffs: DataFrame) -> DataFrame:
    """Head of the difference report, per repository."""
    return diffs.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_removed").alias("lines_removed"),
        (F.sum("change_ratio") / F.greatest(F.count("*"), F.lit(1)) * 100).alias("avg_change_pct"),
    )
