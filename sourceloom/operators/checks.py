"""Data-quality checks over rewritten files; every check emits the ``checks`` columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import ordered
from sourceloom.session import Workspace

_COLUMNS = ["repo", "check_name", "passed", "severity", "details"]


def ref_matches(content: Column) -> Column:
    """References found in rewritten text as structs (pattern_no, match_no, ref)."""
    def matches(i: int, pattern: str) -> Column:
        return F.transform(
            T.find_all(content, pattern, 1, multiline=False),
            lambda ref, k: F.struct(
                F.lit(i).alias("pattern_no"), (k + 1).alias("match_no"), ref.alias("ref")
            ),
        )

    return F.concat(*[matches(i, p) for i, p in enumerate(rules.REWRITTEN_IMPORT_PATTERNS)])


def file_facts(migrated: DataFrame, target: str, *more: Column) -> DataFrame:
    """Everything the checks ask of a file's texts, in one pass over them: a narrow row a file.

    Written once, it takes the place of ``migrated`` in every check, so that no text is read again.  ``more`` adds columns.
    """
    content = F.col("migrated_content")
    return migrated.select(
        "repo", "original_path", "new_path", ref_matches(content).alias("refs"), T.near_empty(content).alias("near_empty"),
        T.untranslated(F.col("original_content"), content).alias("untranslated"),
        name_violation(F.col("new_path"), target).alias("violation"), *more,
    )


def _fact(rows: DataFrame, name: str, otherwise: Column) -> Column:
    """A fact of a file, or what it is worked out from where ``rows`` have texts."""
    return F.col(name) if name in rows.columns else otherwise


def migrated_refs(migrated: DataFrame) -> DataFrame:
    """References found in rewritten text, one row per match; takes ``migrated`` or its facts, as all checks do."""
    found = _fact(migrated, "refs", ref_matches(F.col("migrated_content")))
    return migrated.select("repo", "new_path", "original_path", F.explode(found).alias("m")).select(
        "repo", "new_path", "original_path", "m.*"
    )


def unresolved_refs(ws: Workspace, migrated: DataFrame) -> DataFrame:
    """Local references that occur inside no new path of their repository.

    A local reference starts with "." or "src/", so it lies inside a path exactly when it is a
    prefix of one of the few path tails that start there.  All strings with a given prefix are
    neighbours in sort order, so it is enough to look at the next tail: a merge of two sorted
    lists instead of comparing every reference with every path.
    """
    starts = T.any_of([F.startswith(F.col("ref"), F.lit(p)) for p in rules.LOCAL_REFERENCE_PREFIXES])
    local = ws.save(migrated_refs(migrated).filter(starts))
    tail = F.explode(
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.length("new_path")),
                lambda i: F.substring(F.col("new_path"), i, F.length("new_path")),
            ),
            lambda t: T.any_of([F.startswith(t, F.lit(p)) for p in rules.LOCAL_REFERENCE_PREFIXES]),
        )
    )
    tails = migrated.filter(F.length("new_path") > 0).select("repo", tail.alias("text")).distinct()
    refs = local.select("repo", F.col("ref").alias("text")).distinct()
    both = refs.withColumn("is_tail", F.lit(False)).unionAll(tails.withColumn("is_tail", F.lit(True)))
    merged = ordered.next_value(
        ws, both, ["repo"], [F.col("text"), F.col("is_tail")],
        F.when(F.col("is_tail"), F.col("text")), "next_tail",
    )
    inside = F.coalesce(F.startswith(F.col("next_tail"), F.col("text")), F.lit(False))
    missing = merged.filter(~F.col("is_tail") & ~inside).select("repo", F.col("text").alias("ref"))
    return local.join(missing, ["repo", "ref"], "left_semi").select(
        "repo", "original_path", "new_path", "ref", "pattern_no", "match_no"
    )


def check_imports(ws: Workspace, migrated: DataFrame) -> DataFrame:
    """One check per file."""
    name, bad, good = rules.CHECK_TEXTS["imports"]
    per_file = unresolved_refs(ws, migrated).groupBy("repo", "original_path").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pattern_no", "match_no", "ref"))), lambda x: x["ref"]
            ), ", ",
        ).alias("refs")
    )
    files = migrated.select("repo", "original_path", "new_path").join(per_file, ["repo", "original_path"], "left")
    fine = F.col("refs").isNull()
    return files.select(
        "repo",
        F.concat(F.lit(name), "new_path").alias("check_name"),
        fine.alias("passed"),
        F.when(fine, "info").otherwise("error").alias("severity"),
        F.when(fine, good).otherwise(F.concat(F.lit(bad), "refs")).alias("details"),
    )


def _offenders(migrated: DataFrame, offenders: DataFrame) -> DataFrame:
    """Per repository: files, number of offenders and the first few by original path."""
    bounded = ordered.first_rows(
        offenders.select("repo", "original_path", "new_path"),
        rules.LISTED_OFFENDERS, ["repo"], [F.col("original_path")],
    )
    listed = bounded.groupBy("repo").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("original_path", "new_path"))), lambda x: x["new_path"]
            ), ", ",
        ).alias("first")
    )
    counted = offenders.groupBy("repo").agg(F.count("*").alias("n"))
    totals = migrated.groupBy("repo").agg(F.count("*").alias("files"))
    return totals.join(counted, "repo", "left").join(listed, "repo", "left").select(
        "repo", "files", F.coalesce("n", F.lit(0)).alias("n"), "first"
    )


def _verdict(rows: DataFrame, name: str, failed: Column, severity: str, bad: Column, good: str) -> DataFrame:
    return rows.select(
        "repo",
        F.lit(name).alias("check_name"),
        (~failed).alias("passed"),
        F.when(failed, severity).otherwise("info").alias("severity"),
        F.when(failed, bad).otherwise(good).alias("details"),
    )


def orphan_files(migrated: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Files that nothing imports and that are no entry points."""
    used = edges.select("repo", F.col("target_file").alias("original_path")).distinct()
    entries = entry_points.select("repo", F.col("path").alias("original_path"))
    return (
        migrated.select("repo", "original_path", "new_path")
        .join(used, ["repo", "original_path"], "left_anti")
        .join(entries, ["repo", "original_path"], "left_anti")
    )


def check_orphans(migrated: DataFrame, edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Fails only while orphans are fewer than half of the files."""
    name, bad, good = rules.CHECK_TEXTS["orphans"]
    rows = _offenders(migrated, orphan_files(migrated, edges, entry_points))
    failed = (F.col("n") > 0) & (F.col("n") < F.col("files") * 0.5)
    before, after = bad.split("{n}")
    details = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after), "first")
    return _verdict(rows, name, failed, "warning", details, good)


def name_violation(path: Column, target: str) -> Column:
    """Does the file name hold a character the target's convention forbids?"""
    if target not in rules.NAMING_FORBIDDEN:
        return F.lit(False)
    return F.replace(T.file_name(path), F.lit("."), F.lit("")).rlike(rules.NAMING_FORBIDDEN[target])


def check_naming(migrated: DataFrame, target: str) -> DataFrame:
    name, bad, good = rules.CHECK_TEXTS["naming"]
    rows = _offenders(migrated, migrated.filter(_fact(migrated, "violation", name_violation(F.col("new_path"), target))))
    return _verdict(
        rows, name, F.col("n") > 0, "warning", F.concat(F.lit(bad), "first"), good.replace("{target}", target)
    )


def check_cycles(migrated: DataFrame, components: DataFrame) -> DataFrame:
    """Reports the number of separate cycle groups."""
    name, bad, good = rules.CHECK_TEXTS["cycles"]
    groups = components.groupBy("repo").agg(F.countDistinct("component").alias("n"))
    rows = migrated.select("repo").distinct().join(groups, "repo", "left").select(
        "repo", F.coalesce("n", F.lit(0)).alias("n")
    )
    before, after = bad.split("{n}")
    details = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))
    return _verdict(rows, name, F.col("n") > 0, "warning", details, good)


def check_completeness(migrated: DataFrame) -> DataFrame:
    name, bad, good = rules.CHECK_TEXTS["completeness"]
    rows = _offenders(migrated, migrated.filter(_fact(migrated, "near_empty", T.near_empty(F.col("migrated_content")))))
    return _verdict(rows, name, F.col("n") > 0, "error", F.concat(F.lit(bad), "first"), good)


def check_untranslated(migrated: DataFrame) -> DataFrame:
    name, bad, good = rules.CHECK_TEXTS["untranslated"]
    same = T.untranslated(F.col("original_content"), F.col("migrated_content"))
    rows = _offenders(migrated, migrated.filter(_fact(migrated, "untranslated", same)))
    return _verdict(rows, name, F.col("n") > 0, "error", F.concat(F.lit(bad), "first"), good)


def offenders(migrated: DataFrame, edges: DataFrame, entry_points: DataFrame, target: str) -> DataFrame:
    """Every file that a check on single files finds fault with: repo, check_name, path.

    The verdicts name the first few; this table has them all.  Three checks look at a row once,
    orphans at keys only.
    """
    names = {k: rules.CHECK_TEXTS[k][0] for k in ("orphans", "naming", "completeness", "untranslated")}
    faults = F.array_compact(F.array(
        F.when(name_violation(F.col("new_path"), target), names["naming"]),
        F.when(T.near_empty(F.col("migrated_content")), names["completeness"]),
        F.when(T.untranslated(F.col("original_content"), F.col("migrated_content")), names["untranslated"]),
    ))
    own = migrated.select("repo", F.explode_outer(faults).alias("check_name"), F.col("new_path").alias("path")).filter("check_name IS NOT NULL")
    alone = orphan_files(migrated, edges, entry_points).select("repo", F.lit(names["orphans"]).alias("check_name"), F.col("new_path").alias("path"))
    return own.unionByName(alone)


def run_checks(
    ws: Workspace, migrated: DataFrame, edges: DataFrame, entry_points: DataFrame,
    components: DataFrame, target: str,
) -> DataFrame:
    """All six checks: one row per file and five per repository.  Texts are read once, unless ``migrated`` is its facts already."""
    if "near_empty" not in migrated.columns:
        migrated = ws.save(file_facts(migrated, target))
    parts = [
        check_imports(ws, migrated),
        check_orphans(migrated, edges, entry_points),
        check_naming(migrated, target),
        check_cycles(migrated, components),
        check_completeness(migrated),
        check_untranslated(migrated),
    ]
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS) for p in parts])


def validation_report(checks: DataFrame) -> DataFrame:
    return checks.groupBy("repo").agg(
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        (F.count_if("passed") / F.greatest(F.count("*"), F.lit(1)) * 100).alias("success_rate"),
    )
