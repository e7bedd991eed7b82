"""Context datasets: repository summaries and per-file prompts for a batch model job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import analysis, graph, ordered


def _joined_in_order(rows: Column, separator: str) -> Column:
    """Texts of (order..., text) structs, sorted and joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"]), separator)


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else T.preview(text, chars)


def corpus_summary(
    files: DataFrame, summary: DataFrame, frameworks: DataFrame, first_files: int | None = None, chars: int | None = None,
    facts_of: DataFrame | None = None,
) -> DataFrame:
    """One text per repository: its facts and its files by path.

    Whole files, unless the caller names how many of them and how many of their characters are wanted; then
    no more than that is gathered.  The text of a repository is one value, so whole ones suit small repositories only.
    ``facts_of`` are the facts of the same files, if a pass over the texts has left them: entry points and first paths then come from there.
    """
    known = files if facts_of is None else facts_of
    a, b, c, d, e = rules.SUMMARY_BLOCK
    cut = files.withColumn("content", _head(F.col("content"), chars))
    if facts_of is not None and first_files is not None:
        # rows of the first paths only, repeated ones included; the cut texts of all others need not be sorted
        wanted = ordered.first_rows(known.select("repo", "path"), first_files, ["repo"], [F.col("path")])
        cut = cut.join(wanted.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    heads = cut if first_files is None else ordered.first_rows(cut, first_files, ["repo"], [F.col("path")]).drop("_rank")
    block = F.concat(
        F.lit(a), "path", F.lit(b), "language", F.lit(c), "file_type", F.lit(d), "content", F.lit(e)
    )
    blocks = heads.groupBy("repo").agg(
        _joined_in_order(F.struct(F.col("path"), block.alias("text")), "\n\n").alias("blocks")
    )
    facts = (
        summary.join(frameworks, "repo", "left").join(analysis.top_entry_points(known), "repo", "left")
        .select(
            "repo",
            F.concat_ws(
                "\n",
                F.concat(F.lit("framework: "), F.coalesce("framework", F.lit("Unknown"))),
                F.concat(F.lit("languages: "), F.coalesce("languages", F.lit(""))),
                F.concat(F.lit("entry points: "), F.coalesce(F.array_join("entry_points", ", "), F.lit(""))),
                F.concat(F.lit("files: "), F.col("total_files").cast("string")),
                F.concat(F.lit("dependency edges: "), F.col("dependency_edges").cast("string")),
                F.concat(F.lit("files on cycles: "), F.col("cyclic_files").cast("string")),
            ).alias("facts"),
        )
    )
    return facts.join(blocks, "repo", "left").select(
        "repo", F.concat_ws("\n\n", "facts", "blocks").alias("summary")
    )


def dep_context(edges: DataFrame, layers: DataFrame, migrated: DataFrame, chars: int | None = None) -> DataFrame:
    """The rewritten dependencies that come earlier, per file and in import order; whole, or their first ``chars`` characters.

    Texts are cut before they move; a file has at most as many dependencies as it has imports,
    which its size bounds.
    """
    a, b, c = rules.DEPENDENCY_BLOCK
    key = graph.order_key(F.col("layer"), F.col("path"))
    sources = layers.select("repo", F.col("path").alias("source_file"), key.alias("source_ord"))
    # order and head of a target meet on unique keys, so a much-imported file is joined once
    targets = layers.select("repo", F.col("path").alias("target_file"), key.alias("target_ord")).join(
        migrated.select(
            "repo", F.col("original_path").alias("target_file"),
            _head(F.col("migrated_content"), chars).alias("head"),
        ),
        ["repo", "target_file"],
    )
    earlier = (
        edges.select("repo", "source_file", "target_file", "pattern_no", "match_no")
        .join(sources, ["repo", "source_file"])
        .join(targets, ["repo", "target_file"])
        .filter("target_ord < source_ord")
    )
    block = F.concat(F.lit(a), "target_file", F.lit(b), "head", F.lit(c))
    return earlier.groupBy("repo", F.col("source_file").alias("path")).agg(
        F.count("*").alias("dependencies"),
        _joined_in_order(F.struct("pattern_no", "match_no", block.alias("text")), "").alias("context"),
    )


def type_lines(language: Column, target: str) -> Column:
    """The type mapping of a source language as lines; empty where there is none."""
    table = {
        lang: "\n".join(f"  {k} → {v}" for k, v in targets[target].items())
        for lang, targets in rules.TYPE_MAPPINGS.items() if target in targets
    }
    return F.coalesce(T.lookup(language, table), F.lit("")) if table else F.lit("")


def assemble_prompts(
    files: DataFrame, summaries: DataFrame, contexts: DataFrame, imports: DataFrame, exports: DataFrame, target: str,
    summary_chars: int | None = None,
) -> DataFrame:
    """One prompt per file from the summary, type map, symbols, dependencies and whole text.

    The summary is whole, or its first ``summary_chars`` characters.
    """
    imported = imports.groupBy("repo", "path").agg(
        F.array_join(F.array_sort(F.collect_set("import_path")), ", ").alias("imports")
    )
    exported = exports.groupBy("repo", "path").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("exports")
    )
    short = summaries.select("repo", _head(F.col("summary"), summary_chars).alias("summary"))
    joined = (
        files.join(imported, ["repo", "path"], "left")
        .join(exported, ["repo", "path"], "left")
        .join(contexts.select("repo", "path", "context"), ["repo", "path"], "left")
        .join(short, "repo", "left")
    )
    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    parts = [
        F.lit(f"Rewrite one file in {target}."),
        F.concat(F.lit("[summary]\n"), blank("summary")),
        F.concat(F.lit("[types]\n"), type_lines(F.col("language"), target)),
        F.concat(
            F.lit("[file]\npath: "), "path", F.lit("\nlanguage: "), "language", F.lit("\ntype: "), "file_type",
            F.lit("\nimports: "), blank("imports"), F.lit("\nexports: "), blank("exports"),
        ),
        F.concat(F.lit("[dependencies]\n"), F.coalesce("context", F.lit(rules.NO_DEPENDENCIES))),
        F.concat(F.lit("[source]\n"), "content"),
    ]
    return joined.select("repo", "path", F.concat_ws("\n\n", *parts).alias("prompt"))


def doc_prompt(report: DataFrame, target: str) -> DataFrame:
    """Documentation prompt per repository from its report summary."""
    return report.select(
        "repo",
        F.format_string(
            "Write a README for a rewritten code base.\nsource: %s\ntarget: %s\nfiles: %d\nvalidation: %d/%d checks passed",
            "repo", F.lit(target), "files_migrated", "passed_checks", "total_checks",
        ).alias("prompt"),
    )
