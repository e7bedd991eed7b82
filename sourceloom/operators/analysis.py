"""Per-repository aggregates over files and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import classify, ordered
from sourceloom.session import Workspace


def file_facts(content: Column, path: Column) -> list[Column]:
    """What summaries ask of a text; with repo, path, language and file type, they stand for the files in the functions below."""
    return [classify.is_entry_point(path, content).alias("entry"), T.complexity_distinct(content).alias("complexity"),
            framework_rank(content).alias("framework_rank")]


def _fact(files: DataFrame, name: str, otherwise: Column) -> Column:
    """A fact of a file, or what it is worked out from where ``files`` have texts."""
    return F.col(name) if name in files.columns else otherwise


def _per_language(files: DataFrame) -> DataFrame:
    known = files.filter(F.col("language") != "unknown")
    return known.groupBy("repo", "language").agg(F.count("*").alias("files"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per known language, most frequent first."""
    return _per_language(files).orderBy("repo", F.desc("files"), "language")


def avg_complexity(files: DataFrame) -> DataFrame:
    """Mean number of different branch keywords per source file; 0 without source files."""
    source = F.col("file_type") == "source"
    found = F.sum(F.when(source, T.complexity_distinct(F.col("content"))).otherwise(0))
    return files.groupBy("repo").agg(
        (found / F.greatest(F.count_if(source), F.lit(1))).alias("avg_complexity")
    )


def module_groups(ws: Workspace, files: DataFrame, part_size: int = 1000) -> DataFrame:
    """Sorted paths of each module, in consecutive parts of bounded length.

    The parts of a module, joined in order, are its whole list; no task holds a whole module.
    """
    assigned = files.select("repo", T.module_of(F.col("path")).alias("module"), "path")
    placed = ordered.positions(ws, assigned, ["repo", "module"], [F.col("path")], "position")
    part = F.floor((F.col("position") - 1) / part_size).cast("bigint")
    return placed.groupBy("repo", "module", part.alias("part")).agg(
        F.count("*").alias("files"), F.array_sort(F.collect_list("path")).alias("paths")
    )


def first_n_files(files: DataFrame, n: int, chars: int) -> DataFrame:
    """The first files by path per repository, cut to their first characters before any shuffle."""
    cut = files.withColumn("content", T.preview(F.col("content"), chars))
    return ordered.first_rows(cut, n, ["repo"], [F.col("path")]).drop("_rank")


def framework_rank(content: Column) -> Column:
    """Number of the first signature that a text has."""
    rank = None
    for i, (_, pattern) in enumerate(rules.FRAMEWORK_SIGNATURES):
        hit = content.rlike(T.java(pattern, multiline=False))
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return rank


def detect_framework(files: DataFrame) -> DataFrame:
    """First signature in table order that any file of the repository has, in whole texts.

    Each file yields the rank of its own first signature; only ranks are shuffled.
    """
    rank = _fact(files, "framework_rank", framework_rank(F.col("content")))
    names = T.literal_array([name for name, _ in rules.FRAMEWORK_SIGNATURES])
    first = files.select("repo", rank.alias("rank")).groupBy("repo").agg(F.min("rank").alias("rank"))
    return first.select("repo", F.get(names, F.col("rank")).alias("framework"))


def top_entry_points(files: DataFrame, n: int = rules.LISTED_ENTRY_POINTS) -> DataFrame:
    """The first entry points by path of each repository, as one list; takes files or their facts."""
    entries = files.where("entry").select("repo", "path") if "entry" in files.columns else classify.entry_points(files)
    first = ordered.first_rows(entries, n, ["repo"], [F.col("path")])
    return first.groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("entry_points"))


def analysis_summary(files: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row per repository: the scalars an analysis run reports; takes files or their facts."""
    by_language = _per_language(files).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), F.col("language")))).alias("l")
    ).select("repo", F.transform("l", lambda x: x["language"]).alias("languages"))
    source = F.col("file_type") == "source"
    totals = files.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        (
            F.sum(F.when(source, _fact(files, "complexity", T.complexity_distinct(F.col("content")))).otherwise(0))
            / F.greatest(F.count_if(source), F.lit(1))
        ).alias("avg_complexity"),
    )
    links = edges.groupBy("repo").agg(F.count("*").alias("dependency_edges"))
    cycles = components.groupBy("repo").agg(
        F.count("*").alias("cyclic_files"), F.countDistinct("component").alias("cycle_groups")
    )
    counts = ["dependency_edges", "cyclic_files", "cycle_groups"]
    return (
        totals.join(by_language, "repo", "left").join(links, "repo", "left").join(cycles, "repo", "left")
        .select(
            "repo", "total_files", F.array_join("languages", ", ").alias("languages"), "avg_complexity",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        )
    )
