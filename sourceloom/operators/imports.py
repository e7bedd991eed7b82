"""Import statements and their resolution to files: the dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T


def _matches(pattern_no: int, pattern: str, content: Column) -> Column:
    """All matches of one pattern as structs.

    The capture is taken again from each short match, so the text is scanned once.
    """
    return F.transform(
        T.find_all(content, pattern),
        lambda statement, i: F.struct(
            F.lit(pattern_no).alias("pattern_no"),
            (i + 1).alias("match_no"),
            F.regexp_extract(statement, T.java(pattern), 1).alias("import_path"),
            T.strip(statement).alias("statement"),
        ),
    )


def _patterns(extra: dict[str, list[str]] | None) -> dict[str, list[str]]:
    patterns = {lang: list(found) for lang, found in rules.IMPORT_PATTERNS.items()}
    for lang, found in (extra or {}).items():
        patterns[lang] = patterns.get(lang, []) + found
    return patterns


def import_matches(language: Column, content: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """All import statements of a text as an array; null for languages without patterns."""
    cases = None
    for lang, found in _patterns(extra).items():
        all_matches = F.concat(*[_matches(i, p, content) for i, p in enumerate(found)])
        cases = F.when(language == lang, all_matches) if cases is None else cases.when(language == lang, all_matches)
    return cases


def extract_imports(files: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per match; patterns of a language in order, matches in text order.

    ``extra`` adds patterns per language, known or new.
    """
    return listed_imports(files.filter(F.col("language").isin(list(_patterns(extra)))).select(
        "repo", "path", "language", import_matches(F.col("language"), F.col("content"), extra).alias("imports")))


def file_imports(files: DataFrame, *more: Column) -> DataFrame:
    """repo, path, language and import statements of every file, in one pass over the texts; ``more`` adds columns.

    Written once, it takes the place of ``files`` in ``listed_imports`` and ``dependency_edges``, so that no text is read again.
    """
    return files.select("repo", "path", "language", import_matches(F.col("language"), F.col("content")).alias("imports"), *more)


def listed_imports(files: DataFrame) -> DataFrame:
    """The same from rows (repo, path, language, imports) that hold the matches of their text."""
    return files.select("repo", "path", "language", F.explode("imports").alias("m")).select("repo", "path", "language", "m.*")


def import_stem(import_path: Column, language: Column) -> Column:
    """What an import path looks like before a suffix is added."""
    slashed = F.when(language == "python", F.replace(import_path, F.lit("."), F.lit("/"))).otherwise(import_path)
    return F.replace(F.ltrim(slashed, F.lit("./")), F.lit("\\"), F.lit("/"))


def resolvable_stems(paths: DataFrame) -> DataFrame:
    """For each (repo, stem) the file an import of that stem resolves to.

    Every file answers to at most a few stems, its path minus each suffix it ends with.  So
    the file side is expanded, not the far larger import side, and the winner among the files
    of one stem is chosen before the join, which then meets exactly one row per stem.
    """
    path = F.col("path")
    options = []
    for rank, suffix in enumerate(rules.RESOLUTION_SUFFIXES):
        bare = suffix.lstrip("./")
        if suffix:
            stem = F.substring(path, F.lit(1), F.length(path) - len(suffix))
            longer = F.endswith(path, F.lit(suffix)) & (F.length(path) > len(suffix))
            options.append(F.when(longer, F.struct(stem.alias("stem"), F.lit(rank).alias("rank"))))
            options.append(F.when(path == bare, F.struct(F.lit("").alias("stem"), F.lit(rank).alias("rank"))))
        else:
            options.append(F.struct(path.alias("stem"), F.lit(rank).alias("rank")))
    return (
        paths.filter(~path.rlike("^[./]"))
        .select("repo", "path", F.explode(F.array_compact(F.array(*options))).alias("o"))
        .groupBy("repo", F.col("o.stem").alias("stem"))
        .agg(F.min(F.struct(F.col("o.rank"), F.col("path"))).alias("best"))
        .select("repo", "stem", F.col("best.path").alias("target_file"))
    )


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Keep imports that resolve to a file of the same repository."""
    keyed = imports.withColumn("stem", import_stem(F.col("import_path"), F.col("language")))
    return keyed.join(resolvable_stems(paths), ["repo", "stem"]).select(
        "repo", F.col("path").alias("source_file"), "target_file",
        F.col("statement").alias("import_statement"), "pattern_no", "match_no",
    )


def dependency_edges(files: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Directed multigraph of files; duplicates and self-loops are kept.  ``files`` have content, or ``imports`` found before."""
    found = listed_imports(files) if "imports" in files.columns else extract_imports(files, extra)
    resolved = resolve_imports(found, files.select("repo", "path"))
    return resolved.withColumn("import_type", F.lit("static"))
