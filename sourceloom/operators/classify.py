"""Language, file type and entry-point predicates of one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T


def language_of(path: Column) -> Column:
    return F.coalesce(T.lookup(T.extension(path), rules.LANGUAGE_BY_EXTENSION), F.lit("unknown"))


def file_type_of(path: Column) -> Column:
    """First matching class wins: test, documentation, config, asset, build, source."""
    lowered, ext = F.lower(path), T.extension(path)

    def mentions(markers: list[str]) -> Column:
        return T.any_of([F.contains(lowered, F.lit(m)) for m in markers])

    return (
        F.when(mentions(rules.TEST_MARKERS), "test")
        .when(ext.isin(rules.DOCUMENT_EXTENSIONS) | mentions(["docs/"]), "documentation")
        .when(ext.isin(rules.CONFIG_EXTENSIONS), "config")
        .when(language_of(path) == "unknown", "asset")
        .when(ext.isin(rules.SCRIPT_EXTENSIONS) | mentions(rules.BUILD_MARKERS), "build")
        .otherwise("source")
    )


def detect_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def keep_code(files: DataFrame) -> DataFrame:
    """Drop files of unknown language unless their suffix marks a kept configuration file."""
    return files.filter(is_code(F.col("path")))


def is_code(path: Column) -> Column:
    return (language_of(path) != "unknown") | T.extension(path).isin(rules.KEPT_UNKNOWN_EXTENSIONS)


def classify_file_type(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", file_type_of(F.col("path")))


def skip_tests(files: DataFrame, preserve_tests: bool = True) -> DataFrame:
    return files if preserve_tests else files.filter(F.col("file_type") != "test")


def is_entry_point(path: Column, content: Column) -> Column:
    named = [F.endswith(path, F.lit(n)) for n in rules.ENTRY_FILE_NAMES]
    marked = [F.contains(content, F.lit(m)) for m in rules.ENTRY_MARKERS]
    return T.any_of(named + marked)


def entry_points(files: DataFrame) -> DataFrame:
    return files.filter(is_entry_point(F.col("path"), F.col("content"))).select("repo", "path")


def modules(files: DataFrame) -> DataFrame:
    return files.withColumn("module", T.module_of(F.col("path")))
