"""Reading source files: a directory tree, or a table that already holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import classify


def read_tree(spark: SparkSession, root: str, repo: str = "corpus") -> DataFrame:
    """Every file below ``root`` with its bytes; size and path filters reach the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if ":" in root else "file:" + root
    return scan_files(found, base).withColumn("repo", F.lit(repo))


def scan_files(found: DataFrame, root: str) -> DataFrame:
    """Relative path and byte size of rows shaped like the binary-file source."""
    start = len(root.rstrip("/")) + 2
    return found.withColumn("path", F.substring("path", start, 1 << 30)).withColumnRenamed("length", "size_bytes")


def prune_dirs(files: DataFrame, ignored: list[str] = rules.IGNORED_DIRECTORIES) -> DataFrame:
    """Drop files below an ignored directory at any depth; the file's own name is not tested."""
    return files.filter(~_below(ignored))


def _below(ignored: list[str]) -> Column:
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, T.literal_array(ignored))


def size_filter(files: DataFrame, max_kb: int) -> DataFrame:
    return files.filter(F.col("size_bytes") <= max_kb * 1024)


def binary_filter(files: DataFrame) -> DataFrame:
    """Drop files with a NUL anywhere."""
    return files.filter(~_has_nul())


def _has_nul() -> Column:
    return F.contains(F.col("content").cast("binary"), F.lit(bytearray(b"\x00")))


def decode_text(files: DataFrame) -> DataFrame:
    """UTF-8 with replacement characters; every line end becomes ``\\n``."""
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    # most texts have no carriage return, and a look for one byte costs less than a pattern
    return files.withColumn("content", F.when(F.contains(valid, F.lit("\r")), F.regexp_replace(valid, "\r\n?", "\n")).otherwise(valid))


def load_corpus(files: DataFrame, max_kb: int | None = None, preserve_tests: bool = True) -> DataFrame:
    """Raw files to the ``files`` relation; filters on path and size come before content.

    Files of any size are kept unless the caller names a limit; ``dropped_files`` tells what goes.
    """
    pruned = files.transform(prune_dirs)
    return (
        (pruned if max_kb is None else pruned.transform(size_filter, max_kb))
        .transform(classify.keep_code)
        .transform(classify.detect_language)
        .transform(classify.classify_file_type)
        .transform(classify.skip_tests, preserve_tests)
        .transform(binary_filter)
        .transform(decode_text)
        .select("repo", "path", "content", "language", "file_type", "size_bytes")
    )


def dropped_files(files: DataFrame, max_kb: int | None = None, preserve_tests: bool = True) -> DataFrame:
    """What ``load_corpus`` leaves out, with the first reason that applies."""
    reason = F.when(_below(rules.IGNORED_DIRECTORIES), "ignored directory")
    if max_kb is not None:
        reason = reason.when(F.col("size_bytes") > max_kb * 1024, "larger than the limit")
    reason = reason.when(~classify.is_code(F.col("path")), "not code")
    if not preserve_tests:
        reason = reason.when(classify.file_type_of(F.col("path")) == "test", "test")
    told = files.withColumn("reason", reason.when(_has_nul(), "binary"))
    return told.filter("reason IS NOT NULL").select("repo", "path", "size_bytes", "reason")
