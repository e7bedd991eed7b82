"""Parsers of a user's own next to the rules: an Arrow table function, joined laterally to the files of its language."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.operators import imports

PARSED = "import_path string, statement string, parse_error string"


def table_function(parse: Callable[[str], Iterable[tuple[str, str]]]):
    """``parse`` (text to pairs of import path and statement) as a table function; rows stream out as they are found.

    A text that it cannot parse gives what was found before, and a row with the error.
    """
    class Parser:
        def eval(self, text: str):
            if text is None:
                return
            try:
                for path, statement in parse(text):
                    yield path, statement, None
            except Exception as error:  # whatever a user's parser raises concerns one file
                yield None, None, f"{type(error).__name__}: {error}"

    return F.udtf(Parser, returnType=PARSED, useArrow=True)


def parsed_imports(files: DataFrame, parsers: dict[str, Callable[[str], Iterable[tuple[str, str]]]]) -> DataFrame:
    """Rows of the users' parsers, one per match and error: repo, path, language, import_path, statement, parse_error."""
    parts = []
    for language, parse in sorted(parsers.items()):
        own = files.where(F.col("language") == language).select("repo", "path", "language", "content")
        found = table_function(parse)(F.col("content").outer())
        parts.append(own.lateralJoin(found).select("repo", "path", "language", "import_path", "statement", "parse_error"))
    return reduce(DataFrame.unionAll, parts) if parts else files.limit(0).select(
        "repo", "path", "language", *[F.lit(None).cast("string").alias(c) for c in ("import_path", "statement", "parse_error")])


def extract_with_parsers(files: DataFrame, parsers: dict[str, Callable[[str], Iterable[tuple[str, str]]]],
                         extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Imports by rule and by parser: repo, path, language, source (rule or parser), import_path, statement, parse_error.

    A parser adds to the rules of its language.  Texts stay where they are read; a file is in a worker as one row of an Arrow batch.
    """
    by_rule = imports.extract_imports(files, extra).select(
        "repo", "path", "language", F.lit("rule").alias("source"), "import_path", "statement", F.lit(None).cast("string").alias("parse_error"))
    by_parser = parsed_imports(files, parsers).select(
        "repo", "path", "language", F.lit("parser").alias("source"), "import_path", "statement", "parse_error")
    return by_rule.unionAll(by_parser)
