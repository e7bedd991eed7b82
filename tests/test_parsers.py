"""Parsers of a user's own, over several languages."""

import sys
import tracemalloc

from pyspark import cloudpickle
from pyspark.sql import functions as F

from sourceloom.operators import imports, parsers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
SCHEMA = "repo string, path string, content string, language string, file_type string, size_bytes bigint"


def uses(text):
    """Statements ``use a.b;`` of an invented language; a semicolon must follow."""
    for line in text.split("\n"):
        if line.startswith("use "):
            if not line.endswith(";"):
                raise SyntaxError("no end: " + line)
            yield line[4:-1], line


def python_words(text):
    return ((w[1:], w) for w in text.split() if w.startswith("@"))


def test_rows_of_parsers_stand_beside_those_of_rules(spark):
    rows = [("r", "a.zz", "use one;\nuse two.x;", "zz"), ("r", "b.zz", "use one;\nuse broken\nuse never;", "zz"), ("r", "c.zz", None, "zz"), ("r", "d.zz", "", "zz"),
            ("s", "a.py", "import os\n@wraps @cache", "python"), ("s", "b.js", "use no;", "javascript")]
    files = spark.createDataFrame([(r, p, c, lang, "source", 1) for r, p, c, lang in rows], SCHEMA).repartition(3)
    found = parsers.extract_with_parsers(files, {"zz": uses, "python": python_words})
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([
        ("r", "a.zz", "zz", "parser", "one", "use one;", None), ("r", "a.zz", "zz", "parser", "two.x", "use two.x;", None),
        ("r", "b.zz", "zz", "parser", "one", "use one;", None), ("r", "b.zz", "zz", "parser", None, None, "SyntaxError: no end: use broken"),
        ("s", "a.py", "python", "rule", "os", "import os", None), ("s", "a.py", "python", "parser", "wraps", "@wraps", None),
        ("s", "a.py", "python", "parser", "cache", "@cache", None)], key=repr)
    # what parsers find resolves like the rest
    assert parsers.parsed_imports(files, {}).count() == 0
    assert imports.extract_imports(files).count() == 1


def test_matches_stream_out_of_a_file(spark):
    """Many matches of one file are not gathered in the parser."""
    function = parsers.table_function(lambda text: ((str(k), "x" * 100) for k in range(int(text))))
    rows = function.func().eval("1000000")
    tracemalloc.start()
    assert sum(1 for _ in rows) == 1_000_000
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    files = spark.createDataFrame([("r", "a", "20000", "n", "source", 1), ("r", "b", "5", "n", "source", 1)], SCHEMA)
    counts = parsers.parsed_imports(files, {"n": lambda text: ((str(k), text) for k in range(int(text)))}).groupBy("path").agg(F.count("*").alias("n"))
    assert {r.path: r.n for r in counts.collect()} == {"a": 20_000, "b": 5}
