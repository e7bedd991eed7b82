import pytest
from pyspark.sql import functions as F

from conftest import one_file
from sourceloom.functions import text as T
from sourceloom.operators import checks, classify, diff, imports, rewrite
from sourceloom.sources import files as S


def test_tree_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"import os\r\nx = 1\rbad \xff byte\n")
    (tmp_path / "src" / "bin.py").write_bytes(b"#" * 9000 + b"\x00b")
    (tmp_path / "src" / "huge.py").write_bytes(b"# 12345\n" * 250_000)
    (tmp_path / "src" / "big.py").write_bytes(b"#" * 3000)
    (tmp_path / "src" / "node_modules").write_bytes(b"no suffix")
    (tmp_path / "node_modules" / "x" / "i.js").write_bytes(b"1")
    (tmp_path / ".env").write_bytes(b"A=1")
    (tmp_path / "prod.env").write_bytes(b"A=1")
    tree = S.read_tree(spark, str(tmp_path))
    assert {r.path: r.size_bytes for r in S.load_corpus(tree).collect()} == {
        "src/a.py": 28, "prod.env": 3, "src/big.py": 3000, "src/huge.py": 2_000_000}
    assert {r.path: r.reason for r in S.dropped_files(tree).collect()} == {
        "src/bin.py": "binary", "src/node_modules": "not code", "node_modules/x/i.js": "ignored directory"}
    assert "larger than the limit" in {r.reason for r in S.dropped_files(tree, max_kb=2).collect()}
    found = S.load_corpus(tree, max_kb=2)
    got = {r.path: r for r in found.collect()}
    assert set(got) == {"src/a.py", "prod.env"}
    assert got["src/a.py"].content == "import os\nx = 1\nbad \ufffd byte\n" and got["src/a.py"].size_bytes == 28
    assert got["prod.env"].file_type == "config" and got["prod.env"].language == "unknown"


@pytest.mark.parametrize("path, language, kind", [
    ("latest_news.py", "python", "test"), (".github/x.yml", "yaml", "config"), ("docs/a.py", "python", "documentation"),
    ("a/Dockerfile.py", "python", "build"), ("x.bin", "unknown", "asset"), ("x.SH", "bash", "build"),
    (".py", "unknown", "asset"), ("a.b/c", "unknown", "asset"), ("a.TSX", "typescript", "source"),
])
def test_classification(spark, path, language, kind):
    row = spark.range(1).select(
        classify.language_of(F.lit(path)).alias("l"), classify.file_type_of(F.lit(path)).alias("t")
    ).head()
    assert (row.l, row.t) == (language, kind)


@pytest.mark.parametrize("path, new", [("a.b/Makefile", "a.go"), ("x", "x.go"), ("a/b.test.js", "a/b.test.go"), ("a.", "a.go")])
def test_target_path(spark, path, new):
    assert spark.range(1).select(T.target_path(F.lit(path), F.lit(".go")).alias("p")).head().p == new


def test_strip_words_lines(spark):
    row = spark.range(1).select(
        T.strip(F.lit("\u00a0\x1c a b \u2003\n")).alias("s"), T.words(F.lit("été_1, x-y")).alias("w"),
        T.kept_lines(F.lit("a\r\nb\x0bc\n\nd")).alias("l"), T.near_empty(F.lit(" \t123456789 ")).alias("e"),
    ).head()
    assert row.s == "a b" and row.w == ["été_1", "x", "y"] and row.e is True
    assert row.l == "a\r\nb\x0bc\n\nd".splitlines(keepends=True)


def resolve(spark, paths, imported, language="javascript"):
    known = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    found = spark.createDataFrame(
        [("r", "s", language, imported, imported, 0, 1)],
        "repo string, path string, language string, import_path string, statement string, pattern_no int, match_no int",
    )
    rows = imports.resolve_imports(found, known).collect()
    return rows[0].target_file if rows else None


def test_resolution_order_and_quirks(spark):
    assert resolve(spark, ["a.js", "a.py", "a/index.js"], "./a") == "a.py"
    assert resolve(spark, ["a/index.ts", "a/__init__.py"], "../../a") == "a/index.ts"
    assert resolve(spark, ["a/b.py"], "a.b", "python") == "a/b.py"
    assert resolve(spark, ["a/b.py"], "a.b") is None
    assert resolve(spark, ["lib/x.js", "lib/x"], "/lib/x") == "lib/x.js"
    assert resolve(spark, ["x.json"], "x.json") == "x.json"
    assert resolve(spark, ["App/Models.php"], "App\\Models", "php") == "App/Models.php"
    assert resolve(spark, ["index.js", "__init__.py"], "./") == "index.js"
    assert resolve(spark, [".hidden/a.js"], ".hidden/a") is None


def test_import_patterns_per_language(spark):
    code = {
        "ruby": "require 'a'\nrequire_relative 'b'\n", "php": "use App\\X;\nrequire_once 'c.php';\n", "rust": "use std::fs;\nmod m;\n",
        "csharp": "using System.IO;\n", "java": "import a.B;\n", "go": 'import "fmt"\n',
    }
    expected = {
        "ruby": ["a", "b"], "php": ["App\\X", "c.php"], "rust": ["m", "std::fs"], "csharp": ["System.IO"], "java": ["a.B"], "go": ["fmt"],
    }
    for language, text in code.items():
        found = imports.extract_imports(one_file(spark, text, language)).collect()
        assert sorted(r.import_path for r in found) == expected[language]


def test_diff_pair(spark):
    pair = spark.createDataFrame(
        [("r", "tax.py", "tax.ts", "RATE = 19\ndef vat(n):\n    return n * RATE\n", "function vat(n: number): number {\n    return n * 19;\n}\n", "typescript")],
        "repo string, original_path string, new_path string, original_content string, migrated_content string, target_language string",
    )
    row = diff.line_diff_stats(pair).head()
    assert (row.lines_added, row.lines_removed, row.lines_unchanged, row.change_ratio) == (3, 3, 0, 1.0)
    assert row.original_language == "py" and diff.semantic_changes(pair).count() == 0


def test_diff_identities(spark):
    cases = [("", ""), ("a", ""), ("", "a\n"), ("a\na\nb", "a\nb\nb"), ("x\ny\n", "y\nx\n"), ("a", "a\n")]
    pairs = spark.createDataFrame(
        [("r", str(i), "n", a, b, "t") for i, (a, b) in enumerate(cases)],
        "repo string, original_path string, new_path string, original_content string, migrated_content string, target_language string",
    )
    got = {r.path: (r.lines_added, r.lines_removed, r.lines_unchanged) for r in diff.line_diff_stats(pairs).collect()}
    assert got == {"0": (0, 0, 0), "1": (0, 1, 0), "2": (1, 0, 0), "3": (1, 1, 2), "4": (0, 0, 2), "5": (1, 1, 0)}


def test_unresolved_refs_match_brute_force(spark, ws, many_pieces):
    paths = [f"src/m{i}/f{i}.test.ts" for i in range(40)] + ["lib/.hidden/x.ts", "src/ünï.ts", "src/a.ts.ts"]
    refs = [".test", ".hidden/x", "./gone", "src/m1", "src/m1/f1.test.ts", "src/m1/f2", "src/", ".ts.", "src/ünï", "src/zz", ".", "lib/none"]
    text = "".join(f"require('/{r}')\n" if not r.startswith(".") else f"require('./{r}')\n" for r in refs)
    rows = [("r", p, p, "", text if i == 0 else "", "t") for i, p in enumerate(paths)]
    migrated = spark.createDataFrame(
        rows, "repo string, original_path string, new_path string, original_content string, migrated_content string, target_language string"
    )
    seen = {r.ref for r in checks.migrated_refs(migrated).collect()}
    expected = {r for r in seen if (r.startswith(".") or r.startswith("src/")) and not any(r in p for p in paths)}
    assert expected and {r.ref for r in checks.unresolved_refs(ws, migrated).collect()} == expected


def test_naming(spark):
    def violates(path, target):
        return spark.range(1).select(checks.name_violation(F.lit(path), target).alias("v")).head().v

    assert not violates("a/b-c.ts", "typescript") and violates("a/b-c.go", "go")
    assert violates("a/b c.ts", "typescript") and not violates("a b/c.ts", "typescript") and not violates("a b", "cobol")


def test_stages(spark):
    df = spark.range(5)
    out = rewrite.staged(df, [("even", lambda d: d.filter("id % 2 = 0")), ("count", lambda d: d.groupBy().count())])
    assert out.head()[0] == 3
