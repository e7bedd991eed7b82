from conftest import one_file

from sourceloom.operators import symbols

PYTHON_IMPORTS = """
import decimal
import csv
from fractions import Fraction, gcd
from ledger.book.rows import Entry
from ...shared import rounding
"""


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_python_imports(spark):
    found = symbols.python_imports(one_file(spark, PYTHON_IMPORTS, "python"))
    assert rows(found, "line", "module", "name", "type", "level") == [
        (2, "decimal", None, "absolute", 0), (3, "csv", None, "absolute", 0),
        (4, "fractions", "Fraction", "absolute", 0), (4, "fractions", "gcd", "absolute", 0),
        (5, "ledger.book.rows", "Entry", "absolute", 0), (6, "shared", "rounding", "relative", 3),
    ]


def test_python_imports_over_several_lines(spark):
    code = "from a.b import (\n    c as d,  # first\n    e,\n)\nimport x.y as z, w\nfrom . import q\nfrom m import \\\n    n\n"
    found = symbols.python_imports(one_file(spark, code, "python"))
    assert rows(found, "line", "module", "name", "alias", "level") == [
        (1, "a.b", "c", "d", 0), (1, "a.b", "e", "e", 0), (5, "w", None, "w", 0), (5, "x.y", None, "z", 0),
        (6, "", "q", "q", 1), (7, "m", "n", "n", 0),
    ]


def test_python_classes_and_nesting(spark):
    code = (
        "@decorated(1)\n@twice\nclass A(Base, m.Other):\n    def one(self):\n        def inner(): pass\n"
        "    class B:\n        async def two(self): pass\n    def three(self): pass\n\ndef free(): pass\n"
    )
    found = {r.name: r for r in symbols.classes(one_file(spark, code, "python")).collect()}
    assert [m.name for m in found["A"].methods] == ["one", "three"]
    assert found["A"].bases == ["Base", "m.Other"] and found["A"].decorators == ["decorated(1)", "twice"]
    assert [(m.name, m.is_async) for m in found["B"].methods] == [("two", True)]
    assert (found["A"].line, found["B"].line) == (3, 6)


def test_python_class_methods_in_order(spark):
    code = "class Scale:\n    unit = 'g'\n    def tare(self): self.zero = 0\n\n    async def settle(self, ms) -> float:\n        return ms / 2\n"
    found = symbols.classes(one_file(spark, code, "python")).collect()
    assert [(c.name, [(m.name, m.is_async) for m in c.methods]) for c in found] == [("Scale", [("tare", False), ("settle", True)])]


def test_python_functions(spark):
    code = (
        '\ndef weigh(parcel: Parcel, tare: float) -> float:\n    """Weight in grams."""\n    return 0.0\n'
        "\nasync def ship(stops: Dict[str, int] = {}, *rest) -> Route:\n    pass\n\ndef long(\n    a,\n    b: int,\n):\n    'short'\n"
    )
    found = symbols.functions(one_file(spark, code, "python")).orderBy("line").collect()
    assert [f.name for f in found] == ["weigh", "ship", "long"]
    assert found[0].docstring == "Weight in grams." and found[0].return_type == "float"
    assert found[1].is_async and found[1].docstring is None
    assert [(p.name, p.type) for p in found[1].params] == [("stops", "Dict[str, int]")]
    assert [(p.name, p.type) for p in found[2].params] == [("a", None), ("b", "int")]
    assert found[2].docstring == "short"


def test_js_imports(spark):
    es6 = "import Chart from 'plots';\nimport { axis, legend } from 'plots';\nimport palette from './colours';\n"
    assert rows(symbols.js_imports(one_file(spark, es6, "javascript")), "module", "name", "type") == [
        ("./colours", "palette", "default"), ("plots", "Chart", "default"),
        ("plots", "axis", "named"), ("plots", "legend", "named"),
    ]
    cjs = "const knex = require('knex');\nconst { raw } = require('knex');\nconst zlib = require('zlib');\n"
    assert rows(symbols.js_imports(one_file(spark, cjs, "javascript")), "name", "type") == [
        ("knex", "cjs_default"), ("raw", "cjs_named"), ("zlib", "cjs_default"),
    ]
    other = "const m = await import('./lazy');\nimport * as all from 'x';\nimport { a as b } from 'y';"
    assert rows(symbols.js_imports(one_file(spark, other, "javascript")), "module", "name", "alias", "type") == [
        ("./lazy", None, None, "dynamic"), ("y", "a", "b", "named"),
    ]


def test_ts_type_imports(spark):
    found = symbols.ts_type_imports(one_file(spark, "import type { A, B } from 'm';", "typescript"))
    assert ("m", "A", "type_only") in rows(found, "module", "name", "type")


def test_exports(spark):
    js = (
        "export const RATE = 19;\nexport function vat(net) { return net * RATE; }\n"
        "export default class Till {}\nmodule.exports = { open, close };\n"
    )
    assert rows(symbols.exports(one_file(spark, js, "javascript")), "name") == [
        ("RATE",), ("Till",), ("close",), ("open",), ("vat",),
    ]
    py = "__all__ = ['a', \"b\"]\ndef f(): pass\ndef _g(): pass\nclass C: pass\n    def inner(): pass\n"
    assert rows(symbols.exports(one_file(spark, py, "python")), "name", "type") == [
        ("C", "class"), ("a", "explicit_export"), ("b", "explicit_export"), ("f", "function"),
    ]


def test_brace_classes(spark):
    js = "class A extends B {\n  run(x) { if (x) { y(); } }\n  async stop() { }\n}\nfunction out() { }\nclass C { m() { } }\n"
    found = {r.name: r for r in symbols.classes(one_file(spark, js, "javascript")).collect()}
    assert [(m.name, m.is_async) for m in found["A"].methods] == [("run", False), ("if", False), ("stop", True)]
    assert found["A"].bases == ["B"] and [m.name for m in found["C"].methods] == ["m"]
    java = (
        "@One @Two\nclass K extends Base implements A, B {\n  @Three public int f(String s, int n) { return n; }\n}\n"
        "public interface L { }\n"
    )
    found = {r.name: r for r in symbols.classes(one_file(spark, java, "java")).collect()}
    assert found["K"].bases == ["Base", "A", "B"] and [m.name for m in found["K"].methods] == ["f"]
    assert found["K"].decorators == [] and sorted(found["L"].decorators) == ["One", "Three", "Two"]
    assert found["L"].methods == []


def test_type_mapping(spark):
    code = "def f(a: str, b: int) -> dict: pass\n"
    defined = symbols.functions(one_file(spark, code, "python"))
    assert rows(symbols.type_mapping(defined, "typescript"), "source_type", "target_type") == [
        ("dict", "Record"), ("int", "number"), ("str", "string"),
    ]
    assert {r.target_type for r in symbols.type_mapping(defined, "cobol").collect()} == {None}
