"""Symbol tables: detailed imports, exports, classes, functions and types per file.

Everything is a regular expression over the file text followed by array functions in the same
row; a file is bounded by the size filter, so no step needs a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T

S, W = rules.SPACE, rules.WORD
_JS = ["javascript", "typescript"]

# --- fixed values: symbol patterns -----------------------------------------------------------
JS_IMPORT = rf"import[{S}]+(?:([{W}]+)(?:[{S}]*,[{S}]*)?)?(?:\{{([^}}]+)\}})?[{S}]*from[{S}]+['\"]([^\"']+)['\"]"
JS_REQUIRE = rf"(?:const|let|var)[{S}]+(?:([{W}]+)|\{{([^}}]+)\}})[{S}]*=[{S}]*require\(['\"]([^\"']+)['\"]\)"
JS_DYNAMIC = rf"import\([{S}]*['\"]([^\"']+)['\"][{S}]*\)"
TS_TYPE_IMPORT = rf"import[{S}]+type[{S}]+\{{([^}}]+)\}}[{S}]+from[{S}]+['\"]([^\"']+)['\"]"
JAVA_IMPORT = rf"^import[{S}]+(static[{S}]+)?([{W}.]+(?:\.\*)?);"
JS_EXPORT_NAMED = rf"export[{S}]+(?:const|let|var|function|class|async[{S}]+function)[{S}]+([{W}]+)"
JS_EXPORT_DEFAULT = rf"export[{S}]+default[{S}]+(?:class|function)?[{S}]*([{W}]+)?"
JS_EXPORT_MODULE = rf"module\.exports[{S}]*=[{S}]*(?:\{{([^}}]+)\}}|([{W}]+))"
JAVA_EXPORT_CLASS = (
    rf"public[{S}]+(?:static[{S}]+)?(?:final[{S}]+)?(?:class|interface|enum|record)[{S}]+([{W}]+)"
)
JAVA_EXPORT_METHOD = rf"public[{S}]+(?:static[{S}]+)?[{W}<>\[\]]+[{S}]+([{W}]+)[{S}]*\("
PY_ALL = rf"^__all__[{S}]*=[{S}]*[\[(]([^\])]*)[\])]"
PY_TOP_DEF = rf"^(?:async[ \t]+)?def[ \t]+([{W}]+)"
PY_TOP_CLASS = rf"^class[ \t]+([{W}]+)"
QUOTED = r"['\"]([^'\"]+)['\"]"
_PY_NAME = rf"[{W}.]+(?:[ \t]+as[ \t]+[{W}]+)?"
PY_IMPORT_LINE = rf"^[ \t]*import[ \t]+({_PY_NAME}(?:[ \t]*,[ \t]*{_PY_NAME})*)[ \t]*;?[ \t]*(?:#.*)?\z"
PY_FROM_LINE = rf"^[ \t]*from[ \t]*(\.*)[ \t]*([{W}.]*)[ \t]+import[ \t]*(?:\(([^)]*)\)?|([{W}* \t,]+))"
JS_CLASS = rf"class[{S}]+([{W}]+)(?:[{S}]+extends[{S}]+([{W}]+))?[{S}]*\{{"
JS_METHOD = rf"(?:async[{S}]+)?([{W}]+)[{S}]*\([^)]*\)[{S}]*\{{"
JS_FUNCTION = rf"(?:export[{S}]+)?(?:async[{S}]+)?function[{S}]+([{W}]+)[{S}]*\(([^)]*)\)"
JS_ARROW = rf"(?:export[{S}]+)?(?:const|let|var)[{S}]+([{W}]+)[{S}]*=[{S}]*(?:async[{S}]+)?\([^)]*\)[{S}]*=>"
JAVA_CLASS = (
    rf"(?:@[{W}]+(?:\([^)]*\))?[{S}]+)*(?:public|private|protected)?[{S}]*(?:abstract|final)?[{S}]*"
    rf"(?:class|interface|record)[{S}]+([{W}]+)(?:<[^>]+>)?(?:[{S}]+extends[{S}]+([{W}.]+))?"
    rf"(?:[{S}]+implements[{S}]+([{W}.,{S}]+))?[{S}]*\{{"
)
JAVA_METHOD = (
    rf"(?:public|private|protected)[{S}]+(?:static[{S}]+)?(?:abstract[{S}]+)?(?:synchronized[{S}]+)?"
    rf"([{W}<>\[\]]+)[{S}]+([{W}]+)[{S}]*\(([^)]*)\)"
)
JAVA_FUNCTION = (
    rf"(?:public|private|protected)[{S}]+(?:static[{S}]+)?([{W}<>\[\]]+)[{S}]+([{W}]+)[{S}]*\(([^)]*)\)"
    rf"[{S}]*(?:throws[{S}]+[{W}.,{S}]+)?[{S}]*\{{"
)


def _in_language(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.filter(F.col("language").isin(languages))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, T.java(pattern), group)


def _items(text: Column) -> Column:
    """Comma-separated parts without surrounding spaces."""
    return F.transform(F.split(text, ","), lambda x: T.strip(x))


def _rows(files: DataFrame, entries: Column, *keep: str) -> DataFrame:
    """Explode an array of structs into columns next to the file key.

    A plain explode would infer a filter on the array and push it down, which copies the columns that
    the array's lambdas read into the lambdas, to be worked out anew for each element.
    """
    found = files.select("repo", "path", *keep, F.explode_outer(entries).alias("e")).filter("e IS NOT NULL")
    return found.select("repo", "path", *keep, "e.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# --- imports ------------------------------------------------------------------------------------
def _cut(files: DataFrame, head: str, name: str) -> DataFrame:
    """Add the text cut before each line that matches ``head``, and the numbers of these lines."""
    numbered = F.transform(T.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    starts = F.transform(F.filter(numbered, lambda x: x["text"].rlike(T.java(head))), lambda x: x["line"])
    return files.withColumns({f"{name}_pieces": F.split("content", T.java(rf"(?={head})")), f"{name}_starts": starts})


def _whole_statement(piece: Column) -> Column:
    """A piece's first line with what follows it while a bracket is open or a backslash continues it."""
    line = F.substring_index(piece, "\n", 1)
    open_bracket = F.contains(line, F.lit("(")) & ~F.contains(line, F.lit(")"))
    whole = F.regexp_extract(piece, r"^(?:[^\n(\\]*\\\n)*[^\n(]*(?:\([^)]*\)?)?", 0)
    continued = open_bracket | F.endswith(line, F.lit("\\"))
    return F.when(continued, F.regexp_replace(whole, r"(?:\\\n|#[^\n]*|\n)", " ")).otherwise(line)


def _statements(name: str) -> Column:
    """Structs (line, text) of the logical lines at which ``_cut`` has cut."""
    pieces, starts = F.col(f"{name}_pieces"), F.col(f"{name}_starts")
    own = F.slice(pieces, F.size(pieces) - F.size(starts) + 1, F.size(starts))
    paired = F.arrays_zip(starts.alias("line"), own.alias("piece"))
    return F.transform(paired, lambda x: F.struct(x["line"].alias("line"), _whole_statement(x["piece"]).alias("text")))


def python_imports(files: DataFrame) -> DataFrame:
    """One row per imported name: module, name, alias, type, level, line."""
    found = _rows(_cut(_in_language(files, ["python"]), r"^[ \t]*(?:import|from)[ \t.]", "_import"), _statements("_import"))
    plain_list = _group(F.col("text"), PY_IMPORT_LINE, 1)
    alias = rf"[ \t]as[ \t]+([{W}]+)"
    plain = found.filter(plain_list != "").select(
        "repo", "path", "line", F.explode(_items(plain_list)).alias("item")
    )
    module = F.regexp_extract("item", rf"^[{W}.]+", 0)
    renamed = F.regexp_extract("item", alias, 1)
    plain = plain.select(
        "repo", "path", module.alias("module"), _null().alias("name"),
        F.when(renamed != "", renamed).otherwise(module).alias("alias"),
        F.lit("absolute").alias("type"), F.lit(0).alias("level"), "line",
    )
    dots, base = _group(F.col("text"), PY_FROM_LINE, 1), _group(F.col("text"), PY_FROM_LINE, 2)
    listed = F.concat(_group(F.col("text"), PY_FROM_LINE, 3), _group(F.col("text"), PY_FROM_LINE, 4))
    chosen = found.filter((listed != "") & ((dots != "") | (base != ""))).select(
        "repo", "path", "line", dots.alias("dots"), base.alias("module"),
        F.explode(F.filter(_items(listed), lambda x: x != "")).alias("item"),
    )
    name = F.regexp_extract("item", rf"^[{W}*]+", 0)
    chosen = chosen.select(
        "repo", "path", "module", name.alias("name"),
        F.when(renamed != "", renamed).otherwise(name).alias("alias"),
        F.when(F.col("dots") != "", "relative").otherwise("absolute").alias("type"),
        F.length("dots").alias("level"), "line",
    )
    return plain.unionByName(chosen)


def _named(module: Column, items: Column, kind: str, aliases: bool) -> Column:
    def entry(x: Column) -> Column:
        renamed = F.contains(x, F.lit(" as ")) if aliases else F.lit(False)
        return F.struct(
            module.alias("module"),
            F.when(renamed, F.trim(F.split_part(x, F.lit(" as "), F.lit(1)))).otherwise(x).alias("name"),
            F.when(renamed, F.trim(F.split_part(x, F.lit(" as "), F.lit(2)))).alias("alias"),
            F.lit(kind).alias("type"),
        )

    return F.transform(items, entry)


def _statement_entries(statement: Column, pattern: str, default_kind: str, named_kind: str, aliases: bool) -> Column:
    default, named, module = (_group(statement, pattern, g) for g in (1, 2, 3))
    nothing = F.array().cast("array<struct<module:string,name:string,alias:string,type:string>>")
    single = F.array(
        F.struct(module.alias("module"), default.alias("name"), _null().alias("alias"), F.lit(default_kind).alias("type"))
    )
    return F.concat(
        F.when(default != "", single).otherwise(nothing),
        F.when(named != "", _named(module, _items(named), named_kind, aliases)).otherwise(nothing),
    )


def js_imports(files: DataFrame) -> DataFrame:
    """ES imports, CommonJS requires and dynamic imports of JavaScript and TypeScript."""
    content = F.col("content")
    entries = F.concat(
        F.flatten(F.transform(
            T.find_all(content, JS_IMPORT), lambda x: _statement_entries(x, JS_IMPORT, "default", "named", True)
        )),
        F.flatten(F.transform(
            T.find_all(content, JS_REQUIRE),
            lambda x: _statement_entries(x, JS_REQUIRE, "cjs_default", "cjs_named", False),
        )),
        F.transform(
            T.find_all(content, JS_DYNAMIC, 1),
            lambda m: F.struct(
                m.alias("module"), _null().alias("name"), _null().alias("alias"), F.lit("dynamic").alias("type")
            ),
        ),
    )
    return _rows(_in_language(files, _JS), entries)


def ts_type_imports(files: DataFrame) -> DataFrame:
    """``js_imports`` of TypeScript files and their type-only imports."""
    typescript = _in_language(files, ["typescript"])
    entries = F.flatten(F.transform(
        T.find_all(F.col("content"), TS_TYPE_IMPORT),
        lambda x: _named(_group(x, TS_TYPE_IMPORT, 2), _items(_group(x, TS_TYPE_IMPORT, 1)), "type_only", False),
    ))
    return js_imports(typescript).unionByName(_rows(typescript, entries))


def java_imports(files: DataFrame) -> DataFrame:
    entries = F.transform(
        T.find_all(F.col("content"), JAVA_IMPORT),
        lambda x: F.struct(
            _group(x, JAVA_IMPORT, 2).alias("module"),
            F.when(_group(x, JAVA_IMPORT, 1) != "", "static").otherwise("standard").alias("type"),
        ),
    )
    return _rows(_in_language(files, ["java"]), entries)


# --- exports ---------------------------------------------------------------------------------------
def _tag(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))


def export_entries(lang: Column, content: Column) -> Column:
    """All exported symbols of a text as an array of (name, type); null for other languages."""
    public = lambda names: F.filter(names, lambda n: ~F.startswith(n, F.lit("_")))
    python = F.concat(
        _tag(F.flatten(F.transform(T.find_all(content, PY_ALL, 1), lambda x: T.find_all(x, QUOTED, 1))), "explicit_export"),
        _tag(public(T.find_all(content, PY_TOP_DEF, 1)), "function"),
        _tag(public(T.find_all(content, PY_TOP_CLASS, 1)), "class"),
    )
    in_braces = F.flatten(F.transform(
        F.filter(T.find_all(content, JS_EXPORT_MODULE, 1), lambda x: x != ""),
        lambda x: F.transform(_items(x), lambda i: T.strip(F.split_part(i, F.lit(":"), F.lit(1)))),
    ))
    javascript = F.concat(
        _tag(T.find_all(content, JS_EXPORT_NAMED, 1), "named"),
        _tag(
            F.transform(T.find_all(content, JS_EXPORT_DEFAULT, 1), lambda n: F.when(n == "", "default").otherwise(n)),
            "default",
        ),
        _tag(in_braces, "cjs"),
        _tag(F.filter(T.find_all(content, JS_EXPORT_MODULE, 2), lambda x: x != ""), "cjs_default"),
    )
    java = F.concat(
        _tag(T.find_all(content, JAVA_EXPORT_CLASS, 1), "class"),
        _tag(T.find_all(content, JAVA_EXPORT_METHOD, 1), "method"),
    )
    return F.when(lang == "python", python).when(lang.isin(_JS), javascript).when(lang == "java", java)


def exports(files: DataFrame) -> DataFrame:
    """Exported symbols of Python, JavaScript, TypeScript and Java: name, type; ``files`` have content, or ``exports`` found before."""
    entries = F.col("exports") if "exports" in files.columns else export_entries(F.col("language"), F.col("content"))
    return _rows(_in_language(files, ["python", "java", *_JS]), entries)


# --- classes and functions ------------------------------------------------------------------------------
_HEAD = "struct<line:int,indent:int,kind:string,name:string,text:string,parent:string,parent_line:int,decorators:array<string>>"
_OPEN = "struct<line:int,indent:int,kind:string,name:string>"
_PY_STATE = f"struct<open:array<{_OPEN}>,waiting:array<string>,heads:array<{_HEAD}>>"


# what opens a block or waits for one: classes, functions and decorators
_MARKER = rf"^[ \t]*(?:class[ \t]+[{W}]+|(?:async[ \t]+)?def[ \t]+[{W}]+|@[{W}])"


def _python_heads() -> Column:
    """Class and function heads with the head that encloses each, in one pass over the heads.

    The state holds the open blocks by indentation and the decorators that wait for a head.
    """
    items = F.transform(
        _statements("_head"),
        lambda x: F.struct(
            x["line"].alias("line"),
            F.length(F.regexp_extract(x["text"], r"^[ \t]*", 0)).alias("indent"),
            F.when(x["text"].rlike(r"^[ \t]*@"), "decorator").when(x["text"].rlike(r"^[ \t]*class"), "class")
            .otherwise("def").alias("kind"),
            F.regexp_extract(x["text"], rf"(?:class|def)[ \t]+([{W}]+)", 1).alias("name"),
            x["text"].alias("text"),
        ),
    )

    def step(state: Column, x: Column) -> Column:
        outer = F.filter(state["open"], lambda o: o["indent"] < x["indent"])
        parent = F.try_element_at(outer, F.lit(-1))
        decorator = x["kind"] == "decorator"
        in_class = parent["kind"] == "class"
        head = F.struct(
            x["line"].alias("line"), x["indent"].alias("indent"), x["kind"].alias("kind"), x["name"].alias("name"),
            x["text"].alias("text"), F.when(in_class, parent["name"]).alias("parent"),
            F.when(in_class, parent["line"]).alias("parent_line"), state["waiting"].alias("decorators"),
        ).cast(_HEAD)
        opened = F.struct(
            x["line"].alias("line"), x["indent"].alias("indent"), x["kind"].alias("kind"), x["name"].alias("name")
        ).cast(_OPEN)
        return F.struct(
            F.when(decorator, state["open"]).otherwise(F.array_append(outer, opened)).alias("open"),
            F.when(decorator, F.array_append(state["waiting"], F.regexp_extract(x["text"], r"@(.*)", 1)))
            .otherwise(F.array().cast("array<string>")).alias("waiting"),
            F.when(decorator, state["heads"]).otherwise(F.array_append(state["heads"], head)).alias("heads"),
        ).cast(_PY_STATE)

    start = F.struct(F.array(), F.array(), F.array()).cast(_PY_STATE)
    return F.aggregate(items, start, step, lambda s: s["heads"])


_METHOD = "struct<name:string,is_async:boolean>"
_CLASS = f"struct<id:int,name:string,bases:array<string>,decorators:array<string>,methods:array<{_METHOD}>>"
_BRACE_STATE = f"struct<depth:int,open:array<struct<id:int,depth:int>>,seen:array<string>,classes:array<{_CLASS}>>"


def _brace_classes(content: Column, class_pattern: str, method_pattern: str, bases, method_name) -> Column:
    """Classes with the methods inside their braces, in one pass over heads, braces and annotations."""
    items = T.find_all(content, rf"{class_pattern}|{method_pattern}|@[{W}]+|[{{}}]")

    def step(state: Column, x: Column) -> Column:
        name = _group(x, rf"^(?:{class_pattern})", 1)
        is_class = name != ""
        method = F.when(is_class | x.isin("{", "}"), "").otherwise(method_name(x))
        change = F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))
        depth = state["depth"] + change
        still_open = F.filter(state["open"], lambda o: o["depth"] < depth)
        added = F.array(F.struct(
            F.size(state["classes"]).alias("id"), name.alias("name"), bases(x).alias("bases"),
            F.slice(F.reverse(state["seen"]), 1, 3).alias("decorators"),
            F.array().cast(f"array<{_METHOD}>").alias("methods"),
        ).cast(_CLASS))
        entry = F.struct(method.alias("name"), F.contains(x, F.lit("async")).alias("is_async")).cast(_METHOD)
        grown = F.transform(
            state["classes"],
            lambda c: F.struct(
                c["id"].alias("id"), c["name"].alias("name"), c["bases"].alias("bases"),
                c["decorators"].alias("decorators"),
                F.when(F.exists(state["open"], lambda o: o["id"] == c["id"]), F.array_append(c["methods"], entry))
                .otherwise(c["methods"]).alias("methods"),
            ).cast(_CLASS),
        )
        annotation = _group(x, rf"^@([{W}]+)\z", 1)
        return F.struct(
            depth.alias("depth"),
            F.when(is_class, F.array_append(
                state["open"],
                F.struct(F.size(state["classes"]).alias("id"), state["depth"].alias("depth")).cast("struct<id:int,depth:int>"),
            )).otherwise(still_open).alias("open"),
            F.when(annotation != "", F.array_append(state["seen"], annotation))
            .when(is_class, F.concat(state["seen"], T.find_all(x, rf"@([{W}]+)", 1)))
            .otherwise(state["seen"]).alias("seen"),
            F.when(is_class, F.concat(state["classes"], added)).when(method != "", grown)
            .otherwise(state["classes"]).alias("classes"),
        ).cast(_BRACE_STATE)

    start = F.struct(F.lit(0), F.array(), F.array(), F.array()).cast(_BRACE_STATE)
    return F.aggregate(items, start, step, lambda s: s["classes"])


def _java_bases(head: Column) -> Column:
    extended = _group(head, JAVA_CLASS, 2)
    implemented = _group(head, JAVA_CLASS, 3)
    nothing = F.array().cast("array<string>")
    return F.concat(
        F.when(extended != "", F.array(extended)).otherwise(nothing),
        F.when(implemented != "", _items(implemented)).otherwise(nothing),
    )


def _js_bases(head: Column) -> Column:
    base = _group(head, JS_CLASS, 2)
    return F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>"))


def classes(files: DataFrame) -> DataFrame:
    """Classes with bases, decorators or annotations, and methods: one row per class."""
    content = F.col("content")
    split = _cut(_in_language(files, ["python"]), _MARKER, "_head")
    python = split.select("repo", "path", "language", _python_heads().alias("heads"))
    listed = F.transform(
        F.filter("heads", lambda h: h["kind"] == "class"),
        lambda c: F.struct(
            c["name"].alias("name"),
            F.filter(_items(F.regexp_extract(c["text"], r"\(([^)]*)\)", 1)), lambda b: b != "").alias("bases"),
            c["decorators"].alias("decorators"),
            F.transform(
                F.filter("heads", lambda h: (h["kind"] == "def") & (h["parent_line"] == c["line"])),
                lambda m: F.struct(
                    m["name"].alias("name"), m["text"].rlike(r"^[ \t]*async").alias("is_async")
                ),
            ).alias("methods"),
            c["line"].alias("line"),
        ),
    )
    parts = [_rows(python, listed, "language")]
    found = [
        (_JS, _brace_classes(content, JS_CLASS, JS_METHOD, _js_bases, lambda x: _group(x, JS_METHOD, 1))),
        (["java"], _brace_classes(content, JAVA_CLASS, JAVA_METHOD, _java_bases, lambda x: _group(x, JAVA_METHOD, 2))),
    ]
    for languages, entries in found:
        rows = _rows(_in_language(files, languages), entries, "language")
        parts.append(rows.drop("id").withColumn("line", _null("int")))
    return _union(parts)


_PARAM = "array<struct<name:string,type:string>>"


def _python_params(head: Column) -> Column:
    listed = F.regexp_extract(head, r"\(((?:[^()]++|\([^()]*\))*+)\)", 1)
    # a comma inside brackets belongs to a type
    flat = F.regexp_replace(listed, r",(?=[^\[\]]*\])", "\x1f")
    plain = F.filter(_items(flat), lambda p: (p != "") & ~p.rlike(r"^[*/]"))
    return F.transform(
        plain,
        lambda p: F.struct(
            F.regexp_extract(p, rf"^[{W}]+", 0).alias("name"),
            F.nullif(F.replace(T.strip(F.regexp_extract(p, r"^[^:=]+:([^=]*)", 1)), F.lit("\x1f"), F.lit(",")), F.lit("")).alias("type"),
        ),
    ).cast(_PARAM)


def _java_params(listed: Column) -> Column:
    return F.transform(
        F.filter(_items(listed), lambda p: p != ""),
        lambda p: F.struct(
            F.regexp_extract(p, rf"([^{S}]+)\z", 1).alias("name"),
            F.regexp_replace(F.regexp_extract(p, rf"^(.*?)[{S}]*[^{S}]+\z", 1), T.SPACES + "+", " ").alias("type"),
        ),
    ).cast(_PARAM)


def _js_params(listed: Column) -> Column:
    return F.transform(
        F.filter(_items(listed), lambda p: p != ""),
        lambda p: F.struct(T.strip(F.regexp_extract(p, r"^[^:=]*", 0)).alias("name"), _null().alias("type")),
    ).cast(_PARAM)


def functions(files: DataFrame) -> DataFrame:
    """Top-level functions: name, params, return_type, is_async, decorators, line, docstring."""
    content = F.col("content")
    nothing = F.array().cast("array<string>")
    # the text is cut once before each top-level definition; a definition finds its piece by its line
    cut = _cut(_cut(_in_language(files, ["python"]), _MARKER, "_head"), r"^(?:async[ \t]+)?def[ \t]", "_def")

    def docstring(line: Column) -> Column:
        pieces, lines = F.col("_def_pieces"), F.col("_def_starts")
        at = F.array_position(lines, line).cast("int") - 1 + F.size(pieces) - F.size(lines)
        rest = F.get(pieces, at)
        body = r"(?s)^(?:async[ \t]+)?def[^(]*\((?:[^()]++|\([^()]*\))*+\)[^:]*:[ \t]*(?:#[^\n]*)?\n[ \t\n]*"
        triple = F.regexp_extract(rest, body + r"[rRuU]?(\"\"\"|''')(.*?)\1", 2)
        single = F.regexp_extract(rest, body + r"[rRuU]?([\"'])([^\"'\n]+)\1", 2)
        text = F.when(triple != "", triple).otherwise(single)
        return F.nullif(T.strip(text), F.lit(""))

    python = F.transform(
        F.filter(_python_heads(), lambda h: (h["kind"] == "def") & (h["indent"] == 0)),
        lambda h: F.struct(
            h["name"].alias("name"), _python_params(h["text"]).alias("params"),
            F.nullif(T.strip(F.regexp_extract(h["text"], r"\)[ \t]*->([^:]+):", 1)), F.lit("")).alias("return_type"),
            h["text"].rlike("^async").alias("is_async"), h["decorators"].alias("decorators"),
            h["line"].alias("line"), docstring(h["line"]).alias("docstring"),
        ),
    )

    def braces(pattern: str, name: int, params, returned: int | None) -> Column:
        return F.transform(
            T.find_all(content, pattern),
            lambda x: F.struct(
                _group(x, pattern, name).alias("name"), params(x).alias("params"),
                (_group(x, pattern, returned) if returned else _null()).alias("return_type"),
                (F.lit(False) if returned else F.contains(x, F.lit("async"))).alias("is_async"),
                nothing.alias("decorators"), _null("int").alias("line"), _null().alias("docstring"),
            ),
        )

    javascript = F.concat(
        braces(JS_FUNCTION, 1, lambda x: _js_params(_group(x, JS_FUNCTION, 2)), None),
        braces(JS_ARROW, 1, lambda x: F.array().cast(_PARAM), None),
    )
    java = braces(JAVA_FUNCTION, 2, lambda x: _java_params(_group(x, JAVA_FUNCTION, 3)), 1)
    return _union([
        _rows(cut, python, "language"),
        _rows(_in_language(files, _JS), javascript, "language"),
        _rows(_in_language(files, ["java"]), java, "language"),
    ])


# --- uses of the symbol tables ------------------------------------------------------------------------------
def type_mapping(defined: DataFrame, target: str) -> DataFrame:
    """Parameter and return types of functions with their counterpart in ``target``.

    A language without a mapping to ``target`` gives NULL for every type.
    """
    table = {
        f"{lang}:{old}": new
        for lang, targets in rules.TYPE_MAPPINGS.items() for old, new in targets.get(target, {}).items()
    }
    typed = F.concat(
        F.transform("params", lambda p: F.struct(F.lit("param").alias("place"), p["type"].alias("source_type"))),
        F.array(F.struct(F.lit("return").alias("place"), F.col("return_type").alias("source_type"))),
    )
    rows = _rows(defined.withColumnRenamed("name", "function"), typed, "language", "function").filter(
        "source_type IS NOT NULL"
    )
    key = F.concat_ws(":", "language", "source_type")
    mapped = T.lookup(key, table) if table else _null()
    return rows.withColumn("target_type", mapped)


def symbol_mismatch(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Names imported from a file of the repository that this file does not export."""
    from sourceloom.operators import imports as I

    named = (
        python_imports(files).filter("name IS NOT NULL AND name <> '*'")
        .select("repo", "path", F.lit("python").alias("language"), "module", "name")
        .unionAll(
            js_imports(files).filter("type IN ('named', 'cjs_named')")
            .select("repo", "path", F.lit("javascript").alias("language"), "module", "name")
        )
        .withColumn("stem", I.import_stem(F.col("module"), F.col("language")))
    )
    resolved = named.join(I.resolvable_stems(files.select("repo", "path")), ["repo", "stem"]).select(
        "repo", F.col("path").alias("source_file"), "target_file", "name"
    )
    offered = exports(files).select("repo", F.col("path").alias("target_file"), "name").distinct()
    linked = edges.select("repo", "source_file", "target_file").distinct()
    return (
        resolved.join(linked, ["repo", "source_file", "target_file"], "left_semi")
        .join(offered, ["repo", "target_file", "name"], "left_anti")
        .select("repo", "source_file", "target_file", "name").distinct()
    )


def adapter_lookup(files: DataFrame) -> DataFrame:
    """The adapter of each file, by its language or else by its extension; NULL without one."""
    by_key = {name: name for name in rules.ADAPTER_EXTENSIONS}
    for name, extensions in rules.ADAPTER_EXTENSIONS.items():
        by_key.update({e: name for e in extensions})
    adapter = F.coalesce(
        T.lookup(F.col("language"), by_key), T.lookup(T.extension(F.col("path")), by_key)
    )
    return files.select("repo", "path", "language", adapter.alias("adapter"))


def supported_languages(files: DataFrame) -> DataFrame:
    """Adapters the corpus makes use of, with their number of files."""
    return (
        adapter_lookup(files).filter("adapter IS NOT NULL").groupBy("adapter").agg(F.count("*").alias("files"))
    )


def migration_paths(files: DataFrame) -> DataFrame:
    """Supported source and target pairs for the languages of the corpus."""
    pairs = F.array(*[
        F.struct(F.lit(lang).alias("language"), F.lit(label).alias("source"), F.lit(t).alias("target"))
        for label, (languages, targets) in rules.MIGRATION_PATHS.items() for lang in languages for t in targets
    ])
    present = files.groupBy("repo", "language").agg(F.count("*").alias("files"))
    return (
        present.select("repo", "language", "files", F.explode(F.filter(pairs, lambda p: p["language"] == F.col("language"))).alias("p"))
        .select("repo", "language", F.col("p.source").alias("source"), F.col("p.target").alias("target"), "files")
    )
