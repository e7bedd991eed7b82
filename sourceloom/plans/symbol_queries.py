"""Queries over symbol tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.operators import members, symbols
from sourceloom.plans.common import EDGES, EXT, FILES, Inputs, query, rx, sql_case, sql_strip, sql_text
from sourceloom.plans.corpus_queries import EXPORTS

W = rules.WORD
TEXT_LINES = "SELECT repo, path, language, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT *, string_split(content, chr(10)) AS l FROM files WHERE language = 'python') f"


def _items(column: str) -> str:
    return f"unnest(list_transform(string_split({column}, ','), lambda v: {sql_strip('v')}))"



def _g(column: str, pattern: str, group: int) -> str:
    return f"regexp_extract({column}, {rx(pattern)}, {group})"


def _alias(default: str) -> str:
    pattern = sql_text(rf"[ \t]as[ \t]+([{W}]+)")
    return f"CASE WHEN regexp_extract(item, {pattern}, 1) <> '' THEN regexp_extract(item, {pattern}, 1) ELSE {default} END"


_MODULE, _NAME = (f"regexp_extract(item, {sql_text(p)})" for p in (rf"^[{W}.]+", rf"^[{W}*]+"))
PY_IMPORTS = f"""SELECT repo, path, {_MODULE} AS module, NULL AS name, {_alias(_MODULE)} AS alias, 'absolute' AS type, CAST(0 AS BIGINT) AS level, line
  FROM (SELECT repo, path, line, {_items(_g('text', symbols.PY_IMPORT_LINE, 1))} AS item FROM text_lines WHERE regexp_matches(text, {rx(symbols.PY_IMPORT_LINE)})) i
  UNION ALL SELECT repo, path, module, {_NAME}, {_alias(_NAME)}, CASE WHEN dots <> '' THEN 'relative' ELSE 'absolute' END, CAST(length(dots) AS BIGINT), line
  FROM (SELECT repo, path, line, {_g('text', symbols.PY_FROM_LINE, 1)} AS dots, {_g('text', symbols.PY_FROM_LINE, 2)} AS module,
    {_items(_g('text', symbols.PY_FROM_LINE, 3) + ' || ' + _g('text', symbols.PY_FROM_LINE, 4))} AS item
    FROM text_lines WHERE regexp_matches(text, {rx(symbols.PY_FROM_LINE)})) j WHERE item <> '' AND (dots <> '' OR module <> '')"""


@query("python_imports", f"WITH {FILES}, text_lines AS ({TEXT_LINES}) {PY_IMPORTS}")
def _(x: Inputs):
    return symbols.python_imports(x.files).withColumns(
        {c: F.col(c).cast("bigint") for c in ("level", "line")}
    )


def _statements(pattern: str, where: str) -> str:
    return f"SELECT repo, path, unnest(regexp_extract_all(content, {rx(pattern)}, 0)) AS st FROM files WHERE {where}"


def _js_statement(pattern: str, default: str, named: str, aliases: bool, where: str) -> str:
    renamed = "contains(item, ' as ')" if aliases else "false"
    return f"""SELECT repo, path, {_g('st', pattern, 3)} AS module, {_g('st', pattern, 1)} AS name, NULL AS alias, '{default}' AS type
      FROM ({_statements(pattern, where)}) s WHERE {_g('st', pattern, 1)} <> ''
    UNION ALL SELECT repo, path, module, CASE WHEN {renamed} THEN trim(split_part(item, ' as ', 1)) ELSE item END,
      CASE WHEN {renamed} THEN trim(split_part(item, ' as ', 2)) END, '{named}'
      FROM (SELECT repo, path, {_g('st', pattern, 3)} AS module, {_items(_g('st', pattern, 2))} AS item
        FROM ({_statements(pattern, where)}) s WHERE {_g('st', pattern, 2)} <> '') t"""


def _js_imports(where: str) -> str:
    return " UNION ALL ".join([
        _js_statement(symbols.JS_IMPORT, "default", "named", True, where),
        _js_statement(symbols.JS_REQUIRE, "cjs_default", "cjs_named", False, where),
        f"SELECT repo, path, unnest(regexp_extract_all(content, {rx(symbols.JS_DYNAMIC)}, 1)), NULL, NULL, 'dynamic' FROM files WHERE {where}",
    ])


JS_WHERE = "language IN ('javascript', 'typescript')"


@query("js_imports", f"WITH {FILES} {_js_imports(JS_WHERE)}")
def _(x: Inputs):
    return symbols.js_imports(x.files)


@query("ts_type_imports", f"""WITH {FILES} {_js_imports("language = 'typescript'")} UNION ALL SELECT repo, path, module, item, NULL, 'type_only' FROM
  (SELECT repo, path, {_g('st', symbols.TS_TYPE_IMPORT, 2)} AS module, {_items(_g('st', symbols.TS_TYPE_IMPORT, 1))} AS item
  FROM ({_statements(symbols.TS_TYPE_IMPORT, "language = 'typescript'")}) s) t""")
def _(x: Inputs):
    return symbols.ts_type_imports(x.files)


@query("java_imports", f"""WITH {FILES} SELECT repo, path, {_g('st', symbols.JAVA_IMPORT, 2)} AS module,
  CASE WHEN {_g('st', symbols.JAVA_IMPORT, 1)} <> '' THEN 'static' ELSE 'standard' END AS type FROM ({_statements(symbols.JAVA_IMPORT, "language = 'java'")}) s""")
def _(x: Inputs):
    return symbols.java_imports(x.files)


@query("exports", f"WITH {FILES} {EXPORTS}")
def _(x: Inputs):
    return symbols.exports(x.files)


# The check reads the constructs the corpus is made of: one class per file, where it has any.
_HEAD_LINE = sql_text(rf"^([ \t]*)(class|def|async def)[ \t]+([{W}]+)(?:\(([^()]*)\))?")
_CODE = "text_lines AS MATERIALIZED (" + TEXT_LINES + ")"
PY_CLASSES = f"""SELECT c.repo, c.path, 'python' AS language, c.name, c.bases, '' AS decorators, c.line,
    coalesce(string_agg(CASE WHEN m.is_async THEN 'async ' ELSE '' END || m.name, ',' ORDER BY m.line), '') AS methods
  FROM (SELECT *, lead(line, 1, 1000000) OVER (PARTITION BY path ORDER BY line) AS ends FROM
      (SELECT repo, path, line, regexp_extract(text, {_HEAD_LINE}, 3) AS name, regexp_extract(text, {_HEAD_LINE}, 4) AS bases
       FROM text_lines WHERE regexp_matches(text, {sql_text(rf'^class[ \t]+[{W}]')})) h) c
  LEFT JOIN (SELECT path, line, regexp_extract(text, {sql_text(rf'def[ \t]+([{W}]+)')}, 1) AS name, contains(text, 'async') AS is_async
    FROM text_lines WHERE regexp_matches(text, {sql_text(rf'^[ \t]+(async[ \t]+)?def[ \t]+[{W}]')})) m
    ON m.path = c.path AND m.line > c.line AND m.line < c.ends
  GROUP BY ALL"""


def _brace_classes(language: str, head: str, bases: str, method: str) -> str:
    return f"""SELECT repo, path, language, {_g('st', head, 1)} AS name, {bases} AS bases, '' AS decorators, NULL AS line, {method} AS methods
  FROM (SELECT repo, path, language, unnest(regexp_extract_all(content, {rx(head)}, 0)) AS st, content FROM files WHERE language IN {language}) s"""


_JAVA_BASES = f"""concat_ws(',', nullif({_g('st', symbols.JAVA_CLASS, 2)}, ''), nullif(regexp_replace({sql_strip(_g('st', symbols.JAVA_CLASS, 3))}, ' *, *', ',', 'g'), ''))"""
CLASSES = " UNION ALL ".join([
    PY_CLASSES,
    _brace_classes("('javascript', 'typescript')", symbols.JS_CLASS, _g("st", symbols.JS_CLASS, 2), "'async go'"),
    _brace_classes("('java')", symbols.JAVA_CLASS, _JAVA_BASES, f"array_to_string(regexp_extract_all(content, {rx(symbols.JAVA_METHOD)}, 2), ',')"),
])


@query("classes", f"WITH {FILES}, {_CODE} {CLASSES}")
def _(x: Inputs):
    named = lambda m: F.concat(F.when(m["is_async"], "async ").otherwise(""), m["name"])
    return symbols.classes(x.files).select(
        "repo", "path", "language", "name", F.array_join("bases", ",").alias("bases"),
        F.array_join("decorators", ",").alias("decorators"), F.col("line").cast("bigint").alias("line"),
        F.array_join(F.transform("methods", named), ",").alias("methods"),
    )


_PY_DEF = rf"^(async[ \t]+)?def[ \t]+([{W}]+)[ \t]*\(([^()]*)\)(?:[ \t]*->([^:]+))?:"
_JAVA_PARAMS = f"list_transform(list_filter(string_split({_g('st', symbols.JAVA_FUNCTION, 3)}, ','), lambda v: {sql_strip('v')} <> ''), lambda v: {sql_strip('v')})"
FUNCTIONS = f"""
  SELECT repo, path, 'python' AS language, {_g('text', _PY_DEF, 2)} AS name,
    array_to_string(list_transform(string_split({_g('text', _PY_DEF, 3)}, ','), lambda v: {sql_strip('v')}), ',') AS params,
    nullif({sql_strip(_g('text', _PY_DEF, 4))}, '') AS return_type, {_g('text', _PY_DEF, 1)} <> '' AS is_async, line
  FROM text_lines WHERE regexp_matches(text, {rx(_PY_DEF)})
  UNION ALL SELECT repo, path, language, {_g('st', symbols.JS_FUNCTION, 1)},
    array_to_string(list_transform(list_filter(string_split({_g('st', symbols.JS_FUNCTION, 2)}, ','), lambda v: {sql_strip('v')} <> ''),
      lambda v: {sql_strip("regexp_extract(v, '^[^:=]*')")}), ','), NULL, contains(st, 'async'), NULL
  FROM (SELECT repo, path, language, unnest(regexp_extract_all(content, {rx(symbols.JS_FUNCTION)}, 0)) AS st FROM files WHERE {JS_WHERE}) s
  UNION ALL SELECT repo, path, language, {_g('st', symbols.JS_ARROW, 1)}, '', NULL, contains(st, 'async'), NULL
  FROM (SELECT repo, path, language, unnest(regexp_extract_all(content, {rx(symbols.JS_ARROW)}, 0)) AS st FROM files WHERE {JS_WHERE}) s
  UNION ALL SELECT repo, path, language, {_g('st', symbols.JAVA_FUNCTION, 2)},
    array_to_string(list_transform({_JAVA_PARAMS}, lambda v: regexp_extract(v, '[^ ]+$')), ','), {_g('st', symbols.JAVA_FUNCTION, 1)}, false, NULL
  FROM (SELECT repo, path, language, unnest(regexp_extract_all(content, {rx(symbols.JAVA_FUNCTION)}, 0)) AS st FROM files WHERE language = 'java') s"""


@query("functions", f"WITH {FILES}, {_CODE} {FUNCTIONS}")
def _(x: Inputs):
    return symbols.functions(x.files).select(
        "repo", "path", "language", "name", F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"),
        "return_type", "is_async", F.col("line").cast("bigint").alias("line"),
    )


# Heads stand on lines of their own in the corpus; a member belongs to the last class above it in its file.
_PY_MEMBER = rf"^[ \t]+(async[ \t]+)?def[ \t]+([{W}]+)\(([^()]*)\):"
_JS_MEMBER = rf"^  (async )?([{W}]+)\(([^()]*)\) \{{"
_JAVA_MEMBER = rf"^  public ([{W}]+) ([{W}]+)\(([^()]*)\) \{{"
_ALL_LINES = TEXT_LINES.replace(" WHERE language = 'python'", " WHERE language IN ('python', 'javascript', 'typescript', 'java')")


def _member_rows(languages: str, head: str, member: str, returned: str, awaited: str, params: str) -> str:
    return f"""SELECT m.repo, m.path, m.language, c.name AS class_name, c.line AS class_line, {_g('m.text', member, 2)} AS name, {params} AS params,
    {returned} AS return_type, {awaited} AS is_async, '' AS decorators, m.line
  FROM lines m JOIN (SELECT *, lead(line, 1, 1000000) OVER (PARTITION BY path ORDER BY line) AS ends FROM
    (SELECT path, line, {_g('text', head, 1)} AS name FROM lines WHERE language IN {languages} AND regexp_matches(text, {rx(head)})) h) c
    ON c.path = m.path AND m.line > c.line AND m.line < c.ends
  WHERE m.language IN {languages} AND regexp_matches(m.text, {rx(member)})"""


def _named(pattern: str, shown: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({_g('m.text', pattern, 3)}, ','), lambda v: {sql_strip('v')} <> ''), lambda v: {shown}), ',')"


CLASS_MEMBERS = " UNION ALL ".join([
    _member_rows("('python')", rf"^class[ \t]+([{W}]+)", _PY_MEMBER, "NULL", f"{_g('m.text', _PY_MEMBER, 1)} <> ''", _named(_PY_MEMBER, sql_strip("v") + " || ' '")),
    _member_rows("('javascript', 'typescript')", rf"^class ([{W}]+)", _JS_MEMBER, "NULL", f"{_g('m.text', _JS_MEMBER, 1)} <> ''", _named(_JS_MEMBER, sql_strip("v") + " || ' '")),
    _member_rows("('java')", rf"^public class ([{W}]+)", _JAVA_MEMBER, _g("m.text", _JAVA_MEMBER, 1), "false", _named(
        _JAVA_MEMBER, f"split_part({sql_strip('v')}, ' ', 2) || ' ' || split_part({sql_strip('v')}, ' ', 1)")),
])


@query("class_members", f"WITH {FILES}, lines AS MATERIALIZED ({_ALL_LINES}) {CLASS_MEMBERS}")
def _(x: Inputs):
    shown = F.transform("params", lambda p: F.concat(p["name"], F.lit(" "), F.coalesce(p["type"], F.lit(""))))
    return members.class_members(x.ws, x.files).withColumns({
        "params": F.array_join(shown, ","), "decorators": F.array_join("decorators", ",")})


def _mapping(language: str, target: str) -> str:
    return sql_case("source_type", rules.TYPE_MAPPINGS[language][target])


@query("type_mapping", f"""WITH {FILES} SELECT repo, path, function, place, source_type, {_mapping('java', 'typescript')} AS target_type FROM (
  SELECT repo, path, {_g('st', symbols.JAVA_FUNCTION, 2)} AS function, 'return' AS place, {_g('st', symbols.JAVA_FUNCTION, 1)} AS source_type
  FROM ({_statements(symbols.JAVA_FUNCTION, "language = 'java'")}) s
  UNION ALL SELECT repo, path, {_g('st', symbols.JAVA_FUNCTION, 2)}, 'param', unnest(list_transform({_JAVA_PARAMS}, lambda v: regexp_extract(v, '^(.*?) *[^ ]+$', 1)))
  FROM ({_statements(symbols.JAVA_FUNCTION, "language = 'java'")}) s) t""")
def _(x: Inputs):
    return symbols.type_mapping(symbols.functions(x.files), "typescript").drop("language")


PATHS_CASE = " UNION ALL ".join(
    f"SELECT '{lang}' AS language, {sql_text(label)} AS source, unnest([{', '.join(sql_text(t) for t in targets)}]) AS target"
    for label, (languages, targets) in rules.MIGRATION_PATHS.items() for lang in languages
)


@query("migration_paths", f"""WITH {FILES} SELECT f.repo, f.language, p.source, p.target, f.files FROM
  (SELECT repo, language, count(*) AS files FROM files GROUP BY ALL) f JOIN ({PATHS_CASE}) p ON p.language = f.language""")
def _(x: Inputs):
    return symbols.migration_paths(x.files)


_BY_KEY = {**{k: k for k in rules.ADAPTER_EXTENSIONS}, **{e: k for k, es in rules.ADAPTER_EXTENSIONS.items() for e in es}}
ADAPTER = f"coalesce({sql_case('language', _BY_KEY)}, {sql_case(EXT, _BY_KEY)})"


@query("supported_languages", f"WITH {FILES} SELECT adapter, count(*) AS files FROM (SELECT {ADAPTER} AS adapter FROM files) a WHERE adapter IS NOT NULL GROUP BY adapter")
def _(x: Inputs):
    return symbols.supported_languages(x.files)


@query("adapter_lookup", f"WITH {FILES} SELECT repo, path, language, {ADAPTER} AS adapter FROM files")
def _(x: Inputs):
    return symbols.adapter_lookup(x.files)


SUFFIXES = ", ".join(f"({i}, {sql_text(s)})" for i, s in enumerate(rules.RESOLUTION_SUFFIXES))


@query("symbol_mismatch", f"""WITH {EDGES}, text_lines AS ({TEXT_LINES}), exports AS ({EXPORTS}),
  named AS (SELECT repo, path, replace(module, '.', '/') AS module, name FROM ({PY_IMPORTS}) p WHERE name IS NOT NULL AND name <> '*'
    UNION ALL SELECT repo, path, module, name FROM ({_js_imports(JS_WHERE)}) j WHERE type IN ('named', 'cjs_named')),
  resolved AS (SELECT n.repo, n.path AS source_file, n.module, n.name, arg_min(f.path, s.rank) AS target_file FROM named n
    CROSS JOIN (VALUES {SUFFIXES}) s(rank, suffix) JOIN files f ON f.path = replace(ltrim(n.module || s.suffix, './'), '\\', '/') GROUP BY ALL)
  SELECT DISTINCT repo, source_file, target_file, name FROM resolved r
  WHERE EXISTS (SELECT 1 FROM edges e WHERE e.source_file = r.source_file AND e.target_file = r.target_file)
    AND NOT EXISTS (SELECT 1 FROM exports x WHERE x.path = r.target_file AND x.name = r.name)""")
def _(x: Inputs):
    return symbols.symbol_mismatch(x.files, x.edges)
