"""Queries over files: ingest, scalars, imports, graph, checks, differences, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import (
    analysis, checks, classify, context, diff, graph, imports, line_diff, ordered, parsers, rewrite, symbols,
)
from sourceloom.plans.common import (
    COMPONENTS, DECODED, DISTINCT_KEYWORDS, EDGES, ENTRY, EXT, FILES, FILE_TYPE, IMPORTS, KEPT, LANGUAGE, LAYERS,
    MIGRATED_SELECT, PRUNED, RAW, REACH, TARGET, Inputs, edges_sql, imports_sql, migrated_sql, query, r6, rx,
    sql_any, sql_case, sql_in, sql_list, sql_strip, sql_text,
)
from sourceloom.session import scratch_path
from sourceloom.sources import files as S
from sourceloom.sources import tables

# --- scans ------------------------------------------------------------------------------------
ROOT = "file:/repos/corpus"


@query("scan_files", f"WITH {RAW} SELECT repo, path, size_bytes FROM raw")
def _(x: Inputs):
    found = x.raw.select(
        "repo", F.concat(F.lit(ROOT + "/"), "path").alias("path"), F.col("size_bytes").alias("length"),
        F.col("content").cast("binary").alias("content"),
    )
    return S.scan_files(found, ROOT).select("repo", "path", "size_bytes")


@query("prune_dirs", f"WITH {RAW} SELECT repo, path FROM raw WHERE {PRUNED}")
def _(x: Inputs):
    return S.prune_dirs(x.raw).select("repo", "path")


@query("size_filter", f"WITH {RAW} SELECT repo, path, size_bytes FROM raw WHERE size_bytes <= 4 * 1024")
def _(x: Inputs):
    return S.size_filter(x.raw, 4).select("repo", "path", "size_bytes")


@query("binary_filter", f"WITH {RAW} SELECT repo, path FROM raw WHERE CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT) % 5 <> 0")
def _(x: Inputs):
    # every fifth file gets a NUL byte behind its text
    marked = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint") % 5 == 0
    content = F.when(marked, F.concat(F.col("content").cast("binary"), F.lit(bytearray(b"\x00"))))
    return S.binary_filter(x.raw.withColumn("content", content.otherwise(F.col("content").cast("binary")))).select("repo", "path")


@query("decode_text", f"WITH {RAW} SELECT repo, path, md5({DECODED}) AS digest, CAST(length({DECODED}) AS BIGINT) AS n_chars FROM raw")
def _(x: Inputs):
    decoded = S.decode_text(x.raw.withColumn("content", F.col("content").cast("binary")))
    return decoded.select(
        "repo", "path", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("n_chars")
    )


@query("load_corpus", f"WITH {FILES} SELECT repo, path, language, file_type, size_bytes, md5(content) AS digest FROM files")
def _(x: Inputs):
    return x.files.select("repo", "path", "language", "file_type", "size_bytes", F.md5("content").alias("digest"))


@query("dropped_files", f"""WITH {RAW} SELECT repo, path, size_bytes, CASE WHEN NOT ({PRUNED}) THEN 'ignored directory' ELSE 'not code' END AS reason
  FROM raw WHERE NOT ({PRUNED}) OR NOT {KEPT}""")
def _(x: Inputs):
    return S.dropped_files(x.raw)


LAST_WRITERS = f"""{LAYERS}, migrated AS ({MIGRATED_SELECT}), kept AS (SELECT m.*, row_number() OVER (PARTITION BY m.repo, new_path
  ORDER BY layer DESC NULLS FIRST, original_path DESC) AS rn FROM migrated m JOIN layers l ON l.path = m.original_path)"""


@query("write_migrated", f"WITH RECURSIVE {LAST_WRITERS} SELECT repo, original_path, new_path, target_language, md5(migrated_content) AS digest FROM kept WHERE rn = 1")
def _(x: Inputs):
    path = scratch_path(x.spark, "migrated")
    winners = rewrite.last_writers(x.ws, x.migrated, x.layers)
    tables.write_migrated(winners.select("repo", "original_path", "new_path", "migrated_content", "target_language"), path)
    return x.spark.read.parquet(path).select(
        "repo", "original_path", "new_path", "target_language", F.md5("migrated_content").alias("digest")
    )


@query("migration_map", f"""WITH {migrated_sql()} SELECT original_path AS original, new_path AS migrated, confidence_score AS confidence,
  CAST(0 AS BIGINT) AS n_warnings FROM migrated""")
def _(x: Inputs):
    path = scratch_path(x.spark, "map")
    tables.write_map(rewrite.map_json(rewrite.migration_map(x.migrated)), path)
    read = x.spark.read.schema("original string, migrated string, confidence double, warnings array<string>").json(path)
    return read.select("original", "migrated", "confidence", F.size("warnings").cast("bigint").alias("n_warnings"))


LEDGER = """SELECT repo, path, CASE WHEN doc % 7 = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM (SELECT *, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT) AS doc FROM files) d WHERE doc % 3 <> 0"""


def _ledger(x: Inputs):
    doc = F.regexp_extract("path", "f([0-9]+)", 1).cast("bigint")
    return x.paths.filter(doc % 3 != 0).select(
        "repo", "path", F.when(doc % 7 == 0, "failed").otherwise("completed").alias("status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    )


@query("ledger_write", f"WITH {FILES} {LEDGER}")
def _(x: Inputs):
    path = scratch_path(x.spark, "ledger")
    tables.ledger_write(_ledger(x), path)
    return tables.ledger_read(x.spark, path).select("repo", "path", "status")


@query("ledger_read", f"""WITH {FILES}, ledger AS ({LEDGER}) SELECT f.repo, count_if(status = 'completed') AS completed,
  count_if(status = 'failed') AS failed, count(*) AS total FROM files f LEFT JOIN ledger l ON l.path = f.path GROUP BY f.repo""")
def _(x: Inputs):
    path = scratch_path(x.spark, "ledger")
    tables.ledger_write(_ledger(x), path)
    return tables.ledger_totals(tables.ledger_read(x.spark, path), x.paths)


# --- predicates and scalars -----------------------------------------------------------------------
@query("detect_language", f"WITH {RAW} SELECT repo, path, {LANGUAGE} AS language FROM raw")
def _(x: Inputs):
    return classify.detect_language(x.raw).select("repo", "path", "language")


@query("keep_code", f"WITH {RAW} SELECT repo, path FROM raw WHERE {KEPT}")
def _(x: Inputs):
    return classify.keep_code(x.raw).select("repo", "path")


@query("classify_file_type", f"WITH {RAW} SELECT repo, path, {FILE_TYPE} AS file_type FROM raw")
def _(x: Inputs):
    return classify.classify_file_type(x.raw).select("repo", "path", "file_type")


@query("skip_tests", f"WITH {FILES} SELECT repo, path, file_type FROM files WHERE file_type <> 'test'")
def _(x: Inputs):
    return classify.skip_tests(x.files, preserve_tests=False).select("repo", "path", "file_type")


@query("module_of", f"WITH {FILES} SELECT repo, path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS module FROM files")
def _(x: Inputs):
    return classify.modules(x.files).select("repo", "path", "module")


@query("entry_points", f"""WITH {FILES} SELECT repo, path FROM (SELECT repo, content || CASE WHEN size_bytes % 4 = 0 THEN 'func main()' ELSE '' END AS content,
  path || CASE WHEN size_bytes % 3 = 0 THEN '/main.py' ELSE '' END AS path FROM files) f WHERE {ENTRY}""")
def _(x: Inputs):
    # every third file becomes a main file, every fourth gets a main function
    size = F.col("size_bytes")
    return classify.entry_points(x.files.withColumns({
        "path": F.concat("path", F.when(size % 3 == 0, "/main.py").otherwise("")),
        "content": F.concat("content", F.when(size % 4 == 0, "func main()").otherwise("")),
    }))


@query("target_path", f"""WITH {RAW} SELECT repo, path, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '.rs')
  ELSE path || '.rs' END AS new_path FROM raw""")
def _(x: Inputs):
    return x.raw.select("repo", "path", T.target_path(F.col("path"), F.lit(".rs")).alias("new_path"))


TARGET_OF = {"python": "go", "javascript": "typescript", "go": "rust", "java": "python-fastapi"}


def _template_case(i: int) -> str:
    table = {k: v[i] for k, v in rules.TARGET_TEMPLATES.items()}
    return sql_case("target", table, sql_text(table[rules.DEFAULT_TARGET]))


@query("target_template", f"""WITH {FILES} SELECT repo, path, target, {_template_case(0)} AS file_extension, {_template_case(1)} AS import_style,
  {_template_case(2)} AS package_manager, {_template_case(3)} AS type_system
  FROM (SELECT *, {sql_case('language', TARGET_OF, "'kotlin'")} AS target FROM files) t""")
def _(x: Inputs):
    target = F.coalesce(T.lookup(F.col("language"), TARGET_OF), F.lit("kotlin"))
    return rewrite.target_template(x.files.withColumn("target", target)).select(
        "repo", "path", "target", *rewrite.TEMPLATE_FIELDS
    )


@query("render_migrated", f"""WITH {migrated_sql()} SELECT repo, original_path, new_path, md5(migrated_content) AS digest, target_language,
  confidence_score FROM migrated""")
def _(x: Inputs):
    return x.migrated.select(
        "repo", "original_path", "new_path", F.md5("migrated_content").alias("digest"), "target_language", "confidence_score"
    )


@query("preview", "SELECT doc_id, md5(left(text, 500)) AS head_500, md5(left(text, 2000)) AS head_2000, md5(left(text, 4000)) AS head_4000 FROM documents")
def _(x: Inputs):
    return x.table("documents").select(
        "doc_id", *[F.md5(T.preview(F.col("text"), n)).alias(f"head_{n}") for n in (500, 2000, 4000)]
    )


KEYWORDS = sql_list(rules.BRANCH_KEYWORDS_WITH_TRY)


@query("complexity_tokens", f"""WITH {FILES} SELECT repo, path, CAST(len(list_filter(regexp_extract_all(content, '[{rules.WORD}]+'),
  lambda w: list_contains({KEYWORDS}, w))) AS BIGINT) AS complexity FROM files""")
def _(x: Inputs):
    return x.files.select("repo", "path", T.complexity_tokens(F.col("content")).alias("complexity"))


@query("complexity_distinct", f"WITH {FILES} SELECT repo, path, CAST({DISTINCT_KEYWORDS} AS BIGINT) AS complexity FROM files")
def _(x: Inputs):
    return x.files.select("repo", "path", T.complexity_distinct(F.col("content")).alias("complexity"))


@query("lang_of_ext", f"WITH {RAW} SELECT repo, path, CASE WHEN contains(path, '.') THEN regexp_extract(path, '[^.]*$') ELSE 'unknown' END AS label FROM raw")
def _(x: Inputs):
    return x.raw.select("repo", "path", T.extension_label(F.col("path")).alias("label"))


@query("name_violation", f"""WITH {RAW} SELECT repo, path, regexp_matches(replace(regexp_extract(path, '[^/]*$'), '.', ''),
  {sql_text(rules.NAMING_FORBIDDEN['go'])}) AS violates FROM (SELECT repo, CASE WHEN size_bytes % 2 = 0 THEN
  replace(path, 'f', 'f-') ELSE path END AS path FROM raw) r""")
def _(x: Inputs):
    renamed = F.when(F.col("size_bytes") % 2 == 0, F.replace("path", F.lit("f"), F.lit("f-"))).otherwise(F.col("path"))
    return x.raw.select("repo", renamed.alias("path")).select(
        "repo", "path", checks.name_violation(F.col("path"), "go").alias("violates")
    )


@query("near_empty", f"SELECT doc_id, length({sql_strip('text')}) < {rules.MIN_TRANSLATED_CHARS} AS near_empty FROM documents")
def _(x: Inputs):
    return x.table("documents").select("doc_id", T.near_empty(F.col("text")).alias("near_empty"))


@query("untranslated", f"""WITH {FILES} SELECT repo, path, {sql_strip('content')} = {sql_strip('other')} AS untranslated FROM
  (SELECT *, CASE WHEN size_bytes % 3 = 0 THEN '  ' || content || chr(10) ELSE content || 'x' END AS other FROM files) f""")
def _(x: Inputs):
    padded = F.concat(F.lit("  "), "content", F.lit("\n"))
    other = F.when(F.col("size_bytes") % 3 == 0, padded).otherwise(F.concat("content", F.lit("x")))
    return x.files.select("repo", "path", T.untranslated(F.col("content"), other).alias("untranslated"))


@query("confidence_range", f"""WITH {migrated_sql()} SELECT repo, original_path, (length(original_path) % 30) / 20.0 AS confidence_score,
  (length(original_path) % 30) / 20.0 <= 1.0 AS accepted FROM migrated""")
def _(x: Inputs):
    scored = x.migrated.withColumn("confidence_score", (F.length("original_path") % 30) / 20.0)
    good, bad = rewrite.confidence_range(scored)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.select("repo", "original_path", "confidence_score", "accepted")


# --- imports and graph -------------------------------------------------------------------------------
@query("extract_imports", f"WITH {IMPORTS} SELECT repo, path, language, CAST(pattern_no AS BIGINT) AS pattern_no, match_no, import_path, statement FROM imports")
def _(x: Inputs):
    return imports.extract_imports(x.files).select(
        "repo", "path", "language", F.col("pattern_no").cast("bigint").alias("pattern_no"),
        F.col("match_no").cast("bigint").alias("match_no"), "import_path", "statement",
    )


EDGE_COLUMNS = "repo, source_file, target_file, import_statement, CAST(pattern_no AS BIGINT) AS pattern_no, CAST(match_no AS BIGINT) AS match_no"


def _edge_rows(edges):
    return edges.select(
        "repo", "source_file", "target_file", "import_statement", F.col("pattern_no").cast("bigint").alias("pattern_no"),
        F.col("match_no").cast("bigint").alias("match_no"),
    )


@query("resolve_imports", f"WITH {EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(x: Inputs):
    return _edge_rows(imports.resolve_imports(imports.extract_imports(x.files), x.paths))


@query("dependency_edges", f"WITH {EDGES} SELECT {EDGE_COLUMNS}, 'static' AS import_type FROM edges")
def _(x: Inputs):
    edges = imports.dependency_edges(x.files)
    return _edge_rows(edges).withColumn("import_type", F.lit("static"))


EXTRA = {"java": [rf"^import[{rules.SPACE}]+static[{rules.SPACE}]+([{rules.WORD}.]+)"], "markdown": [rf"\]\(([^)]+)\)"]}
EXTENDED = {k: rules.IMPORT_PATTERNS.get(k, []) + EXTRA.get(k, []) for k in {**rules.IMPORT_PATTERNS, **EXTRA}}


@query("extract_with", f"WITH {FILES}, found AS ({imports_sql(EXTENDED)}) SELECT repo, path, language, CAST(pattern_no AS BIGINT) AS pattern_no, match_no, import_path FROM found")
def _(x: Inputs):
    return imports.extract_imports(x.files, EXTRA).select(
        "repo", "path", "language", F.col("pattern_no").cast("bigint").alias("pattern_no"),
        F.col("match_no").cast("bigint").alias("match_no"), "import_path",
    )


def _go_calls(text: str):
    """What a Go file calls by a qualified name, as a user's parser might tell; it refuses texts with a tab."""
    for line in text.split("\n"):
        if "\t" in line:
            raise ValueError("tab")
        for word in line.split(" "):
            head, dot, tail = word.partition(".")
            if dot and head.isascii() and head.isalpha() and tail.isascii() and tail.isalpha():
                yield head, word


def _links(text: str):
    """Lines of a text file that begin with a capital letter and end in a full stop."""
    for line in text.split("\n"):
        if line.endswith(".") and "A" <= line[:1] <= "Z":
            yield line[:1], line


_GO_LINES = """SELECT f.repo, f.path, f.language, w.word, l.no, position(chr(9) IN l.line) > 0 AS tab
    FROM files f, (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS no FROM files) l,
      LATERAL (SELECT unnest(string_split(l.line, ' ')) AS word) w WHERE l.path = f.path AND f.language = 'go'"""


@query("extract_with_parsers", f"""WITH {FILES}, go AS MATERIALIZED ({_GO_LINES}), stop AS (SELECT path, min(no) AS no FROM go WHERE tab GROUP BY path),
  lines AS (SELECT repo, path, language, unnest(string_split(content, chr(10))) AS line FROM files WHERE language = 'javascript')
  SELECT repo, go.path, language, regexp_extract(word, '^[A-Za-z]+') AS import_path, word AS statement, CAST(NULL AS VARCHAR) AS parse_error
    FROM go LEFT JOIN stop ON stop.path = go.path WHERE (stop.no IS NULL OR go.no < stop.no) AND regexp_matches(word, '^[A-Za-z]+\\.[A-Za-z]+$')
  UNION ALL SELECT DISTINCT repo, go.path, language, NULL, NULL, 'ValueError: tab' FROM go JOIN stop ON stop.path = go.path
  UNION ALL SELECT repo, path, language, substr(line, 1, 1), line, NULL FROM lines WHERE regexp_matches(line, '^[A-Z]') AND ends_with(line, '.')""")
def _(x: Inputs):
    return parsers.parsed_imports(x.files, {"go": _go_calls, "javascript": _links})


@query("graph_degrees", f"""WITH {EDGES} SELECT f.repo, f.path, (SELECT count(*) FROM edges e WHERE e.source_file = f.path) AS out_degree,
  (SELECT count(*) FROM edges e WHERE e.target_file = f.path) AS in_degree FROM files f""")
def _(x: Inputs):
    edges = x.edges
    return graph.graph_degrees(x.paths, edges)


@query("topo_layers", f"WITH RECURSIVE {LAYERS} SELECT repo, path, layer FROM layers")
def _(x: Inputs):
    edges = x.edges
    return graph.topo_layers(x.ws, x.paths, edges)


@query("migration_order", f"WITH RECURSIVE {LAYERS} SELECT repo, path, layer, row_number() OVER (PARTITION BY repo ORDER BY layer NULLS LAST, path) AS position FROM layers")
def _(x: Inputs):
    return graph.migration_order(x.ws, x.layers)


@query("cyclic_files", f"WITH RECURSIVE {REACH} SELECT '{'corpus'}' AS repo, path FROM cyclic")
def _(x: Inputs):
    return graph.cyclic_files(x.ws, x.simple_edges)


@query("has_cycle", f"WITH RECURSIVE {REACH} SELECT 'corpus' AS repo, (SELECT count(*) FROM cyclic) > 0 AS has_cycle")
def _(x: Inputs):
    edges = x.simple_edges
    return graph.has_cycle(x.ws, x.paths, edges)


@query("scc", f"WITH RECURSIVE {COMPONENTS} SELECT repo, path, component FROM components")
def _(x: Inputs):
    return graph.components(x.ws, x.simple_edges)


@query("short_cycles", f"""WITH RECURSIVE {REACH} SELECT repo, s || ' > ' || t AS cycle FROM e WHERE s = t
  UNION ALL SELECT a.repo, a.s || ' > ' || a.t || ' > ' || a.s FROM e a JOIN e b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t
  UNION ALL SELECT a.repo, a.s || ' > ' || a.t || ' > ' || b.t || ' > ' || a.s FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t AND c.t = a.s
  WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t""")
def _(x: Inputs):
    cycles = graph.short_cycles(x.ws, x.simple_edges, 3)
    return cycles.select("repo", F.array_join("cycle", " > ").alias("cycle"))


@query("dependency_cycles", f"""WITH RECURSIVE {COMPONENTS},
  i AS MATERIALIZED (SELECT e.repo, s, t, c.component FROM e JOIN components c ON c.path = s JOIN components d ON d.path = t AND d.component = c.component),
  steps(component, node, n) AS (SELECT DISTINCT component, component, 0 FROM components
    UNION SELECT i.component, i.t, n + 1 FROM steps JOIN i ON i.component = steps.component AND i.s = node
    WHERE n + 1 < (SELECT count(*) FROM components k WHERE k.component = steps.component)),
  far AS MATERIALIZED (SELECT node, min(n) AS n FROM steps GROUP BY node),
  parent AS MATERIALIZED (SELECT t AS node, min(s) AS up FROM i JOIN far a ON a.node = s JOIN far b ON b.node = t WHERE b.n = a.n + 1 GROUP BY t),
  way(repo, s, t, spot, path) AS (SELECT repo, s, t, s, [s] FROM i
    UNION ALL SELECT way.repo, s, t, up, list_prepend(up, way.path) FROM way JOIN parent ON parent.node = spot WHERE spot <> t)
  SELECT repo, array_to_string(list_append(path, t), ' > ') AS cycle, CAST(len(path) AS BIGINT) AS length FROM way WHERE spot = t""")
def _(x: Inputs):
    cycles = graph.back_edge_cycles(x.ws, x.simple_edges)
    return cycles.select("repo", F.array_join("cycle", " > ").alias("cycle"), "length")


# --- aggregates -----------------------------------------------------------------------------------------
@query("language_counts", f"WITH {FILES} SELECT repo, language, count(*) AS files FROM files WHERE language <> 'unknown' GROUP BY ALL")
def _(x: Inputs):
    return analysis.language_counts(x.files)


COMPLEXITY = f"""sum(CASE WHEN file_type = 'source' THEN {DISTINCT_KEYWORDS} ELSE 0 END)
  / greatest(count_if(file_type = 'source'), 1)"""


@query("avg_complexity", f"WITH {FILES} SELECT repo, round({COMPLEXITY}, 6) AS avg_complexity FROM files GROUP BY repo")
def _(x: Inputs):
    return analysis.avg_complexity(x.files).select("repo", r6(F.col("avg_complexity")).alias("avg_complexity"))


@query("module_groups", f"""WITH {FILES} SELECT repo, module, CAST((rn - 1) // 20 AS BIGINT) AS part, count(*) AS files,
  string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT repo, path, split_part(path, '/', 1) AS module,
  row_number() OVER (PARTITION BY repo, split_part(path, '/', 1) ORDER BY path) AS rn FROM files) f GROUP BY ALL""")
def _(x: Inputs):
    groups = analysis.module_groups(x.ws, x.files, part_size=20)
    return groups.select("repo", "module", "part", "files", F.array_join("paths", ",").alias("paths"))


FRAMEWORK_RANK = "CASE " + " ".join(
    f"WHEN regexp_matches(content, {sql_text(p)}) THEN {i}" for i, (_, p) in enumerate(rules.FRAMEWORK_SIGNATURES)
) + " END"
FRAMEWORK = "CASE rank " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(rules.FRAMEWORK_SIGNATURES)) + " END"
FRAMEWORKS = f"SELECT repo, {FRAMEWORK} AS framework FROM (SELECT repo, min({FRAMEWORK_RANK}) AS rank FROM files GROUP BY repo) h"


@query("detect_framework", f"WITH {FILES} {FRAMEWORKS}")
def _(x: Inputs):
    return analysis.detect_framework(x.files)


SUMMARY = f"""SELECT 'corpus' AS repo, (SELECT count(*) FROM files) AS total_files,
  (SELECT string_agg(language, ', ' ORDER BY n DESC, language) FROM (SELECT language, count(*) AS n FROM files GROUP BY language) l) AS languages,
  (SELECT {COMPLEXITY} FROM files) AS avg_complexity, (SELECT count(*) FROM edges) AS dependency_edges,
  (SELECT count(*) FROM components) AS cyclic_files, (SELECT count(DISTINCT component) FROM components) AS cycle_groups"""


@query("analysis_summary", f"WITH RECURSIVE {COMPONENTS} SELECT * REPLACE (round(avg_complexity, 6) AS avg_complexity) FROM ({SUMMARY}) s")
def _(x: Inputs):
    summary = analysis.analysis_summary(x.files, x.edges, x.components)
    return summary.withColumn("avg_complexity", r6(F.col("avg_complexity")))


@query("first_n_files", f"WITH {FILES} SELECT repo, path, md5(left(content, 500)) AS head FROM files ORDER BY path LIMIT 50")
def _(x: Inputs):
    first = analysis.first_n_files(x.files, 50, 500)
    return first.select("repo", "path", F.md5("content").alias("head"))


@query("top_lists", f"""WITH {FILES} SELECT repo, file_type, string_agg(path, ',' ORDER BY path) AS first_paths FROM (SELECT *,
  row_number() OVER (PARTITION BY repo, file_type ORDER BY path) AS rn FROM files) f WHERE rn <= 10 GROUP BY ALL""")
def _(x: Inputs):
    first = ordered.first_rows(x.files.select("repo", "file_type", "path"), 10, ["repo", "file_type"], [F.col("path")])
    return first.groupBy("repo", "file_type").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first_paths")
    )


# --- checks -----------------------------------------------------------------------------------------------
REFS_SELECT = " UNION ALL ".join(
    f"""SELECT repo, original_path, new_path, {i} AS pattern_no, generate_subscripts(a, 1) AS match_no, unnest(a) AS ref FROM
    (SELECT repo, original_path, new_path, regexp_extract_all(migrated_content, {rx(p, False)}, 1) AS a FROM migrated)"""
    for i, p in enumerate(rules.REWRITTEN_IMPORT_PATTERNS)
)


def refs_sql(base: str) -> str:
    return f"""{base}, refs AS MATERIALIZED ({REFS_SELECT}),
  unresolved AS MATERIALIZED (SELECT * FROM refs r WHERE {sql_any('ref', rules.LOCAL_REFERENCE_PREFIXES, 'starts_with')}
    AND NOT EXISTS (SELECT 1 FROM migrated m WHERE contains(m.new_path, r.ref)))"""


# Half of the files get a local reference; some of these exist as a tail of a path.
LOCAL_REFS = """SELECT * REPLACE (CASE size_bytes % 4 WHEN 0 THEN migrated_content || 'require("..' || '/gone' || size_bytes || '")'
  WHEN 1 THEN migrated_content || 'from .ts import x' ELSE migrated_content END AS migrated_content) FROM
  (SELECT m.*, f.size_bytes FROM plain m JOIN files f ON f.path = m.original_path) p"""


def local_refs_sql(base: str = FILES) -> str:
    return f"{base}, plain AS ({MIGRATED_SELECT}), migrated AS MATERIALIZED ({LOCAL_REFS})"


def _with_local_refs(x: Inputs):
    kind = F.col("size_bytes") % 4
    text = F.concat(rewrite.stand_in_text(TARGET), F.when(
        kind == 0, F.concat(F.lit('require("../gone'), F.col("size_bytes").cast("string"), F.lit('")'))
    ).when(kind == 1, "from .ts import x").otherwise(""))
    return rewrite.render_migrated(x.files, TARGET, text)


def _facts(x: Inputs, migrated):
    return x.ws.save(checks.file_facts(migrated, TARGET))


@query("migrated_refs", f"WITH {migrated_sql()}, refs AS ({REFS_SELECT}) SELECT repo, new_path, CAST(pattern_no AS BIGINT) AS pattern_no, match_no, ref FROM refs")
def _(x: Inputs):
    return checks.migrated_refs(x.migrated).select(
        "repo", "new_path", F.col("pattern_no").cast("bigint").alias("pattern_no"),
        F.col("match_no").cast("bigint").alias("match_no"), "ref",
    )


@query("unresolved_refs", f"WITH {refs_sql(local_refs_sql())} SELECT repo, new_path, ref FROM unresolved")
def _(x: Inputs):
    return checks.unresolved_refs(x.ws, _facts(x, _with_local_refs(x))).select("repo", "new_path", "ref")


@query("orphan_files", f"""WITH {migrated_sql(EDGES)} SELECT repo, original_path, new_path FROM migrated WHERE original_path NOT IN (SELECT target_file FROM edges)
  AND original_path NOT IN (SELECT path FROM files WHERE {ENTRY})""")
def _(x: Inputs):
    return checks.orphan_files(x.migrated, x.edges, x.entry_points)


IMPORT_CHECK = f"""SELECT m.repo, '{rules.CHECK_TEXTS['imports'][0]}' || m.new_path AS check_name, u.refs IS NULL AS passed,
  CASE WHEN u.refs IS NULL THEN 'info' ELSE 'error' END AS severity,
  coalesce('{rules.CHECK_TEXTS['imports'][1]}' || u.refs, '{rules.CHECK_TEXTS['imports'][2]}') AS details
  FROM migrated m LEFT JOIN (SELECT original_path, string_agg(ref, ', ' ORDER BY pattern_no, match_no) AS refs FROM unresolved
  GROUP BY original_path) u USING (original_path)"""


def offenders_check(kind: str, condition: str, severity: str, count: bool = False, gate: str = "n > 0") -> str:
    name, bad, good = rules.CHECK_TEXTS[kind]
    good = good.replace("{target}", TARGET)
    before, _, after = bad.partition("{n}")
    text = f"{sql_text(before)} || n || {sql_text(after)} || first" if count else f"{sql_text(bad)} || first"
    return f"""SELECT 'corpus' AS repo, '{name}' AS check_name, NOT ({gate}) AS passed, CASE WHEN {gate} THEN '{severity}' ELSE 'info' END AS severity,
    CASE WHEN {gate} THEN {text} ELSE {sql_text(good)} END AS details FROM (SELECT (SELECT count(*) FROM migrated WHERE {condition}) AS n,
    (SELECT count(*) FROM migrated) AS files, (SELECT string_agg(new_path, ', ' ORDER BY original_path) FROM
      (SELECT * FROM migrated WHERE {condition} ORDER BY original_path LIMIT 5) o) AS first) c"""


ORPHANS = f"original_path NOT IN (SELECT target_file FROM edges) AND original_path NOT IN (SELECT path FROM files WHERE {ENTRY})"
ORPHAN_CHECK = offenders_check("orphans", ORPHANS, "warning", True, "n > 0 AND n < files * 0.5")
NAMING = f"regexp_matches(replace(regexp_extract(new_path, '[^/]*$'), '.', ''), {sql_text(rules.NAMING_FORBIDDEN[TARGET])})"
NAMING_CHECK = offenders_check("naming", NAMING, "warning")
EMPTY_CHECK = offenders_check("completeness", f"length({sql_strip('migrated_content')}) < {rules.MIN_TRANSLATED_CHARS}", "error")
SAME_CHECK = offenders_check("untranslated", f"{sql_strip('migrated_content')} = {sql_strip('original_content')}", "error")
_CYCLES = rules.CHECK_TEXTS["cycles"]
CYCLE_CHECK = f"""SELECT 'corpus' AS repo, '{_CYCLES[0]}' AS check_name, n = 0 AS passed, CASE WHEN n = 0 THEN 'info' ELSE 'warning' END AS severity,
  CASE WHEN n = 0 THEN '{_CYCLES[2]}' ELSE replace('{_CYCLES[1]}', '{{n}}', n::VARCHAR) END AS details
  FROM (SELECT count(DISTINCT component) AS n FROM components) c"""


@query("check_imports", f"WITH {refs_sql(local_refs_sql())} {IMPORT_CHECK}")
def _(x: Inputs):
    return checks.check_imports(x.ws, _facts(x, _with_local_refs(x)))


@query("check_orphans", f"WITH {migrated_sql(EDGES)} {ORPHAN_CHECK}")
def _(x: Inputs):
    return checks.check_orphans(x.migrated, x.edges, x.entry_points)


@query("check_naming", f"WITH {migrated_sql()} {NAMING_CHECK}")
def _(x: Inputs):
    return checks.check_naming(x.migrated, TARGET)


@query("check_cycles", f"WITH RECURSIVE {COMPONENTS} {CYCLE_CHECK}")
def _(x: Inputs):
    return checks.check_cycles(x.migrated, x.components)


TRIMMED = """SELECT * REPLACE (CASE WHEN length(original_path) % 5 = 0 THEN '  x  ' WHEN length(original_path) % 5 = 1
  THEN original_content || '  ' ELSE migrated_content END AS migrated_content) FROM plain"""
TRIMMED_MIGRATED = f"{FILES}, plain AS ({MIGRATED_SELECT}), migrated AS MATERIALIZED ({TRIMMED})"


def _trimmed(x: Inputs):
    kind = F.length("original_path") % 5
    text = F.when(kind == 0, "  x  ").when(kind == 1, F.concat("original_content", F.lit("  "))).otherwise(F.col("migrated_content"))
    return x.migrated.withColumn("migrated_content", text)


@query("check_completeness", f"WITH {TRIMMED_MIGRATED} {EMPTY_CHECK}")
def _(x: Inputs):
    return checks.check_completeness(_facts(x, _trimmed(x)))


@query("check_untranslated", f"WITH {TRIMMED_MIGRATED} {SAME_CHECK}")
def _(x: Inputs):
    return checks.check_untranslated(_facts(x, _trimmed(x)))


_FAULTS = {
    "orphans": ORPHANS, "naming": NAMING, "completeness": f"length({sql_strip('migrated_content')}) < {rules.MIN_TRANSLATED_CHARS}",
    "untranslated": f"{sql_strip('migrated_content')} = {sql_strip('original_content')}",
}


@query("check_offenders", f"WITH {EDGES}, plain AS ({MIGRATED_SELECT}), migrated AS MATERIALIZED ({TRIMMED}) " + " UNION ALL ".join(
    f"SELECT repo, '{rules.CHECK_TEXTS[k][0]}' AS check_name, new_path AS path FROM migrated WHERE {c}" for k, c in _FAULTS.items()))
def _(x: Inputs):
    return checks.offenders(_trimmed(x), x.edges, x.entry_points, TARGET)


ALL_CHECKS = " UNION ALL ".join([IMPORT_CHECK, ORPHAN_CHECK, NAMING_CHECK, CYCLE_CHECK, EMPTY_CHECK, SAME_CHECK])
CHECKS = f"{refs_sql(migrated_sql(COMPONENTS))}, checks AS MATERIALIZED ({ALL_CHECKS})"


@query("run_checks", f"WITH RECURSIVE {CHECKS} SELECT * FROM checks")
def _(x: Inputs):
    return x.checks


@query("validation_report", f"""WITH RECURSIVE {CHECKS} SELECT repo, count(*) AS total_checks, count_if(passed) AS passed_checks,
  count_if(NOT passed) AS failed_checks, round(count_if(passed) / greatest(count(*), 1) * 100, 6) AS success_rate FROM checks GROUP BY repo""")
def _(x: Inputs):
    report = checks.validation_report(x.checks)
    return report.withColumn("success_rate", r6(F.col("success_rate")))


REPORT = """SELECT repo, (SELECT count(*) FROM migrated) AS files_migrated, (SELECT round(avg(confidence_score), 6) FROM migrated) AS avg_confidence,
  CAST(0 AS BIGINT) AS files_with_warnings, count_if(passed) AS passed_checks, count(*) AS total_checks,
  round(count_if(passed) / greatest(count(*), 1) * 100, 6) AS success_rate FROM checks GROUP BY repo"""


@query("report_summary", f"WITH RECURSIVE {CHECKS} {REPORT}")
def _(x: Inputs):
    report = rewrite.report_summary(x.facts, x.checks)
    return report.withColumns({c: r6(F.col(c)) for c in ("avg_confidence", "success_rate")})


@query("migration_report", f"""WITH RECURSIVE {CHECKS} SELECT 'check' AS part, check_name AS item, severity || ': ' || details AS value FROM checks
  UNION ALL SELECT 'mapping', original_path, new_path FROM migrated""")
def _(x: Inputs):
    parts = rewrite.migration_report(x.facts, x.checks)
    rows = [
        parts["checks"].select(F.lit("check").alias("part"), F.col("check_name").alias("item"), F.concat_ws(": ", "severity", "details").alias("value")),
        parts["warnings"].select(F.lit("warning").alias("part"), F.col("new_path").alias("item"), F.col("warning").alias("value")),
        parts["mapping"].select(F.lit("mapping").alias("part"), F.col("original_path").alias("item"), F.col("new_path").alias("value")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- differences -----------------------------------------------------------------------------------------------
# The second version drops, repeats and renames lines, so that all counts occur.
_CHANGED = r"replace(replace(replace(content, 'fn', 'gn'), 'import os' || chr(10), ''), 'pass' || chr(10), 'pass' || chr(10) || '# pass' || chr(10) || '# pass' || chr(10))"
CHANGED = f"SELECT repo, path, content AS old, {_CHANGED} AS new FROM files"


def _changed(x: Inputs):
    text = F.replace(
        F.replace(F.replace("content", F.lit("fn"), F.lit("gn")), F.lit("import os\n"), F.lit("")),
        F.lit("pass\n"), F.lit("pass\n# pass\n# pass\n"),
    )
    return rewrite.translate_with(x.files, TARGET, text)


_LINES = sql_text(T.LINE_PATTERN)
DIFF = f"""{FILES}, changed AS MATERIALIZED ({CHANGED}),
  o AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(old, {_LINES})) AS line FROM changed) GROUP BY ALL),
  w AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(new, {_LINES})) AS line FROM changed) GROUP BY ALL),
  d AS (SELECT path, sum(greatest(coalesce(w.n, 0) - coalesce(o.n, 0), 0)) AS added, sum(greatest(coalesce(o.n, 0) - coalesce(w.n, 0), 0)) AS removed,
    sum(coalesce(o.n, 0)) AS n_old, sum(coalesce(w.n, 0)) AS n_new FROM o FULL JOIN w USING (path, line) GROUP BY path),
  diffs AS MATERIALIZED (SELECT c.repo, c.path, regexp_extract(c.path, '[^.]*$') AS original_language, '{TARGET}' AS target_language,
    CAST(coalesce(added, 0) AS BIGINT) AS lines_added, CAST(coalesce(removed, 0) AS BIGINT) AS lines_removed,
    CAST(coalesce(n_old - removed, 0) AS BIGINT) AS lines_unchanged,
    round(coalesce((added + removed) / greatest(n_old + n_new, 1), 0), 6) AS change_ratio FROM changed c LEFT JOIN d USING (path))"""
_NAMES = sql_text(rules.DEFINITION_PATTERN)
SEMANTIC = f"""SELECT repo, path, 'function_added' AS type, unnest(list_filter(n, lambda v: NOT list_contains(o, v))) AS name FROM names
  UNION ALL SELECT repo, path, 'function_removed_or_renamed', unnest(list_filter(o, lambda v: NOT list_contains(n, v))) FROM names"""
NAMES = f"""names AS (SELECT repo, path, list_distinct(regexp_extract_all(old, {_NAMES}, 1)) AS o,
  list_distinct(regexp_extract_all(new, {_NAMES}, 1)) AS n FROM changed)"""


def _rounded_diff(df):
    return df.withColumn("change_ratio", r6(F.col("change_ratio")))


@query("line_diff_stats", f"WITH {DIFF} SELECT * EXCLUDE (change_ratio) FROM diffs")
def _(x: Inputs):
    return diff.line_diff_stats(_changed(x)).drop("change_ratio")


@query("change_ratio", f"WITH {DIFF} SELECT repo, path, change_ratio FROM diffs")
def _(x: Inputs):
    return _rounded_diff(diff.line_diff_stats(_changed(x)).select("repo", "path", "change_ratio"))


@query("batch_diff", f"""WITH {DIFF}, {NAMES}, semantic AS ({SEMANTIC}) SELECT d.*,
  (SELECT count(*) FROM semantic s WHERE s.path = d.path) AS semantic_changes FROM diffs d""")
def _(x: Inputs):
    return _rounded_diff(diff.batch_diff(_changed(x)))


@query("semantic_changes", f"WITH {FILES}, changed AS ({CHANGED}), {NAMES} {SEMANTIC}")
def _(x: Inputs):
    return diff.semantic_changes(_changed(x))


# What went or came without moving is the same whichever longest common run of lines was taken: the surplus of one side.
@query("line_changes", f"""WITH {DIFF}, sides AS (SELECT path, line, coalesce(o.n, 0) AS went, coalesce(w.n, 0) AS came FROM o FULL JOIN w USING (path, line))
  SELECT c.repo, path, CASE WHEN went > came THEN 'old' ELSE 'new' END AS side, line AS text, abs(went - came) AS n
  FROM sides JOIN changed c USING (path) WHERE went <> came""")
def _(x: Inputs):
    rows = line_diff.ordered_line_diff(_changed(x)).where("moved_to IS NULL")
    return rows.groupBy("repo", "path", "side", "text").agg(F.count("*").alias("n"))


@query("diff_totals", f"""WITH {DIFF} SELECT repo, count(*) AS files, CAST(sum(lines_added) AS BIGINT) AS lines_added,
  CAST(sum(lines_removed) AS BIGINT) AS lines_removed, round(sum(change_ratio) / greatest(count(*), 1) * 100, 4) AS avg_change_pct FROM diffs GROUP BY repo""")
def _(x: Inputs):
    totals = diff.diff_totals(_rounded_diff(diff.line_diff_stats(_changed(x))))
    return totals.withColumn("avg_change_pct", F.round("avg_change_pct", 4))


@query("defined_names", f"WITH {FILES} SELECT repo, path, unnest(list_distinct(regexp_extract_all(content, {_NAMES}, 1))) AS name FROM files")
def _(x: Inputs):
    return x.files.select("repo", "path", F.explode(diff.defined_names(F.col("content"))).alias("name"))


@query("word_tokens", f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[{rules.WORD}]+')) AS word FROM documents) w GROUP BY ALL")
def _(x: Inputs):
    words = x.table("documents").select("lang", F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


# --- context ------------------------------------------------------------------------------------------------------
SUMMARY_TEXT = f"""SELECT s.repo, 'framework: ' || coalesce(w.framework, 'Unknown') || chr(10) || 'languages: ' || coalesce(languages, '') || chr(10) ||
    'entry points: ' || coalesce((SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM files WHERE {ENTRY} ORDER BY path LIMIT 10) p), '') || chr(10) ||
    'files: ' || total_files || chr(10) || 'dependency edges: ' || dependency_edges || chr(10) || 'files on cycles: ' || cyclic_files || chr(10) || chr(10) ||
    (SELECT string_agg('### ' || path || ' (' || language || ', ' || file_type || ')' || chr(10) || '```' || chr(10) || left(content, {rules.SUMMARY_CHARS}) || chr(10) || '```',
      chr(10) || chr(10) ORDER BY path) FROM (SELECT * FROM files ORDER BY path LIMIT {rules.SUMMARY_FILES}) f) AS summary
  FROM ({SUMMARY}) s LEFT JOIN ({FRAMEWORKS}) w ON w.repo = s.repo"""


def _summary(x: Inputs):
    known = x.scanned
    facts = analysis.analysis_summary(known, x.edges, x.components)
    return context.corpus_summary(x.files, facts, analysis.detect_framework(known), rules.SUMMARY_FILES, rules.SUMMARY_CHARS, known)


@query("corpus_summary", f"WITH RECURSIVE {COMPONENTS} SELECT repo, summary FROM ({SUMMARY_TEXT}) s")
def _(x: Inputs):
    return _summary(x)


DEP_CONTEXT = f"""SELECT e.repo, e.source_file AS path, count(*) AS dependencies, string_agg(chr(10) || '### Already translated: ' || e.target_file || chr(10) || '```' || chr(10) ||
    left(m.migrated_content, {rules.DEPENDENCY_CHARS}) || chr(10) || '```' || chr(10), '' ORDER BY pattern_no, match_no) AS context
  FROM edges e JOIN layers s ON s.path = e.source_file JOIN layers t ON t.path = e.target_file JOIN migrated m ON m.original_path = e.target_file
  WHERE coalesce(t.layer, 1000000) < coalesce(s.layer, 1000000) OR (coalesce(t.layer, 1000000) = coalesce(s.layer, 1000000) AND t.path < s.path)
  GROUP BY e.repo, e.source_file"""


@query("dep_context", f"WITH RECURSIVE {migrated_sql(LAYERS)} {DEP_CONTEXT}")
def _(x: Inputs):
    return context.dep_context(x.edges, x.layers, x.migrated, rules.DEPENDENCY_CHARS)


# --- symbols, shared by the context queries --------------------------------------------------------------------------
def _all(pattern: str, group: int = 1, column: str = "content") -> str:
    return f"regexp_extract_all({column}, {rx(pattern)}, {group})"


def _arm(language: str, names: str, kind: str) -> str:
    return f"SELECT repo, path, unnest({names}) AS name, '{kind}' AS type FROM files WHERE language IN {language}"


_JS_IN, _PY_IN, _JAVA_IN = "('javascript', 'typescript')", "('python')", "('java')"


def _public(names: str) -> str:
    return f"list_filter({names}, lambda n: NOT starts_with(n, '_'))"


_BRACED = (
    f"list_transform(flatten(list_transform(list_filter({_all(symbols.JS_EXPORT_MODULE)}, lambda v: v <> ''), lambda v: string_split(v, ','))), "
    f"lambda v: {sql_strip('split_part(v, chr(58), 1)')})"
)
EXPORTS = " UNION ALL ".join([
    _arm(_PY_IN, f"flatten(list_transform({_all(symbols.PY_ALL)}, lambda v: regexp_extract_all(v, {sql_text(symbols.QUOTED)}, 1)))", "explicit_export"),
    _arm(_PY_IN, _public(_all(symbols.PY_TOP_DEF)), "function"),
    _arm(_PY_IN, _public(_all(symbols.PY_TOP_CLASS)), "class"),
    _arm(_JS_IN, _all(symbols.JS_EXPORT_NAMED), "named"),
    _arm(_JS_IN, f"list_transform({_all(symbols.JS_EXPORT_DEFAULT)}, lambda n: CASE WHEN n = '' THEN 'default' ELSE n END)", "default"),
    _arm(_JS_IN, _BRACED, "cjs"),
    _arm(_JS_IN, f"list_filter({_all(symbols.JS_EXPORT_MODULE, 2)}, lambda n: n <> '')", "cjs_default"),
    _arm(_JAVA_IN, _all(symbols.JAVA_EXPORT_CLASS), "class"),
    _arm(_JAVA_IN, _all(symbols.JAVA_EXPORT_METHOD), "method"),
])


def _type_lines(language: str) -> str:
    targets = rules.TYPE_MAPPINGS[language].get(TARGET, {})
    return "\n".join(f"  {k} → {v}" for k, v in targets.items())


PROMPTS = f"""SELECT f.repo, f.path, 'Rewrite one file in {TARGET}.' || chr(10) || chr(10) || '[summary]' || chr(10) || left(s.summary, {rules.CONTEXT_CHARS}) || chr(10) || chr(10) ||
  '[types]' || chr(10) || {sql_case('f.language', {k: _type_lines(k) for k in rules.TYPE_MAPPINGS}, "''")} || chr(10) || chr(10) ||
  '[file]' || chr(10) || 'path: ' || f.path || chr(10) || 'language: ' || f.language || chr(10) || 'type: ' || f.file_type || chr(10) ||
  'imports: ' || coalesce(i.imports, '') || chr(10) || 'exports: ' || coalesce(x.exports, '') || chr(10) || chr(10) ||
  '[dependencies]' || chr(10) || coalesce(c.context, '{rules.NO_DEPENDENCIES}') || chr(10) || chr(10) || '[source]' || chr(10) || f.content AS prompt
  FROM files f CROSS JOIN ({SUMMARY_TEXT}) s LEFT JOIN contexts c ON c.path = f.path
  LEFT JOIN (SELECT path, string_agg(import_path, ', ' ORDER BY import_path) AS imports FROM (SELECT DISTINCT path, import_path FROM imports) u GROUP BY path) i ON i.path = f.path
  LEFT JOIN (SELECT path, string_agg(name, ', ' ORDER BY name) AS exports FROM (SELECT DISTINCT path, name FROM exports) u GROUP BY path) x ON x.path = f.path"""


@query("assemble_prompts", f"""WITH RECURSIVE {migrated_sql(LAYERS)}, contexts AS ({DEP_CONTEXT}), exports AS ({EXPORTS})
  SELECT repo, path, md5(prompt) AS digest, CAST(length(prompt) AS BIGINT) AS n_chars FROM ({PROMPTS}) p""")
def _(x: Inputs):
    prompts = context.assemble_prompts(
        x.files, x.ws.save(_summary(x)), context.dep_context(x.edges, x.layers, x.migrated, rules.DEPENDENCY_CHARS),
        imports.listed_imports(x.scanned), symbols.exports(x.scanned), TARGET, rules.CONTEXT_CHARS,
    )
    return prompts.select("repo", "path", F.md5("prompt").alias("digest"), F.length("prompt").cast("bigint").alias("n_chars"))


@query("doc_prompt", f"""WITH RECURSIVE {CHECKS} SELECT repo, 'Write a README for a rewritten code base.' || chr(10) || 'source: ' || repo || chr(10) || 'target: {TARGET}' || chr(10) ||
  'files: ' || files_migrated || chr(10) || 'validation: ' || passed_checks || '/' || total_checks || ' checks passed' AS prompt FROM ({REPORT}) r""")
def _(x: Inputs):
    return context.doc_prompt(rewrite.report_summary(x.facts, x.checks), TARGET)


# --- the open extension points ------------------------------------------------------------------------------------------
@query("translate_with", f"WITH {FILES} SELECT repo, path AS original_path, md5(replace(content, 'function', 'fn')) AS digest FROM files")
def _(x: Inputs):
    translated = rewrite.translate_with(x.files, TARGET, F.replace("content", F.lit("function"), F.lit("fn")))
    return translated.select("repo", "original_path", F.md5("migrated_content").alias("digest"))


@query("staged_transform", f"WITH {FILES} SELECT repo, split_part(path, '/', 1) AS module, count(*) AS files FROM files WHERE file_type <> 'test' GROUP BY ALL")
def _(x: Inputs):
    stages = [
        ("without tests", lambda df: classify.skip_tests(df, preserve_tests=False)),
        ("modules", classify.modules),
        ("count", lambda df: df.groupBy("repo", "module").agg(F.count("*").alias("files"))),
    ]
    return rewrite.staged(x.files, stages)


