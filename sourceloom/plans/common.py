"""What the registered queries share: their inputs and the matching SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import analysis, checks, classify, graph, imports, rewrite, symbols, usage
from sourceloom.plans import corpus
from sourceloom.session import DEFAULTS, Workspace
from sourceloom.sources import files as S

TARGET = rules.DEFAULT_TARGET


@dataclass
class Inputs:
    """Relations of one corpus; small ones that several steps need are written once."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, name)

    @cached_property
    def ws(self) -> Workspace:
        return Workspace(self.spark, "work")

    @cached_property
    def raw(self) -> DataFrame:
        return corpus.raw_corpus(self.spark, self.sf_dir)

    @cached_property
    def files(self) -> DataFrame:
        return S.load_corpus(self.raw)

    @cached_property
    def paths(self) -> DataFrame:
        return self.linked.select("repo", "path") if "linked" in vars(self) else self.ws.save(self.files.select("repo", "path"))

    @cached_property
    def linked(self) -> DataFrame:
        """The imports of all files, from one pass over the texts; what a query needs further of them comes with it in ``scanned``."""
        return self.scanned if "scanned" in vars(self) else self.ws.save(imports.file_imports(self.files))

    @cached_property
    def scanned(self) -> DataFrame:
        """What edges, summaries and symbols need of the texts, from one pass over them."""
        facts = analysis.file_facts(F.col("content"), F.col("path"))
        found = symbols.export_entries(F.col("language"), F.col("content"))
        return self.ws.save(imports.file_imports(self.files, F.col("file_type"), *facts, found.alias("exports")))

    @cached_property
    def edges(self) -> DataFrame:
        return self.ws.save(imports.dependency_edges(self.linked))

    @cached_property
    def simple_edges(self) -> DataFrame:
        return graph.simple_edges(self.edges)

    @cached_property
    def layers(self) -> DataFrame:
        edges = self.edges  # its pass over the texts leaves the paths too
        return self.ws.save(graph.topo_layers(self.ws, self.paths, edges))

    @cached_property
    def components(self) -> DataFrame:
        return self.ws.save(graph.components(self.ws, self.simple_edges))

    @cached_property
    def migrated(self) -> DataFrame:
        return rewrite.render_migrated(self.files, TARGET)

    @cached_property
    def entry_points(self) -> DataFrame:
        return classify.entry_points(self.files)

    @cached_property
    def facts(self) -> DataFrame:
        """What checks, edges and entry points need of the texts, from one pass over them."""
        path, content = F.col("original_path"), F.col("original_content")
        return self.ws.save(checks.file_facts(
            self.migrated, TARGET, F.col("confidence_score"), F.col("warnings"), path.alias("path"), classify.language_of(path).alias("language"),
            imports.import_matches(classify.language_of(path), content).alias("imports"),
            classify.is_entry_point(path, content).alias("entry")))

    @cached_property
    def checks(self) -> DataFrame:
        edges = self.ws.save(imports.dependency_edges(self.facts))
        components = self.ws.save(graph.components(self.ws, graph.simple_edges(edges)))
        entries = self.facts.where("entry").select("repo", "path")
        return self.ws.save(checks.run_checks(self.ws, self.facts, edges, entries, components, TARGET))

    # --- logs -----------------------------------------------------------------------------
    @cached_property
    def metrics(self) -> DataFrame:
        labels = F.create_map(
            F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")
        )
        return self.table("events").select(
            T.metric_key(F.col("event_type"), labels).alias("key"), "value", "ts", F.col("event_id").alias("seq")
        )

    @cached_property
    def spans(self) -> DataFrame:
        micros = F.round(F.col("value") * 1_000_000).cast("bigint")
        return self.table("events").select(
            F.col("event_id").alias("span_id"), F.col("event_type").alias("operation"),
            F.col("ts").cast("timestamp").alias("started_at"),
            F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros).alias("ended_at"),
            F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        )

    @cached_property
    def statuses(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("job"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq")
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Cache requests: key, at in microseconds, seq."""
        return self.table("events").select(
            F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"),
            micros("ts").alias("at"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def prompts(self) -> DataFrame:
        """Model requests: each user turn with its conversation's system text and its answer."""
        turns = self.table("conversations")
        system = turns.filter("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system_prompt"))
        answers = turns.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(
            F.min("text").alias("answer")
        )
        names = list(rules.PROVIDERS)
        provider = F.element_at(T.literal_array(names), (F.col("conv_id") % len(names) + 1).cast("int"))
        asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_prompt"))
        joined = asked.join(system, "conv_id", "left").join(answers, ["conv_id", "turn"], "left")
        return joined.withColumn("provider", provider).withColumn(
            "model", F.concat("provider", F.lit("-model"))
        ).withColumn(
            "prompt_key", T.prompt_key(F.col("model"), F.col("system_prompt"), F.col("user_prompt"))
        )

    @cached_property
    def answered(self) -> DataFrame:
        return usage.responses(self.prompts, ["conv_id", "turn"]).withColumns({
            "failed": F.col("answer").isNull(),
            "latency_ms": F.coalesce(F.length("answer"), F.lit(0)) / 4.0,
        })

    @cached_property
    def points(self) -> DataFrame:
        """Snapshot points: one per order."""
        from sourceloom.operators import history

        return self.table("orders").select(
            F.col("o_orderpriority").alias("phase"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
            history.snapshot_name(F.col("o_orderpriority"), F.col("o_orderdate")).alias("snapshot_id"),
        )


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def prepare(spark: SparkSession) -> None:
    """Session settings the results depend on; a cluster's own sizing is left alone."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)


REGISTRY: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    """Register a query with the SQL that checks it."""
    def add(build: Callable[[Inputs], DataFrame]):
        REGISTRY[name] = (build, sql)
        return build

    return add


# --- SQL fragments ---------------------------------------------------------------------------
def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_case(key: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def rx(pattern: str, multiline: bool = True) -> str:
    return sql_text(("(?m)" if multiline else "") + pattern)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {sql_text(f'^{T.SPACES}+|{T.SPACES}+$')}, '', 'g')"


def sql_any(column: str, markers: list[str], fn: str = "contains") -> str:
    return "(" + " OR ".join(f"{fn}({column}, {sql_text(m)})" for m in markers) + ")"


EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
LANGUAGE = sql_case(EXT, rules.LANGUAGE_BY_EXTENSION, "'unknown'")
FILE_TYPE = f"""CASE WHEN {sql_any('lower(path)', rules.TEST_MARKERS)} THEN 'test'
  WHEN {EXT} IN {sql_in(rules.DOCUMENT_EXTENSIONS)} OR contains(lower(path), 'docs/') THEN 'documentation'
  WHEN {EXT} IN {sql_in(rules.CONFIG_EXTENSIONS)} THEN 'config'
  WHEN {LANGUAGE} = 'unknown' THEN 'asset'
  WHEN {EXT} IN {sql_in(rules.SCRIPT_EXTENSIONS)} OR {sql_any('lower(path)', rules.BUILD_MARKERS)} THEN 'build'
  ELSE 'source' END"""
PRUNED = f"NOT list_has_any(string_split(path, '/')[1:len(string_split(path, '/')) - 1], {sql_list(rules.IGNORED_DIRECTORIES)})"
KEPT = f"({LANGUAGE} <> 'unknown' OR {EXT} IN {sql_in(rules.KEPT_UNKNOWN_EXTENSIONS)})"
DECODED = "replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

RAW = f"raw AS MATERIALIZED (SELECT '{corpus.REPO}' AS repo, path, content, size_bytes FROM ({corpus.CODE_CORPUS_SQL}) c)"
FILES = f"""{RAW}, files AS MATERIALIZED (
  SELECT repo, path, {DECODED} AS content, {LANGUAGE} AS language, {FILE_TYPE} AS file_type, size_bytes
  FROM raw WHERE {PRUNED} AND {KEPT})"""


def imports_sql(patterns: dict[str, list[str]]) -> str:
    arms = [
        f"""SELECT repo, path, language, {i} AS pattern_no, generate_subscripts(a, 1) AS match_no,
          unnest(a) AS import_path, {sql_strip('unnest(b)')} AS statement
        FROM (SELECT repo, path, language, regexp_extract_all(content, {rx(p)}, 1) AS a,
          regexp_extract_all(content, {rx(p)}, 0) AS b FROM files WHERE language = '{lang}')"""
        for lang, found in patterns.items() for i, p in enumerate(found)
    ]
    return " UNION ALL ".join(arms)


def edges_sql(imports_cte: str) -> str:
    suffixes = ", ".join(f"({i}, {sql_text(s)})" for i, s in enumerate(rules.RESOLUTION_SUFFIXES))
    return f"""SELECT i.repo, i.path AS source_file, arg_min(f.path, s.rank) AS target_file,
        any_value(i.statement) AS import_statement, i.pattern_no, i.match_no
      FROM {imports_cte} i CROSS JOIN (VALUES {suffixes}) s(rank, suffix)
      JOIN files f ON f.repo = i.repo AND f.path = replace(ltrim(
        CASE WHEN i.language = 'python' THEN replace(i.import_path, '.', '/') ELSE i.import_path END || s.suffix,
        './'), '\\', '/')
      GROUP BY i.repo, i.path, i.pattern_no, i.match_no"""


IMPORTS = f"{FILES}, imports AS MATERIALIZED ({imports_sql(rules.IMPORT_PATTERNS)})"
EDGES = f"{IMPORTS}, edges AS MATERIALIZED ({edges_sql('imports')})"
REACH = f"""{EDGES}, e AS MATERIALIZED (SELECT DISTINCT repo, source_file AS s, target_file AS t FROM edges),
  reach(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON e.s = r.t),
  cyclic AS MATERIALIZED (SELECT s AS path FROM reach WHERE s = t)"""
COMPONENTS = f"""{REACH}, components AS MATERIALIZED (SELECT '{corpus.REPO}' AS repo, a.s AS path, min(a.t) AS component
  FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s GROUP BY a.s)"""
LAYERS = f"""{COMPONENTS}, stuck AS MATERIALIZED (SELECT path FROM cyclic UNION SELECT s FROM reach WHERE t IN (SELECT path FROM cyclic)),
  depth(path, d) AS (SELECT path, 0 FROM files WHERE path NOT IN (SELECT path FROM stuck)
    UNION SELECT e.s, d + 1 FROM depth JOIN e ON e.t = depth.path WHERE e.s NOT IN (SELECT path FROM stuck)),
  layers AS MATERIALIZED (SELECT f.repo, f.path, CAST(max(d) AS BIGINT) AS layer
    FROM files f LEFT JOIN depth USING (path) GROUP BY f.repo, f.path)"""
HEADER = rules.MIGRATED_HEADER
MIGRATED_SELECT = f"""SELECT repo, path AS original_path,
    CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '.ts') ELSE path || '.ts' END AS new_path,
    content AS original_content,
    '{HEADER[0]}' || language || '{HEADER[1]}{TARGET}' || chr(10) || '// Original: ' || path || chr(10) || chr(10) || content
      AS migrated_content,
    '{TARGET}' AS target_language, {rules.STAND_IN_CONFIDENCE}::DOUBLE AS confidence_score FROM files"""
ENTRY = f"({sql_any('path', rules.ENTRY_FILE_NAMES, 'ends_with')} OR {sql_any('content', rules.ENTRY_MARKERS)})"
DISTINCT_KEYWORDS = (
    f"len(list_intersect(list_distinct(regexp_extract_all(content, '[{rules.WORD}]+')), {sql_list(rules.BRANCH_KEYWORDS)}))"
)


def migrated_sql(base: str = FILES) -> str:
    return f"{base}, migrated AS MATERIALIZED ({MIGRATED_SELECT})"
