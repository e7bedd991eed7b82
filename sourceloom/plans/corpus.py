"""Inputs of the registered queries, made by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed text: the same statement runs in Spark and in the checking database.
CODE_CORPUS_SQL = """
SELECT doc_id, path, content, CAST(bit_length(content) / 8 AS BIGINT) AS size_bytes FROM (
SELECT doc_id,
  concat(CASE WHEN doc_id % 17 = 5 THEN 'node_modules/' ELSE '' END, 'm', CAST(doc_id % 20 AS VARCHAR(20)),
    CASE WHEN doc_id % 11 = 3 THEN '/tests' ELSE '' END, '/f', d,
    CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.py' WHEN 4 THEN '.go'
      WHEN 5 THEN '.js' WHEN 6 THEN '.md' ELSE CASE WHEN doc_id % 16 = 7 THEN '.java' ELSE '.bin' END END) AS path,
  concat(
    CASE WHEN doc_id % 8 IN (0,3) THEN concat('from m', pm, '.f', p, ' import x', nl, 'import os', nl,
           '__all__ = [', q, 'fn', d, q, ']', nl, 'def fn', d, '(a, b):', nl, '    if a:', nl, '        return b', nl,
           'class K', d, '(Base):', nl, '    async def go(self, x):', nl, '        pass', nl, '    def _hid(self):', nl, '        pass', nl)
         WHEN doc_id % 8 IN (1,2,5) THEN concat('const a = require(', q, 'm', pm, '/f', p, q, ');', nl,
           'const { Router, json } = require(', q, 'express', q, ');', nl,
           'import d, { u as v, w } from ', q, 'lib', q, ';', nl,
           CASE WHEN doc_id % 8 = 2 THEN concat('import type { T1, T2 } from ', q, 'types', q, ';', nl) ELSE '' END,
           'export function fn', d, '(a, b) { if (a) { return b; } else { for (;;) {} } }', nl,
           'class K', d, ' extends Base {', nl, '  async go(x) { return x; }', nl, '}', nl,
           'const arrow', d, ' = async (x) => x;', nl, 'module.exports = { fn', d, ', k: K', d, ' };', nl)
         WHEN doc_id % 8 = 4 THEN concat('import ', q, 'm', pm, '/f', p, q, nl, 'func fn', d, '(a int) int { return a }', nl)
         WHEN doc_id % 16 = 7 THEN concat('import java.util.List;', nl, 'import static org.junit.Assert.*;', nl,
           '@Service', nl, 'public class K', d, ' extends Base implements A, B {', nl,
           '  public int fn', d, '(String s, int n) { return n; }', nl, '}', nl)
         ELSE '' END,
    CASE WHEN doc_id % 8 IN (1,5) AND doc_id % 3 = 1 THEN concat('import b from ', q, 'm',
           CAST((2*doc_id+1) % 20 AS VARCHAR(20)), '/f', CAST(2*doc_id+1 AS VARCHAR(20)), q, ';', nl) ELSE '' END,
    text) AS content
FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR(20)) AS d, chr(10) AS nl, chr(34) AS q,
        CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR(20)) AS p,
        CAST(CAST(floor(doc_id / 2) AS BIGINT) % 20 AS VARCHAR(20)) AS pm FROM documents) s ) t
"""

REPO = "corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file as a source delivers it: repo, path, content, size_bytes."""
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("documents")
    corpus = spark.sql(CODE_CORPUS_SQL)
    return corpus.select(F.lit(REPO).alias("repo"), "path", "content", "size_bytes")
