"""Registered queries of the subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import (decontamination, exact_dedup, filter_audit, jaccard_join, language_id, license_scan, near_dup, packing, personal_data,
                            prefix_trie, token_counts, toxicity, warc)
from sourceloom.llm.common import prepare, table
from sourceloom.session import Workspace

VOCABULARY = "byte_bpe_50k.json"
QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents")
    models = language_id.train(docs.where(~held_out), "lang", "text", "doc_id")
    return language_id.identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op2_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.exact_groups(Workspace(spark, "op2"), docs, text_sha256=digest)


@query("op3_warc_revisits", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
         r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS lowest FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > lowest THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > lowest THEN lowest END AS refers_to
    FROM r""")
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(Workspace(spark, "op3"), table(spark, sf_dir, "pages"))


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(Workspace(spark, "op4"), table(spark, sf_dir, "documents"), shingle=4)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Workspace(spark, "op5"), table(spark, sf_dir, "documents"), packing.worker_vocabulary(spark, public_tokenizers.path(VOCABULARY)))


@query("op6_license_scan", """
    WITH t(license, words) AS (SELECT license, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') FROM (VALUES """ + ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES) + """) v(license, text)),
         ts AS (SELECT DISTINCT license, CAST(pow(2, ceil(log2(greatest(n, 16)))) AS BIGINT) AS span, array_to_string(words[k:k + 4], ' ') AS s
                FROM (SELECT license, words, len(words) AS n, unnest(range(1, len(words) - 3)) AS k FROM t)),
         sizes AS (SELECT license, count(*) AS size FROM ts GROUP BY license),
         d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
         ds AS (SELECT doc_id, k - 1 AS pos, array_to_string(words[k:k + 4], ' ') AS s
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d)),
         h AS (SELECT doc_id, license, s, unnest([pos // span, pos // span - 1]) AS win FROM ds JOIN ts USING (s)),
         v AS (SELECT doc_id, license, max(held * 100 // size) AS share
               FROM (SELECT doc_id, license, win, count(DISTINCT s) AS held FROM h GROUP BY ALL) JOIN sizes USING (license)
               WHERE held * 100 >= size * 80 GROUP BY doc_id, license),
         l AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(share) AS best FROM v GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, CAST(coalesce(best, 0) AS INTEGER) AS best
    FROM d LEFT JOIN l USING (doc_id)""")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(Workspace(spark, "op6"), table(spark, sf_dir, "documents"))


@query("op7_winnowing_decontamination", r"""
    WITH w AS (SELECT * FROM (VALUES ('[\x00-\x2F\x3A-\x60\x7B-\x7F]+', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) v(sep, up, low)),
         d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), up, low), sep), lambda x: x <> '') AS words FROM documents, w),
         i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), up, low), sep), lambda x: x <> '') AS words FROM benchmark, w),
         iw AS (SELECT DISTINCT item_id, n, array_to_string(words[k:k + n - 1], ' ') AS win
                FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0)),
         sizes AS (SELECT DISTINCT n FROM iw),
         dw AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS win
                FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, sizes WHERE len(words) >= n)),
         h AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
         c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
         l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(Workspace(spark, "op7"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(Workspace(spark, "op8"), table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), F.lit(k).eqNullSafe)).cast("bigint").alias(f"n_{k}")
              for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.listed("base"), 256).alias("base_sha256"), personal_data.listed("spans").alias("spans"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.whole_token_vocabulary(public_tokenizers.path(VOCABULARY))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


@query("op11_jaccard_join", r"""
    WITH RECURSIVE
         w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
         s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k:k + 2], ' '))) END AS grams FROM w),
         k AS (SELECT doc_id, grams, CAST(len(grams) AS BIGINT) AS n, sha256(array_to_string(list_sort(grams), chr(10))) AS key FROM s),
         c AS (SELECT key, n, min(doc_id) AS least, any_value(grams) AS grams FROM k WHERE n > 0 GROUP BY key, n),
         t AS (SELECT least AS id, n, unnest(grams) AS g FROM c),
         l AS (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n
               HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 90),
         e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
         r(id, seen) AS (SELECT least, least FROM c UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.seen),
         m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
    SELECT doc_id, k.n AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM k LEFT JOIN c ON k.key = c.key AND k.n > 0 LEFT JOIN m ON m.id = c.least""")
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, 2 << 20)
    return jaccard_join.jaccard_components(Workspace(spark, "op11"), table(spark, sf_dir, "documents"), shingle=3, percent=90)


@query("op12_filter_audit", r"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
         m AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
         f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                      CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN len(list_distinct(words)) * 100 < len(words) * 65 THEN 'B' ELSE '' END
                      || CASE WHEN length(regexp_replace(t, '[^A-Z]', '', 'g')) * 100 > length(t) * 5 THEN 'C' ELSE '' END
                      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                      || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
               FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
         c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
         x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
         s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS filter, substr(filter_order, 1, k - 1) AS earlier
               FROM (SELECT filter_order, unnest(range(1, 6)) AS k FROM o)),
         r AS (SELECT part, filter_order, step, filter,
                      sum(CASE WHEN alive AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND bad THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN NOT alive AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN alive AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND bad THEN toxic ELSE 0 END) AS toxic_lost
               FROM (SELECT *, translate(fails, earlier, '') = fails AS alive, contains(fails, filter) AS bad FROM c, s)
               GROUP BY part, filter_order, step, filter)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM r""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(Workspace(spark, "op12"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_prefix_trie", r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
         p AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos
               FROM (SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS id,
                            len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM t)),
         b AS (SELECT conv_id, count(*) AS turns, CAST(conv_id AS VARCHAR) AS name FROM p GROUP BY conv_id),
         bits AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
                         flatten(list_transform(range(1, length(name) + 1), lambda k: list_transform(range(0, 8), lambda j: (ascii(substr(name, k, 1)) >> CAST(j AS INTEGER)) & 1))) AS bits FROM b),
         c AS (SELECT conv_id, turns, base, xor(list_reduce(list_transform([4294967295] || bits, lambda y: CAST(y AS BIGINT)),
                      lambda a, y: xor(xor(a, y) >> 1, 3988292384 * (xor(a, y) & 1))), 4294967295) % 4 AS h FROM bits),
         f AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(o.turns, 0)) AS head, greatest(c.turns - c.h, 0) AS own FROM c LEFT JOIN c o ON o.conv_id = c.base),
         r AS (SELECT f.conv_id, pos AS d, head + own AS length, id, words FROM f JOIN p ON p.conv_id = f.base WHERE pos <= h
               UNION ALL SELECT f.conv_id, pos - h + head, head + own, id, words FROM f JOIN p ON p.conv_id = f.conv_id WHERE pos > h),
         q AS (SELECT conv_id, d, length, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
               UNION ALL SELECT conv_id, 0, head + own, 0, '' FROM f),
         n AS (SELECT path, d, min(conv_id) AS conv, count(*) AS n, max(words) AS words,
                      coalesce(string_agg(CASE WHEN d = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM q GROUP BY path, d),
         k AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
         v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON n.path = k.path AND n.d = k.d),
         s AS (SELECT above, substr(path, 1, 32 * above) AS path, sum(CAST(kids = 0 AS INTEGER)) AS leaves, sum((n - 1) * words) AS saved
               FROM (SELECT *, unnest(range(0, d + 1)) AS above FROM v) GROUP BY ALL)
    SELECT v.conv AS conv_id, v.d AS depth, u.conv AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
    FROM v JOIN s ON s.above = v.d AND s.path = v.path LEFT JOIN n u ON v.d > 0 AND u.d = v.d - 1 AND u.path = substr(v.path, 1, 32 * (v.d - 1))""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op13")
    turns, convs = prefix_trie.with_shared_heads(ws, prefix_trie.turn_rows(ws, table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(ws, turns, convs)
