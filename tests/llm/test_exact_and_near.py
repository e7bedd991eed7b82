"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import common, exact_dedup, near_dup
from sourceloom.llm.common import bit_table, drop_rows, in_bits, row_key
from sourceloom.llm.components import components
from sourceloom.llm.words import word_hashes

from .conftest import edge_rows, make, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups_on_all_edge_cases(spark, ws, edges):
    rows = exact_dedup.exact_groups(ws, edges, text_sha256=F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    given = [(i, t or "") for i, t, _ in edge_rows()]
    size = Counter(t for _, t in given)
    top = {t: max((i for i, u in given if u == t and i is not None), default=None) for _, t in given}
    expected = [(i, top[t], size[t], i == top[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in given]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))


def test_exact_groups_tell_texts_with_equal_length_and_head_apart(spark, ws):
    head = "h" * 500
    docs = make(spark, [(1, head + "a", "en"), (2, head + "b", "en"), (3, head + "a", "en")])
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_groups(ws, docs).collect()} == {1: (3, False), 2: (2, True), 3: (3, True)}


def test_empty_tables(ws, nothing):
    assert exact_dedup.exact_groups(ws, nothing).count() == 0
    assert near_dup.near_duplicates(ws, nothing).count() == 0


def test_bitmap_has_every_key_and_a_fixed_size(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    table = bit_table(keys, "k", 10)
    assert table.count() == 16
    assert in_bits(keys, F.col("k"), bit_table(keys, "k")).where("NOT _maybe").count() == 0
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("k"))
    assert in_bits(others, F.col("k"), bit_table(keys, "k")).where("_maybe").count() < 200


CLASHING = ("doc_id bigint, text string, `_maybe` string, `_row` int, `_word` bigint, `_bits` bigint, `_bucket` bigint, `_again` int, `_gone` string, "
            "whole string, id string, row int, page int, words string, hit boolean, again boolean, gone_id int, gone_row int")


def clashing(spark, rows):
    """A table whose other columns bear every name that is used inside."""
    more = ("m", 1, 2, 3, 4, 5, "g", "w", "i", 6, 7, "x", True, False, 8, 9)
    return spark.createDataFrame([(i, t, *more) for i, t in rows], CLASHING).repartition(3)


def gone_rows(docs, where):
    return docs.where(where).select(F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("row"))


def test_drop_rows_takes_id_and_text_together(spark, ws):
    docs = make(spark, [(1, "a", "en"), (1, "b", "en"), (None, "c", "en"), (None, "d", "en"), (2, None, "en")])
    left = drop_rows(ws, docs, gone_rows(docs, "text IN ('a', 'c') OR text IS NULL"), "doc_id", "text")
    assert left.columns == docs.columns
    assert sorted(r.text for r in left.collect()) == ["b", "d"]


@pytest.mark.parametrize("filter_bits, most_bits", [(22, 28), (6, 6), (4, 3)])
def test_drop_rows_whatever_the_columns_are_called(spark, ws, monkeypatch, filter_bits, most_bits):
    """Also with a bitmap so full that kept rows hit it, and beyond its largest size."""
    monkeypatch.setattr(common, "FILTER_BITS", filter_bits)
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    monkeypatch.setattr(common, "BITS_PER_KEY", 1)
    docs = clashing(spark, [(k, f"text {k}") for k in range(200)] + [(7, "other text"), (None, None)])
    left = drop_rows(ws, docs, gone_rows(docs, "doc_id < 60 AND text <> 'other text'"), "doc_id", "text")
    assert left.schema == docs.schema
    assert sorted(left.collect(), key=repr) == sorted((r for r in docs.collect() if r.doc_id is None or r.doc_id >= 60 or r.text == "other text"), key=repr)
    assert drop_rows(ws, docs, gone_rows(docs, "false"), "doc_id", "text").count() == 202


def test_pages_grow_with_the_keys(spark, ws):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("k"))
    found = common.pages(ws, keys, "k")
    assert found.bits == 23 and found.rows.count() == 1 << 11
    flagged = common.in_pages(spark.range(400_000).select("id", F.xxhash64("id").alias("k")), "k", found, "maybe")
    assert flagged.where("id < 300000 AND NOT maybe").count() == 0
    assert flagged.where("id >= 300000 AND maybe").count() < 6000


def test_no_text_is_shuffled_with_many_rows_to_drop(spark, ws, tmp_path, monkeypatch):
    """With ten million rows to drop assumed, the filter is still a broadcast; no exchange by key is left where none is hit by accident."""
    spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    dropped = ws.save(gone_rows(docs, "doc_id % 3 = 0"))
    real = type(dropped).count
    monkeypatch.setattr(type(dropped), "count", lambda self: 10_000_000 if "row" in self.columns and "id" in self.columns else real(self))
    out = drop_rows(ws, docs, dropped, "doc_id", "text")
    monkeypatch.undo()
    assert out.count() == 666
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts():
    """Chains, a large group of copies with different changes, short texts, and unrelated ones."""
    rng, rows = random.Random(5), []
    base = prose(10, 120).split()
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append(" ".join(words))
    for k in range(20):  # each is near the next, the ends are far apart
        rows.append(prose(11, 400)[k * 40:])
    rows += [prose(100 + k, 5 + k) for k in range(40)]
    rows += ["One two three", "one TWO three", "one two", "", "   ", "only", "ONLY", "É É É É É", "é é é é é"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, ws, width):
    rows = near_texts()
    docs = make(spark, [(i, t, "en") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(ws, docs, shingle=width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, width).items()}


def test_pairs_inside_a_large_family_that_does_not_link(spark, ws):
    """Forms with seven fields are similar at 0.75 and share large buckets; those with two equal fields, at 0.82, must all be found."""
    base, texts = prose(12, 200).split(), []
    for k in range(1000):
        words = list(base)
        for field in range(7):
            words[15 + 28 * field] = f"w{k - 900 if k >= 900 and field in (k % 7, (k + 3) % 7) else k}x{field}"
        texts.append((k, " ".join(words), "en"))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(ws, make(spark, texts), shingle=4).collect()}
    assert got == {k: k - 900 if k >= 900 else k for k in range(1000)}


def test_near_duplicates_on_all_edge_cases(spark, ws, edges):
    rows = near_dup.near_duplicates(ws, edges, shingle=4).collect()
    assert len(rows) == len(edge_rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (12, 13, 14) for r in by_id[i]} == {12}
    assert {r.component_id for i in (4, 5) for r in by_id[i]} == {4}
    assert all(r.kept and r.n_shingles == 0 for i in (1, 2, 3) for r in by_id[i])
    assert all(r.kept for i in (7, 11) for r in by_id[i])
    assert sorted((r.n_shingles, r.component_id) for r in by_id[None]) == [(0, None), (1, None)]


def test_densified_bins_agree_as_often_as_the_sets_do():
    rng, donors = np.random.default_rng(1), near_dup._donors(150)
    for size, shared in ((400, 320), (12, 10)):
        agree = []
        for _ in range(300):
            common = rng.integers(0, 2 ** 64, shared, np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2 ** 64, (size - shared) // 2, np.uint64)])) for _ in range(2))
            agree.append((near_dup.signature(a, 150, donors) == near_dup.signature(b, 150, donors)).mean())
        truth = shared / (shared + 2 * ((size - shared) // 2))
        assert abs(np.mean(agree) - truth) < 0.03


def test_components_of_paths_and_stars(spark, ws):
    rng = random.Random(3)
    names = [f"{rng.random():.12f}" for _ in range(400)]
    links = [(names[k], names[k + 1]) for k in range(200)] + [(names[250], names[k]) for k in range(251, 400)]
    got = {r.node: r.root for r in components(ws, spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 201 + 150
    assert len({got[n] for n in names[:201]}) == 1 and len({got[n] for n in names[250:400]}) == 1 and len(set(got.values())) == 2
    assert all(got[root] == root for root in got.values())


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from sourceloom.llm import words

    texts = [prose(k, n) for k, n in enumerate((0, 1, 400, 3, 0, 90))] + ["x" * 300, ""]
    column = pa.array(texts)
    whole = word_hashes(*words.text_bytes(column))
    monkeypatch.setattr(words, "BLOCK", 64)
    cut = word_hashes(*words.text_bytes(column))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert list(np.diff(whole[1])) == [len(t.split()) for t in texts]
    assert len(set(whole[0].tolist())) == len({w.translate(LOWER) for t in texts for w in t.split()})
