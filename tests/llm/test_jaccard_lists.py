"""Lists of the Jaccard join: two classes that cannot be alike leave none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import jaccard_join as J

from .conftest import make, prose


def test_lists_of_two_that_rule_the_similarity_out_are_dropped(spark, ws):
    rows = [(k, "one line in both " + prose(7 + k, 300 - 285 * (k == 1)), "en") for k in range(2)]  # sizes too far apart
    join = J._Join(ws, make(spark, rows), "doc_id", "text", 3, 90)
    assert join.listed().count() == 0
    alike = prose(3, 300)
    join = J._Join(ws, make(spark, [(1, alike, "en"), (2, alike + " more", "en")]), "doc_id", "text", 3, 90)
    assert join.listed().count() > 0


def test_members_of_short_lists_without_a_partner_are_dropped(spark, ws):
    """Three classes share a passage; two are alike, the third is too long for both."""
    alike = "one line in all " + prose(3, 60)
    rows = [(1, alike, "en"), (2, alike + " more", "en"), (3, "one line in all " + prose(4, 300), "en")]
    lists = J._Join(ws, make(spark, rows), "doc_id", "text", 3, 90).listed()
    assert {r.n for r in lists.collect()} == {62, 63} and {r["size"] for r in lists.collect()} == {2}


def test_a_family_made_from_one_text_leaves_no_pairs_to_the_exact_part(spark, ws, monkeypatch):
    """Each member is like the text it was made from, and like no other member: the first members to meet their lists must be that text."""
    left, remaining = [], J._remaining

    def counted(*args):
        pairs = remaining(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(J, "_remaining", counted)
    base = prose(21, 150).split()
    rows = [(100, " ".join(base), "en")]
    for k in range(40):
        words = list(base)
        words[3 + 3 * k] = f"one{k}"
        words[(60 + 3 * k) % 147 + 2] = f"two{k}"
        rows.append((k, " ".join(words), "en"))
    found = J.jaccard_components(ws, make(spark, rows), shingle=3, percent=90).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 41
    assert left == [0]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles(spark, percent):
    """Also where their lengths differ; and sets that have little in common are told apart."""
    rng, rows, strangers = np.random.default_rng(percent), [], []
    for n in [1, 2, 5, 15, 40, 64, 65, 120, 240, 300, 900, 2000]:
        for share in (1.0, percent / 100, 0.0):
            m = n * 100 // percent if share < 1 else n
            common = rng.integers(0, 2**64, int(n * share), np.uint64)
            a, b = (np.unique(np.append(common, rng.integers(0, 2**64, k - len(common), np.uint64))) for k in (n, m))
            rows.append((len(np.setxor1d(a, b)), J.sketch(a, percent).tolist(), J.sketch(b, percent).tolist()))
            if not share and n >= 40:
                strangers.append((len(rows) - 1, int(J.may_differ(len(a), len(b), percent))))
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, differ int, a array<bigint>, b array<bigint>")
    bits = {r.k: r.bits for r in made.select("k", J.differing("a", "b").alias("bits")).collect()}
    assert all(bits[k] <= differ and (differ or not bits[k]) for k, (differ, _, _) in enumerate(rows))
    if percent >= 80:
        assert all(bits[k] > most for k, most in strangers)


def test_pairs_that_cannot_be_alike_are_dropped_before_their_prefixes_and_sets_are_shuffled(spark, ws):
    """Sets of 298 shingles that share 260 in places that fit: the counts in 32 bins let all such pairs pass."""
    rows = []
    for k in range(6):
        words = prose(5, 300).split()
        words[180:200] = prose(50 + k, 20).split()
        rows.append((k, " ".join(words), "en"))
    join = J._Join(ws, make(spark, rows), "doc_id", "text", 3, 90)
    keys = join.first.select("key")
    pairs = ws.save(keys.select(F.col("key").alias("a")).crossJoin(keys.select(F.col("key").alias("b"))).where("a < b"))
    assert pairs.count() == 15 and join.possible(pairs).count() == 0


def test_texts_are_not_shuffled_to_find_one_of_each_class(spark, ws):
    """Only ids of classes with several rows meet; repeated rows and null ids come out once."""
    rows = [(k, prose(100 + k, 80), "en") for k in range(30)] + [(40, prose(100, 80), "en"), (3, prose(103, 80), "en"), (None, prose(7, 50), "en"), (None, prose(7, 50), "en")]
    join = J._Join(ws, make(spark, rows), "doc_id", "text", 3, 90)
    assert join.first.count() == join.first.select("key").distinct().count() == 31
    alone = []
    join.one_each(join.texts, lambda texts: alone.append(texts.count()) or J.whole_sets(texts, 3))
    assert alone == [28, 6]


def test_short_lists_give_the_pairs_that_may_meet_without_rounds(spark, ws):
    alike = prose(3, 60)
    rows = [(k, alike + " more" * k, "en") for k in range(3)] + [(9, prose(4, 60), "en")]
    join = J._Join(ws, make(spark, rows), "doc_id", "text", 3, 90)
    join.listed()
    assert join.long.count() == 0 and join.met_in_short().count() == 3
    found = J.jaccard_components(ws, make(spark, rows), shingle=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (2, 0), (9, 9)]
