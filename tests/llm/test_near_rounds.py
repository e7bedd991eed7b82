"""Candidates of near duplicates: what is asked, how often, and on which sets."""

import pytest
from pyspark.sql import functions as F

from sourceloom.llm import near_dup

from .conftest import make, prose


def pairs_of(spark, links):
    return spark.createDataFrame([(a, b) for a, b in links], "a binary, b binary")


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_confirmed_links_are_those_of_the_whole_sets(spark, ws, percent):
    words = prose(5, 400).split()
    texts = [" ".join(words[k:k + 300]) for k in range(0, 100, 5)] + [prose(900 + k, 200) for k in range(10)] + ["a b", "a b c d e f"]
    sets = ws.save(near_dup.full_sets(make(spark, [(k, t, "en") for k, t in enumerate(texts)]), "doc_id", "text", 5))
    held = {bytes(r.key): (set(r.shingles), r.n, sum(r.counts)) for r in sets.collect()}
    assert all(len(s) == n == c for s, n, c in held.values())
    every = [(a, b) for a in held for b in held if a < b]
    links, found, asked = near_dup.confirmed(ws, pairs_of(spark, every), sets, percent)
    alike = {(a, b) for a, b in every if 100 * len(held[a][0] & held[b][0]) >= percent * len(held[a][0] | held[b][0])}
    assert {(bytes(r.a), bytes(r.b)) for r in links.collect()} == alike and (found, asked) == (len(alike), len(every))


def test_only_sets_of_pairs_with_room_are_shuffled(spark, ws, monkeypatch):
    sets = ws.save(near_dup.full_sets(make(spark, [(k, prose(k, 300), "en") for k in range(200)]), "doc_id", "text", 5))
    keys = sorted(bytes(r.key) for r in sets.collect())
    read, among = [], near_dup.among

    def counted(*args):
        out = among(*args)
        read.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "among", counted)
    assert near_dup.confirmed(ws, pairs_of(spark, list(zip(keys, keys[1:]))), sets, 80)[1:] == (0, 199)
    assert len(read) == 2 and max(read) < 10


def test_buckets_of_two_meet_once(spark, ws, monkeypatch):
    rows = []
    for k in range(30):  # each pair of texts is alike in part only, and alone in its buckets
        words = prose(k, 200).split()
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(words[:150] + prose(500 + k, 40).split()), "en")]
    asked, confirmed = [], near_dup.confirmed

    def noted(*args):
        out = confirmed(*args)
        asked.append(out[2])
        return out

    monkeypatch.setattr(near_dup, "confirmed", noted)
    got = near_dup.near_duplicates(ws, make(spark, rows)).where(F.col("component_id") != F.col("doc_id")).count()
    assert got == 0 and asked[0] > 10 and not any(asked[1:])
