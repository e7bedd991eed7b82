"""Components of the Jaccard join against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sourceloom.llm import jaccard_join as J

from .conftest import edge_rows, make, prose


def grams(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = [(i, grams(t, width)) for i, t in rows]
    distinct = list({s for _, s in sets if s})
    up = {s: s for s in distinct}

    def top(s):
        while up[s] is not s:
            s = up[s]
        return s

    for a, b in combinations(sorted(distinct, key=len), 2):
        if len(a) * 100 >= len(b) * percent:
            common = len(a & b)
            if common * 100 >= (len(a) + len(b) - common) * percent:
                up[top(a)] = top(b)
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[top(s)] = min(i, least.get(top(s), i))
    return sorted(((i, len(s), least.get(top(s)) if s else i) for i, s in sets), key=repr)


def got(ws, docs, width, percent):
    return sorted((tuple(r) for r in J.jaccard_components(ws, docs, shingle=width, percent=percent).collect()), key=repr)


def corpus():
    """Copies, near copies at many distances, chains, subsets of shared passages, a frequent line, very short texts."""
    rng = random.Random(11)
    base = prose(50, 300).split()
    rows = [(100 + k, " ".join(w if rng.random() > k / 1500 else "edit" + str(rng.random()) for w in base)) for k in range(60)]
    chain = prose(51, 200).split()
    for k in range(15):  # neighbours are alike, the ends are not
        chain = chain[4:] + [f"link{k}x{j}" for j in range(4)]
        rows.append((200 + k, " ".join(chain)))
    passages = [prose(60 + k, 25) for k in range(20)]
    for k in range(40):
        rows.append((300 + k, " ".join(passages[j] for j in sorted(rng.sample(range(20), 17)))))
    rows += [(400 + k, "a frequent line stands here again " * 2 + prose(90 + k % 9, 30)) for k in range(40)]
    rows += [(500 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))) for k in range(40)]
    return rows + [(i, t) for i, t, _ in edge_rows() if i is not None and i not in (11,)]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, ws, width, percent):
    rows = corpus()
    docs = make(spark, [(i, t, "en") for i, t in rows])
    assert got(ws, docs, width, percent) == brute(rows, width, percent)


def test_lists_in_blocks_and_no_rounds_of_single_members(spark, ws, monkeypatch):
    """The exact part alone finds every link, also when lists are cut into small blocks."""
    monkeypatch.setattr(J, "LIST_BLOCK", 3)
    monkeypatch.setattr(J, "FEW_LINKS", 0)
    monkeypatch.setattr(J._Join, "links", skip_first(J._Join.links))
    rows = [r for r in corpus() if r[0] < 300 or r[0] >= 400]
    assert got(ws, make(spark, [(i, t, "en") for i, t in rows]), 3, 90) == brute(rows, 3, 90)


def skip_first(links):
    calls = []

    def later(self, pairs):
        calls.append(1)
        return links(self, pairs.limit(0) if len(calls) == 1 else pairs)

    return later


def test_null_ids_ties_and_empty_tables(spark, ws, nothing):
    assert J.jaccard_components(ws, nothing).count() == 0
    rows = [(None, "a b c d e f", "en"), (4, "a b c d e f", "en"), (4, "a b c d e f", "en"), (9, None, "en"), (8, " \t", "en"), (None, "alone in here", "en")]
    assert got(ws, make(spark, rows), 3, 90) == sorted([(None, 4, 4), (4, 4, 4), (4, 4, 4), (9, 0, 9), (8, 0, 8), (None, 1, None)], key=repr)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_prefixes_share_as_many_as_the_level_asks(percent):
    """The lemma that the join rests on, for random sets at and above the similarity in a random order."""
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        m = int(rng.integers(n, n * 100 // percent + 1))
        least = int(J.need(n, m, percent))
        if least > n:
            continue
        common = int(rng.integers(least, n + 1))
        order = rng.permutation(n + m - common)
        a, b = np.sort(order[:n]), np.sort(np.concatenate([order[:common], order[n:]]))
        for level in J.LEVELS:
            if level <= J.need(n, n, percent):
                tried += 1
                assert n - least + level <= n - J.need(n, n, percent) + level
                assert m - least + level <= J.longest_prefix(m, percent, level)
                assert len(np.intersect1d(a[:n - least + level], b[:m - least + level])) >= level
    assert tried > 1000


def test_counts_cover_every_shingle(spark, edges):
    from sourceloom.llm.near_dup import shingle_sets

    total = J.frequencies(J.counted_sets(edges, "doc_id", "text", 3))
    sets = shingle_sets(pa.array([t for _, t, _ in edge_rows()]), 3)
    assert total.sum() == sum(map(len, sets))
