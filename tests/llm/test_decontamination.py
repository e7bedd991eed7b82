"""Decontamination and licence scans against brute force over words."""

import random
import re

import pytest

from sourceloom.llm import decontamination, license_scan

from .conftest import edge_rows, make, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    """(number of words, hit words, sorted ids of items that occur)."""
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(len(v), 10)
        windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, words string")


def test_against_brute_force(spark, ws):
    rng = random.Random(8)
    bench = [(k, prose(500 + k, 5 + 3 * k)) for k in range(12)] + [(20, "Two words"), (21, "solo"), (22, ""), (23, None), (24, prose(503, 14)), (25, "go " * 30)]
    rows = []
    for i in range(60):
        text = prose(600 + i, 60).split()
        item = (rng.choice(bench)[1] or "").split()
        at = rng.randrange(len(text))
        a = rng.randrange(len(item) + 1)
        text[at:at] = item[a:a + rng.choice((8, 9, 10, 11, 40))]
        if i % 7 == 0:
            text[at + 2:at + 2] = ["two", "WORDS,", "solo"]
        rows.append((i, " ".join(text).replace(" ", rng.choice((" ", ", ", "\n"))), "en"))
    rows += [(100, "go " * 500, "en"), (101, "", "en"), (102, None, "en"), (103, bench[5][1] * 2, "en"), (104, prose(502, 11), "en"), (105, "Solo", "en")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.n_items, r.contaminated)
           for r in decontamination.contamination(ws, make(spark, rows), items(spark, bench)).collect()}
    for i, text, _ in rows:
        n, hit, found = brute_hits(text, bench)
        assert got[i] == (n, hit, found, len(found.split(",")) if found else 0, hit > 0), i


def test_edge_cases_and_empty_tables(spark, ws, edges, nothing):
    bench = items(spark, [(1, prose(2, 60)), (None, "null id"), (3, "same ID")])
    rows = decontamination.contamination(ws, edges, bench).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.doc_id: (r.n_hit, r.item_ids) for r in rows if r.doc_id in (12, 13, 2)}
    n = len(words(prose(2, 60)))
    assert by_id == {12: (n, "1"), 13: (n, "1"), 2: (0, "")}
    assert sorted((r.n_hit, r.item_ids) for r in rows if r.doc_id is None) == [(0, ""), (2, "")]
    assert sorted(r.item_ids for r in rows if r.doc_id == 11) == ["", "3"]
    assert decontamination.contamination(ws, nothing, bench).count() == 0
    none = decontamination.contamination(ws, edges, items(spark, [])).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)


def contained(text, templates, percent=80):
    """Ids of templates of which one window holds enough distinct shingles."""
    w, out = words(text), []
    grams = lambda v: [tuple(v[k:k + 5]) for k in range(len(v) - 4)]
    for name, template in templates:
        wanted, span = set(grams(words(template))), 16
        while span < len(words(template)):
            span *= 2
        g = grams(w)
        if any(wanted and 100 * len(wanted & set(g[max(at, 0):at + 2 * span])) >= percent * len(wanted) for at in range(-span, len(g), span)):
            out.append(name)
    return ",".join(sorted(out))


def test_licences_against_brute_force(spark, ws):
    rng, rows = random.Random(4), []
    for i in range(80):
        text = prose(i, 90).split()
        notice = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.choice((0, 0, 1, 4))):
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randrange(len(text))
        text[at:at] = notice if i % 5 else notice[:len(notice) // 2]
        rows.append((i, " ".join(text), "en"))
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(ws, make(spark, rows)).collect()}
    assert got == {i: contained(t, license_scan.TEMPLATES) for i, t, _ in rows}
    assert any(got.values()) and not all(got.values())


def test_three_notices_in_one_window(spark, ws):
    notices = [(f"t{k}-{n}", prose(100 * k + n, n)) for k in range(40) for n in (5, 8, 12)]
    rows = [(k, " ".join(t for _, t in notices[3 * k:3 * k + 3]), "en") for k in range(40)]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(ws, make(spark, rows), templates=notices).collect()}
    assert got == {k: f"t{k}-12,t{k}-5,t{k}-8" for k in range(40)}


def test_licence_edge_cases(spark, ws, edges, nothing):
    rows = license_scan.license_scan(ws, edges).collect()
    assert len(rows) == len(edge_rows()) and not any(r.n_licenses for r in rows)
    assert license_scan.license_scan(ws, nothing).count() == 0
    assert not any(r.n_licenses for r in license_scan.license_scan(ws, edges, templates=[("short", "too few words")]).collect())
    twice = make(spark, [(1, "Released under the MIT License.", "en")] * 2 + [(None, "Licensed under CC BY-NC 4.0.", None)])
    assert sorted((r.doc_id or 0, r.licenses, r.best) for r in license_scan.license_scan(ws, twice).collect()) == [
        (0, "cc-by-nc-4.0", 100), (1, "mit-short", 100), (1, "mit-short", 100)]


@pytest.mark.parametrize("gram", [3, 5])
def test_fingerprints_meet_the_guarantee(spark, gram):
    """Every run of ten words has a fingerprint, so shared runs share one."""
    texts = [(k, prose(k, 40).split()) for k in range(30)] + [(31, ["a"] * 40)]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    for r in decontamination.fingerprints(df, [], gram).collect():
        marked = {m.pos for m in r.marks}
        assert all(marked & set(range(k, k + 10 - gram + 1)) for k in range(len(r.words) - 9))
