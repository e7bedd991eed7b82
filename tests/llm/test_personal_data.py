"""Base spans against the plain patterns, and what the trees add."""

import random
import re

import numpy as np

from sourceloom.llm import boosting, personal_data

from .conftest import edge_rows, make, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_plain_patterns(spark, ws):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@x.y", ".", "_", "%", "-", "+", "1", "255", "256", "4111111111111111", " ", "  ", "(", ")", "é", "\U0001F600", "0",
            "1.2.3.4", "+49 30 1234567", "5500-0000-0000-0004", "me@site.org", "\n", "007", "@@"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40))), "en") for i in range(600)]
    got = {r.doc_id: r.base for r in personal_data.personal_data(ws, make(spark, rows)).select("doc_id", personal_data.listed("base").alias("base")).collect()}
    assert got == {i: plain_spans(t) for i, t, _ in rows}


def test_long_runs_take_linear_time(spark, ws):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 100_000, "+1" * 100_000, "a." * 100_000 + "@", "a@" + "b." * 50_000 + "c"]
    rows = personal_data.personal_data(ws, make(spark, [(i, t, "en") for i, t in enumerate(texts)])).select(
        "doc_id", personal_data.listed("base").alias("base")).collect()
    assert {r.doc_id: r.base for r in rows if r.base} == {6: f"email:0:{len(texts[6])}", 3: plain_spans(texts[3])}


def test_edge_cases(ws, edges, nothing):
    rows = personal_data.personal_data(ws, edges).select("doc_id", personal_data.listed("base").alias("base")).collect()
    assert sorted((repr(r.doc_id), r.base) for r in rows) == sorted((repr(i), plain_spans(t)) for i, t, _ in edge_rows())
    assert personal_data.personal_data(ws, nothing).count() == 0


def test_trees_add_loose_spellings_and_spare_other_numbers(spark, ws):
    rng, rows = random.Random(2), []
    for i in range(400):
        text = prose(i, 30)
        text += [f" mail u{i}@mail.example.com or", f" write u{i} [at] mail.example.com to", f" call +1 (212) 555-{1000 + i} in", f" on 10.20.{i % 256}.7 as",
                 f" in {1900 + i % 100} with {rng.randrange(10 ** 6)} parts", f" key 300.20.{i % 256}.7 is"][i % 6] + " " + prose(i + 5000, 10)
        rows.append((i, text, "en"))
    got = personal_data.personal_data(ws, make(spark, rows)).collect()
    added = {r.doc_id: [s.span for s in r.spans if s not in r.base] for r in got}
    assert all(set(r.base) <= set(r.spans) for r in got)
    assert all(not v for i, v in added.items() if i % 6 in (0, 2, 3, 4))
    hit = [bool(v) for i, v in added.items() if i % 6 == 1]
    assert sum(hit) in (0, len(hit))  # equal features stand or fall together


def test_respelled_phones_and_emails_are_added(spark, ws):
    rng, rows = random.Random(4), []
    for i in range(600):
        text = [f" mail u{i}@mail.example.com or", f" write u{i} [at] a.b.c.d.example.com to", f" call +1 (212) 555-{1000 + i} in",
                f" call 212-555-{1000 + i} in", f" in {1900 + i % 100} with {rng.randrange(10 ** 6)} parts", f" call +1 212-555-{1000 + i} in"][i % 6]
        rows.append((i, prose(i, 30) + text + " " + prose(i + 5000, 10), "en"))
    got = personal_data.personal_data(ws, make(spark, rows)).collect()
    added = {r.doc_id: [s.span for s in r.spans if s not in r.base] for r in got}
    assert added == {i: [f"u{i} [at] a.b.c.d.example.com"] if i % 6 == 1 else [f"212-555-{1000 + i}"] if i % 6 == 3 else [] for i in range(600)}


def test_boosting_separates_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (500, 4)).astype(float)
    total = rng.integers(1, 20, 500).astype(float)
    positive = np.where((x[:, 0] > 1) & (x[:, 1] <= 1), total, 0)
    model = boosting.fit(x, positive, total)
    scores = boosting.score_rows(x, *model)
    cut = boosting.threshold(scores, positive, total, 1.0)
    assert ((scores >= cut) == (positive > 0)).all()
    assert boosting.threshold(scores, 0 * positive, total, 0.9) == float("inf")


def test_scores_of_columns_and_rows_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 3)).astype(float)
    model = boosting.fit(x, (x[:, 0] + x[:, 2] > 2) * 2.0, np.full(60, 2.0), trees=5)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(boosting.score([F.col(c) for c in "abc"], *model)).collect()]
    assert np.allclose(got, boosting.score_rows(x, *model))
