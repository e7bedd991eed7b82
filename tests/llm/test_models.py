"""Language and toxicity models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sourceloom.llm import language_id, toxicity
from sourceloom.llm.words import text_bytes

from .conftest import edge_rows, make, prose

ALPHABETS = {"aa": ("ka", "lo", "mi"), "bb": ("pra", "stu", "ñe"), "cc": ("zzi", "kst", "ло")}


def speech(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(3)) for _ in range(words))


def slow_bits(training, text):
    """Code length by the definition: dictionaries of contexts, method C, no exclusions."""
    followers = [defaultdict(Counter) for _ in range(language_id.ORDER + 1)]
    for t in training:
        data = bytes(language_id.ORDER) + t.encode()
        for i in range(language_id.ORDER, len(data)):
            for k in range(language_id.ORDER + 1):
                followers[k][data[i - k:i]][data[i]] += 1
    data, bits = bytes(language_id.ORDER) + text.encode(), 0.0
    for i in range(language_id.ORDER, len(data)):
        for k in range(language_id.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = followers[k].get(data[i - k:i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
    return bits


def models_of(training):
    by_lang = []
    for texts in training.values():
        grams, counts = np.unique(language_id._codes(*text_bytes(pa.array(texts))), return_counts=True)
        by_lang.append((grams, counts.astype(float)))
    return language_id.build(list(training), by_lang)


def test_code_lengths_are_exact(monkeypatch):
    training = {lang: [speech(lang, s, 20) for s in range(5)] for lang in ALPHABETS}
    texts = ["", "k", speech("aa", 99), speech("cc", 7) + " other?!", "日本", "\x00\x00k", speech("bb", 1, 300)]
    models = models_of(training)
    expected = np.array([[slow_bits(training[lang], t) for lang in training] for t in texts])
    for chunk in (language_id.CHUNK, 50):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert np.allclose(language_id.code_lengths(models, *text_bytes(pa.array(texts))), expected, rtol=1e-5)


def test_languages_are_told_apart(spark, nothing):
    rows = [(i, speech(lang, i), lang) for i in range(200) for lang in [list(ALPHABETS)[i % 3]]]
    docs = make(spark, rows)
    models = language_id.train(docs.where("doc_id < 100"), "lang", "text", "doc_id")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, models).collect()}
    assert all(got[i][0] == lang and 0.9 < got[i][1] <= 1 for i, _, lang in rows)
    assert language_id.train(nothing, "lang", "text", "doc_id") is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(nothing, models).count() == 0


def test_language_edge_cases(spark, edges):
    models = language_id.train(edges, "lang", "text", "doc_id")
    rows = language_id.identify(edges, models).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 16))
    assert by_id[10].lang_pred == "ja" and by_id[4].lang_pred == "en"


def labelled(spark, n):
    rows = [(i, prose(i, 50) + (f" vile{i % 4} grim{i % 3} foul{i % 5}" * (1 + i % 2) if i % 8 == 0 else ""), "en") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0), "x") for i in range(n // 2)] + [(1, None, "x"), (None, 1, "x"), (10 ** 6, 1, "x")], "doc_id bigint, toxic int, text string")
    return rows, make(spark, rows), labels


def test_toxic_texts_are_rejected_and_clean_ones_kept(spark):
    rows, docs, labels = labelled(spark, 1200)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    held_out = [i for i, _, _ in rows if i >= 600]
    assert sum(got[i].rejected == (i % 8 == 0) for i in held_out) >= 0.99 * len(held_out)
    assert all(got[i].p_toxic <= got[i].severity for i, _, _ in rows)
    left = toxicity.without_toxic(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {i for i in got if not got[i].rejected}


def slow_features(text):
    """Distinct words and heads of longer words, as text."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or ""))
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode() for w in words]
    return {("word", w) for w in words} | {("head", w[:toxicity.HEAD]) for w in words if len(w) > toxicity.HEAD}


def slow_likelihood(y, scores, thresholds, weight):
    """Weighted negative logarithm of P(grade = y), grade by grade."""
    total = 0.0
    for k, s, w in zip(y, scores, weight):
        above = [1.0] + [1 / (1 + math.exp(t - s)) for t in thresholds] + [0.0]  # P(grade >= 0), P(grade >= 1), ...
        total -= w * math.log(above[k] - above[k + 1])
    return total


def test_features_equal_words_and_heads(monkeypatch):
    texts = [t for _, t, _ in edge_rows()]
    for block in (1 << 20, 300):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        text, feature = toxicity.features(pa.array(texts))
        assert [int((text == i).sum()) for i in range(len(texts))] == [len(slow_features(t)) for t in texts]
        chosen = np.unique(feature)[::3]
        t, f = toxicity.features(pa.array(texts), chosen)
        keep = np.isin(feature, chosen)
        assert (t == text[keep]).all() and (f == feature[keep]).all()
    assert [len(x) for x in toxicity.features(pa.array(texts), np.zeros(0, np.int64))] == [0, 0]


def test_fit_finds_the_least_of_a_slow_likelihood():
    """Against likelihood and gradient by the definition: no step along any weight or threshold does better, for a one-norm that small."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    cols = [np.unique(np.concatenate([rng.integers(0, 6, 3), [6 + int(rng.random() < (0.8 if y_ else 0.3))]])) for y_ in y]
    rows, flat = np.repeat(np.arange(400), [len(c) for c in cols]), np.concatenate(cols)
    model = toxicity.fit(y, rows, flat, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    weights = dict(zip(model.used.tolist(), model.weights.tolist()))
    grade = toxicity.grades(y, rows, flat, np.arange(flat.max() + 1) < toxicity.DIMENSIONS // 2)

    def loss(w, thresholds):
        scores = [sum(w.get(int(c), 0.0) for c in cs) for cs in cols]
        return slow_likelihood(grade, scores, thresholds, np.ones(400)) + toxicity.ONE_NORM * sum(map(abs, w.values()))

    least = loss(weights, model.thresholds)
    for step in (-0.2, 0.2):
        for c in weights:
            assert loss({**weights, c: weights[c] + step}, model.thresholds) > least
        assert loss(weights, model.thresholds + step) > least
    # expected severity is the sum over grades of grade times probability
    p = model.probabilities(np.array([-1.0, 0.3, 4.0]))
    for row, s in zip(p, (-1.0, 0.3, 4.0)):
        above = [1.0] + [1 / (1 + math.exp(t - s)) for t in model.thresholds] + [0.0]
        assert math.isclose(row.sum(), sum(k * (above[k] - above[k + 1]) for k in range(len(above) - 1)), rel_tol=1e-9)


def test_thresholds_are_ordered_and_severity_grows():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 600)
    cols = [np.unique(np.concatenate([rng.integers(0, 50, 10), 1000 + rng.integers(0, 9, 4 * (y_ > 0)), 2000 + rng.integers(0, 30, 6 * (y_ > 1))])) for y_ in y]
    rows = np.repeat(np.arange(600), [len(c) for c in cols])
    model = toxicity.fit((y > 0).astype(int), rows, np.concatenate(cols), {0: int((y == 0).sum()), 1: int((y > 0).sum())})
    assert (np.diff(model.thresholds) >= 0).all()
    p = model.probabilities(np.array([-5.0, 0.0, 5.0, 30.0]))
    assert (np.diff(p, axis=0) >= 0).all() and (np.diff(p, axis=1) <= 0).all()


def test_toxicity_edge_cases(spark, edges, nothing):
    _, docs, labels = labelled(spark, 400)
    model = toxicity.train(docs, labels)
    assert toxicity.severity(edges, model).where("rejected").count() == 0
    assert toxicity.severity(edges, model).count() == len(edge_rows())
    assert toxicity.severity(nothing, model).count() == 0
    none = labels.where("toxic > 5")
    assert toxicity.train(docs, none) is None and toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.train(nothing, labels) is None
    assert toxicity.without_toxic(edges, None).count() == len(edge_rows())
