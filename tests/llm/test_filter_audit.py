"""Counts of every step of every order against filters applied one by one."""

import random
import re
from itertools import permutations

import numpy as np

from sourceloom.llm import filter_audit

from .conftest import edge_rows, make, prose


def failures(docs):
    """Failed filters of each (id, text), one after the other."""
    out = []
    for i, text in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u in docs):
            fails.add("E")
        out.append(fails)
    return out


def brute(docs, parts, good, toxic):
    fails = failures(docs)
    out = {}
    for part in set(parts):
        rows = [k for k, p in enumerate(parts) if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = rows
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in fails[k]]
                earlier = [k for k in rows if k not in alive and f in fails[k]]
                alive = [k for k in alive if f not in fails[k]]
                removed_by[f] += len(gone)
                out[part, order, step] = [len(alive), len(gone), len(earlier), sum(fails[k] == {f} for k in rows),
                                          sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts():
    rng = random.Random(8)
    pieces = [prose(1, 40), prose(2, 80), "again " * 60, "LOUD WORDS " * 9, "# mark", prose(3, 60).upper(), "short", "", None, "Ünïcode É " * 30]
    docs = [(k, " ".join(filter(None, rng.sample(pieces, 2))) if k % 3 else rng.choice(pieces)) for k in range(120)]
    return docs + [(i, t) for i, t, _ in edge_rows()] + [(None, "null id"), (5, "elsewhere")]


def test_equals_filters_applied_one_by_one(spark, ws):
    docs = texts()
    parts = [("a", "b", None, "")[k % 4] for k in range(len(docs))]
    rows = [(i, t, p, "x", 3, "y") for (i, t), p in zip(docs, parts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, part string, place int, digest string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 2 == 0), int(k % 5 == 0)) for k in range(100)] + [(3, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    good = {k for k in range(100) if k % 2 == 0} | {3}
    toxic = {k for k in range(100) if k % 5 == 0} | {4}
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(ws, table, labels).collect()}
    assert got == brute(docs, [p or "" for p in parts], good, toxic)
    assert len(got) == 3 * 600


def test_empty_tables(ws, spark, nothing, edges):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(ws, nothing, labels).count() == 0
    rows = filter_audit.filter_audit(ws, edges, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {"s"} and not any(r.good_lost or r.toxic_lost for r in rows)


def test_contractions_of_any_tensor():
    rng = np.random.default_rng(4)
    tensors = rng.integers(0, 9, (3, 2, 2, 2, 2, 2, 3))
    found = filter_audit.contract(tensors)
    # the first step removes what fails it, whatever else; all orders together remove what fails anything
    orders = ["".join(o) for o in permutations("ABCDE")]
    for o, order in enumerate(orders):
        axis = "ABCDE".index(order[0])
        assert (found["removed"][:, 5 * o] == np.take(tensors[..., 0], 1, axis=axis + 1).sum(axis=(1, 2, 3, 4))).all()
        assert (found["removed"][:, 5 * o:5 * o + 5].sum(axis=1) == tensors[..., 0].sum(axis=(1, 2, 3, 4, 5)) - tensors[:, 0, 0, 0, 0, 0, 0]).all()
