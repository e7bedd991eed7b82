"""The trie against brute force over whole sequences."""

import hashlib
import random
import re
import zlib

import pytest

from sourceloom.llm import prefix_trie
from sourceloom.llm.queries import op13_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, id int, shard string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def ordered_turns(rows):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in held.items()}


def rebuilt(held):
    out = {}
    for c, own in held.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = held.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, ids in members.items():
        under = [p for p in members if p[:len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        parents = {p[:-1] for p in members if p}
        saved = sum((len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p in under)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        out.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids),
                 sum(p not in parents for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def conversations(seed=3):
    """Common first turns, copies, prefixes of each other, long ones, gaps, nulls, ties, repeated rows, ids below zero."""
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 150):
        if c % 7 == 3:
            continue
        shared = rng.choice([0, 1, 2, 5])
        for k in range(rng.randrange(1, 7)):
            text = f"common {k} words" if k < shared else f"{rng.randrange(4)} own {k}"
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", text))
    for c in (200, 201, 202, 240, 241):  # long ones; the last turns differ
        rows += [(c, k, "user", f"long {k}" if k < 21 or c % 2 else f"long {k} {c}") for k in range(23)]
    rows += [(300 + c, k, "user", f"copied {k}") for c in range(40) for k in range(9)]
    rows += [(401, None, None, None), (401, None, "user", ""), (402, 5, "user", " \t"), (402, 5, "user", " \t"), (402, 5, "assistant", None),
             (403, 1, "us", "er x"), (404, 1, "user", " x"), (None, 1, "user", "nobody's"), (405, 1, "user", "w " * 5000)]
    return rows


@pytest.mark.parametrize("width, shard", [(32, 4000), (3, 11), (4, 1)])
def test_equals_brute_force(spark, ws, monkeypatch, width, shard):
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = conversations()
    turns, convs = prefix_trie.with_shared_heads(ws, prefix_trie.turn_rows(ws, table(spark, rows)))
    got = prefix_trie.prefix_trie(ws, turns, convs).collect()
    want = brute(rebuilt(ordered_turns(rows)))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plain_table_and_its_order(spark, ws):
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "b"), (3, 0, "other", "a")]
    turns = ws.save(prefix_trie.turn_rows(ws, table(spark, rows)))
    convs = turns.where("pos = 1").select("conv_id", "turns")
    assert {tuple(r) for r in prefix_trie.prefix_trie(ws, turns, convs).collect()} == brute(ordered_turns(rows))


def test_empty_table_and_turnless_conversations(spark, ws, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_prefix_trie(spark, str(tmp_path)).count() == 0
    # crc32 of these ids leaves one, two or three turns to a base that does not exist
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 21, 22)]
    assert any(not t for t in rebuilt(ordered_turns(rows)).values())
    turns, convs = prefix_trie.with_shared_heads(ws, prefix_trie.turn_rows(ws, table(spark, rows)))
    assert {tuple(r) for r in prefix_trie.prefix_trie(ws, turns, convs).collect()} == brute(rebuilt(ordered_turns(rows)))
