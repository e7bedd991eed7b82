"""Ordered line differences against an exact longest common subsequence."""

import random
import time

import pytest

from sourceloom.operators import line_diff as L

SCHEMA = "repo string, original_path string, original_content string, migrated_content string"


def longest_common(old, new):
    row = [0] * (len(new) + 1)
    for x in old:
        last = 0
        for j, y in enumerate(new, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(rng, lines):
    out = [x for x in lines if rng.random() > 0.15]
    for _ in range(rng.randrange(5)):
        out.insert(rng.randrange(len(out) + 1), f"new {rng.randrange(6)}")
    if len(out) > 6 and rng.random() < 0.5:  # a block moves
        a = rng.randrange(len(out) - 4)
        block, out = out[a:a + 3], out[:a] + out[a + 3:]
        b = rng.randrange(len(out) + 1)
        out[b:b] = block
    return out


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for kinds in (3, 8, 1000):
        for _ in range(150):
            old = [f"line {rng.randrange(kinds)}" for _ in range(rng.randrange(40))]
            new = edited(rng, old)
            found = L.common_lines(old, new)
            assert all(old[i] == new[j] for i, j in found)
            assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
            assert len(found) == longest_common(old, new)


@pytest.mark.parametrize("exact_pairs", [0, 5, 50])
def test_pieces_give_a_valid_difference_also_without_exact_comparison(exact_pairs):
    rng = random.Random(3)
    for _ in range(200):
        old = [f"line {rng.choice([rng.randrange(4), rng.randrange(1000)])}" for _ in range(rng.randrange(60))]
        new = edited(rng, old)
        found = L.common_lines(old, new, exact_pairs)
        assert all(old[i] == new[j] for i, j in found)
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
        # played back, the difference turns one version into the other
        changes = L.changed_lines(old, new, exact_pairs)
        gone = {line for side, line, _, _ in changes if side == "old"}
        came = {line: text for side, line, text, _ in changes if side == "new"}
        stay = iter(x for k, x in enumerate(old, 1) if k not in gone)
        assert [came[k] if k in came else next(stay) for k in range(1, len(new) + 1)] == new


def test_rows_of_a_table(spark):
    old = "a\nb\nmoved\nc\nd\ne"
    new = "a\nb\nc\nnew\nd\nmoved\ne\n"
    rows = [("r", "one", old, new), ("r", "same", "x\ny", "x\ny"), ("s", "one", None, "z\n"), ("s", "gone", "z\n", ""), ("s", None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    changes = L.ordered_line_diff(table)
    assert sorted(tuple(r) for r in changes.collect()) == sorted([
        ("r", "one", "old", 3, "moved\n", 6), ("r", "one", "old", 6, "e", None), ("r", "one", "new", 4, "new\n", None), ("r", "one", "new", 6, "moved\n", 3),
        ("r", "one", "new", 7, "e\n", None), ("s", "one", "new", 1, "z\n", None), ("s", "gone", "old", 1, "z\n", None)])
    stats = {(r.repo, r.path): tuple(r)[2:] for r in L.ordered_diff_stats(table, changes).collect()}
    assert stats == {("r", "one"): (2, 1, 1, 4), ("r", "same"): (0, 0, 0, 0), ("s", "one"): (1, 0, 0, 1), ("s", "gone"): (0, 1, 0, 1), ("s", None): (0, 0, 0, 0)}
    assert L.ordered_line_diff(table.limit(0)).count() == 0


def test_long_files_take_time_in_proportion():
    rng = random.Random(1)

    def seconds(n):
        old = [rng.choice(["", "}", "    return 0;", f"int v{k} = {rng.random()};"]) for k in range(n)]
        new = [x for k, x in enumerate(old) if k % 7] + ["tail"] * 50
        start = time.process_time()
        found = L.common_lines(old, new)
        assert len(found) == len(new) - 50
        return time.process_time() - start

    seconds(1000)
    short, long = seconds(20_000), seconds(80_000)  # about 1 MB
    assert long < 10 * short + 0.5
