"""Ordered differences between two versions of a file: which lines went, came or moved, and where.

A file's two line lists are compared inside its row.  Lines found exactly once on each side are anchors: the longest run of them that is in order on
both sides (an increasing subsequence) is common ground and cuts both lists into pieces, which are compared alone, again by lines that are
unique within the piece.  A piece without such lines is compared exactly by its equal pairs (a longest increasing subsequence over all of them, which is a
longest common subsequence) while these are few; pairs that are too many, of lines repeated very often, are met in order of occurrence.
A small file has few pairs and is compared exactly as a whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_PAIRS = 50_000  # equal pairs of lines that one exact comparison may have
BLOCK_ROWS = 20_000  # changed lines in one batch


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common_lines(old: list, new: list, exact_pairs: int = EXACT_PAIRS) -> list[tuple[int, int]]:
    """(place in old, place in new) of lines that both have in the same order; as many as possible where few lines are repeated."""
    found, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        counts, others = Counter(old[a:b]), Counter(new[c:d])
        pairs = sum(n * others[line] for line, n in counts.items() if line in others)
        if not pairs:
            continue
        if pairs <= exact_pairs:
            places = defaultdict(list)
            for j in range(c, d):
                places[new[j]].append(j)
            # a line's places in falling order, so that no two of them are both taken
            matched = [(i, j) for i in range(a, b) for j in reversed(places.get(old[i], ()))]
            found += [matched[k] for k in increasing([j for _, j in matched])]
            continue
        once = {new[j]: j for j in range(c, d) if others[new[j]] == 1 and counts.get(new[j]) == 1}
        anchors = [(i, once[old[i]]) for i in range(a, b) if old[i] in once]
        if not anchors:  # every k-th occurrence meets the k-th of the other side
            places, seen = defaultdict(list), Counter()
            for j in range(c, d):
                places[new[j]].append(j)
            matched = []
            for i in range(a, b):
                k = seen[old[i]]
                seen[old[i]] += 1
                if k < len(places.get(old[i], ())):
                    matched.append((i, places[old[i]][k]))
            found += [matched[k] for k in increasing([j for _, j in matched])]
            continue
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


def changed_lines(old: list[str], new: list[str], exact_pairs: int = EXACT_PAIRS) -> list[tuple[str, int, str, int | None]]:
    """(side, line from 1, text, line on the other side if it moved) of every line that is not common ground.

    A line that went and came elsewhere has moved: the first that went with the first that came, and so on.
    """
    common = common_lines(old, new, exact_pairs)
    stay_old, stay_new = {i for i, _ in common}, {j for _, j in common}
    went = [i for i in range(len(old)) if i not in stay_old]
    came = [j for j in range(len(new)) if j not in stay_new]
    waiting = defaultdict(list)
    for j in reversed(came):
        waiting[new[j]].append(j)
    to = {i: waiting[old[i]].pop() for i in went if waiting.get(old[i])}
    back = {j: i for i, j in to.items()}
    return ([("old", i + 1, old[i], to[i] + 1 if i in to else None) for i in went]
            + [("new", j + 1, new[j], back[j] + 1 if j in back else None) for j in came])


def ordered_line_diff(migrated: DataFrame, exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """Per changed line: repo, path, side (old, new), line, text, moved_to (its line on the other side, null if it did not move).

    Null contents count as empty.  Lines end where Python's ``splitlines`` ends them, and differ if their ends do.  A file without changes has no rows.  Texts are not shuffled; a task holds one file at a time.
    """
    rows = migrated.select("repo", F.col("original_path").alias("path"), "original_content", "migrated_content")

    def compare(batches):
        names = ["repo", "path", "side", "line", "text", "moved_to"]
        for batch in batches:
            for repo, path, old, new in zip(*(c for c in batch.columns)):
                changes = changed_lines((old.as_py() or "").splitlines(keepends=True), (new.as_py() or "").splitlines(keepends=True), exact_pairs)
                for at in range(0, len(changes), BLOCK_ROWS):
                    side, line, text, moved = zip(*changes[at:at + BLOCK_ROWS])
                    n = len(side)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([repo.as_py()] * n, pa.string()), pa.array([path.as_py()] * n, pa.string()), pa.array(side),
                         pa.array(line, pa.int64()), pa.array(text), pa.array(moved, pa.int64())], names=names)

    return rows.mapInArrow(compare, "repo string, path string, side string, line bigint, text string, moved_to bigint")


def ordered_diff_stats(migrated: DataFrame, changes: DataFrame) -> DataFrame:
    """Per file: repo, path, lines_added, lines_removed, lines_moved, hunks (runs of adjacent changed lines of one side); zeros included."""
    # the first line of a run is one whose predecessor is unchanged; no window over a file's lines is needed
    run = changes.select("repo", "path", "side", (F.col("line") + 1).alias("line")).withColumn("follows", F.lit(True))
    marked = changes.join(run, ["repo", "path", "side", "line"], "left")
    counts = marked.groupBy("repo", "path").agg(
        F.count_if((F.col("side") == "new") & F.col("moved_to").isNull()).alias("lines_added"),
        F.count_if((F.col("side") == "old") & F.col("moved_to").isNull()).alias("lines_removed"),
        F.count_if((F.col("side") == "old") & F.col("moved_to").isNotNull()).alias("lines_moved"),
        F.count_if(F.col("follows").isNull()).alias("hunks"))
    files = migrated.select("repo", F.col("original_path").alias("path"))
    return files.join(counts, ["repo", "path"], "left").select(
        "repo", "path", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("lines_added", "lines_removed", "lines_moved", "hunks")])
