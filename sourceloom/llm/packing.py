"""Packing token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  The program asks for the fewest
configurations that hold every length as often as the histogram has it.  It is solved on the driver over
the histogram alone (at most ``capacity`` rows): multiplicative weights price the lengths, a knapsack
dynamic program finds the most valuable configuration around each length, coverage lowers a
length's weight.  The fractional solution is rounded to whole multiplicities that never exceed
the histogram, and what remains is packed by best fit, again on the histogram.

Pieces meet the plan without any pass through the driver: each gets its rank among the pieces of its
length (counted inside its task, offset by one row per task and length), and ranks map to
places by ranges.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.llm.bpe import Vocabulary, proven_vocabulary, read_vocabulary
from sourceloom.llm.common import share, share_made
from sourceloom.session import Workspace

CAPACITY = 2048
ROUNDS = 24
STEP = 0.1


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: greatest value within c tokens; last[c]: index of a length in such a set, -1 for none."""
    by_length, index = np.full(capacity + 1, -1.0), np.full(capacity + 1, -1)
    by_length[lengths], index[lengths] = values, np.arange(len(lengths))
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(lengths.min())
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if c < smallest:
            continue
        got = by_length[smallest:c + 1] + best[c - smallest::-1][: c + 1 - smallest]
        k = int(got.argmax())
        if got[k] > best[c] + 1e-12:
            best[c], last[c] = got[k], index[k + smallest]
    return best, last


def _fill(lengths: np.ndarray, best: np.ndarray, last: np.ndarray, room: np.ndarray) -> list[list[int]]:
    """Indexes of the lengths in the best set within each room."""
    sets: list[list[int]] = [[] for _ in room]
    back = np.arange(len(best))
    for c in range(1, len(best)):
        if last[c] < 0:
            back[c] = back[c - 1]
    for i, c in enumerate(room):
        c = int(back[c])
        while last[c] >= 0:
            sets[i].append(int(last[c]))
            c = int(back[c - lengths[last[c]]])
    return sets


def configuration_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """[(length -> copies, number of such sequences)], holding each length exactly as often as given.

    The rounded program, unless best fit from the start needs fewer sequences (it may, on small histograms).
    """
    return min((_rounded(histogram, capacity, r) for r in (rounds, 0)), key=lambda plan: sum(times for _, times in plan))


def _rounded(histogram: dict[int, int], capacity: int, rounds: int) -> list[tuple[dict[int, int], int]]:
    left = {n: k for n, k in histogram.items() if k > 0}
    plan: list[tuple[dict[int, int], int]] = []
    if left.pop(capacity, 0):
        plan.append(({capacity: 1}, histogram[capacity]))
    if not left:
        return plan
    lengths = np.array(sorted(left))
    counts = np.array([left[n] for n in lengths], float)
    weights, mix = np.ones(len(lengths)), {}
    for turn in range(rounds):
        best, last = _knapsack(lengths, lengths / capacity * weights, capacity)
        covered, filled = np.zeros(len(lengths)), _fill(lengths, best, last, capacity - lengths)
        for anchor in range(len(lengths) - 1, -1, -1):  # what larger lengths leave uncovered needs sequences of its own
            mass = counts[anchor] - covered[anchor]
            if mass > 0:
                config = tuple(sorted([anchor, *filled[anchor]]))
                mix[config] = mix.get(config, 0.0) + mass / rounds
                for i in config:
                    covered[i] += mass
        weights *= np.exp(STEP / np.sqrt(1 + turn) * np.clip(1 - covered / counts, -1, 1))
        weights = np.clip(weights / weights.mean(), 1e-3, 1e3)

    remaining = {i: int(k) for i, k in enumerate(counts)}

    def take(copies: dict[int, int], most: int) -> None:
        times = min([most, *(remaining[i] // k for i, k in copies.items())])
        if times > 0:
            for i, k in copies.items():
                remaining[i] -= k * times
            plan.append(({int(lengths[i]): k for i, k in copies.items()}, times))

    def counted(config) -> dict[int, int]:
        copies: dict[int, int] = {}
        for i in config:
            copies[i] = copies.get(i, 0) + 1
        return copies

    size = {config: int(lengths[list(config)].sum()) for config in mix}
    ordered = sorted(mix, key=lambda c: (-size[c], -mix[c], c))
    for config in ordered:  # rounding down
        take(counted(config), int(mix[config]))
    open_lengths = [i for i in range(len(lengths)) if remaining[i]]
    while open_lengths:  # best fit, largest first; each step uses up at least one length
        room, copies = capacity, {}
        places = [int(lengths[i]) for i in open_lengths]
        at = len(places) - 1
        while at >= 0:
            i = open_lengths[at]
            k = min(remaining[i], room // places[at])
            if k:
                copies[i] = k
                room -= k * places[at]
            at = min(at - 1, bisect_right(places, room) - 1)
        take(copies, max(remaining.values()))
        open_lengths = [i for i in open_lengths if remaining[i]]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks: (length << 40 | first rank), first sequence, copies, offset, sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, times in plan:
        offset = 0
        for length in sorted(copies, reverse=True):
            k, first = copies[length], taken.get(length, 0)
            rows.append((length << 40 | first, sequence, k, offset))
            taken[length] = first + k * times
            offset += k * length
        sequence += times
    rows.sort()
    return tuple(np.array(column, np.int64) for column in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def worker_vocabulary(spark: SparkSession, path: str) -> Callable:
    """The vocabulary of a file, parsed and proven by a task; the driver only reads the file and passes on what the task has packed."""
    return share_made(spark, proven_vocabulary, read_vocabulary(path))


def token_pieces(docs: DataFrame, vocabulary: Vocabulary | Callable, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of tokenised texts, each text followed by ``end_id``; only longer ones are cut, the first piece may be shorter.

    ``vocabulary`` is one, or the shared form of one, which the driver need not hold (see ``worker_vocabulary``).
    """
    shared = vocabulary if callable(vocabulary) else share(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids

    def cut(batches):
        encoder, part, seen = shared(), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids_of, out = batch.column(0), [[] for _ in names]
            for row, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = capacity if start else (total - 1) % capacity + 1
                    blob = ids[4 * start:4 * (start + length)]
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    for column, value in zip(out, (row, piece, start, length, zlib.crc32(blob), part, rank, blob)):
                        column.append(value)
                    start, piece = start + length, piece + 1
            arrays = [ids_of.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in out[2:7]), *(pa.array(c, pa.binary()) for c in out[7:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint"
    return rows.mapInArrow(cut, schema + ", ids binary" * keep_ids)


def pack(ws: Workspace, docs: DataFrame, vocabulary: Vocabulary | Callable, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null text counts as empty: one piece that is the end token alone.  Null ids and repeated rows are packed
    as rows of their own.  Pieces of one length are exchangeable, so which of them gets which place is
    free.  Other columns are not read.  An empty table gives an empty result.
    """
    pieces = ws.save(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id, keep_ids))
    per_task = ws.save(pieces.groupBy("part", "length").count())
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = share(docs.sparkSession, _places(configuration_plan(histogram, capacity)))
    # one row per task and length
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(per_task.select("part", "length", before.alias("before")), ["part", "length"])
    extra = ["ids"] * keep_ids
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *extra)

    def place(batches):
        keys, sequences, copies, offsets = places()
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            nth = rank - (keys[at] & ((1 << 40) - 1))
            arrays = [*(batch.column(i) for i in range(5)), pa.array(sequences[at] + nth // copies[at]),
                      pa.array(offsets[at] + nth % copies[at] * length), *(batch.column(6 + i) for i in range(len(extra)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra])

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema + ", ids binary" * keep_ids).withColumnRenamed("id", id_col)
