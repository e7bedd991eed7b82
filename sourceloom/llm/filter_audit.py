"""How a chain of filters interacts: what each filter removes in every order of application.

Each document fails some of five filters.  Documents of a part are counted by the set of filters they fail, apart from
that by whether labels call them good or toxic; the 32 counts of a part are a 2x2x2x2x2 tensor, one axis a filter, index 1
for failing.  What a step of an order does is a contraction of that tensor: along every axis it takes those that pass, those that
fail, or all.  One ``einsum`` does this for all steps of all orders and for a block of parts.

Documents are read once.  What leaves the scan is a row of id, part, failed filters and digest; 32 counts a part are
all that the tensors need, however many documents there are.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.session import Workspace

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
PARTS_AT_ONCE = 64  # parts in one contraction: 600 rows each come out
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 50 words), B (under 65 percent of them distinct), C (over 5 percent A-Z), D (holds a mark)."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
            capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * MOST_CAPITALS, text.rlike(MARKS)]


def _place(fails: list[Column]) -> Column:
    """Number of a cell: the first filter is the highest of five bits; the last one is set later."""
    return sum((F.when(f, F.lit(1 << (len(FILTERS) - 1 - i))).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def _steps() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """(orders, filter of each step, selectors): selectors[what][step, axis] weighs the passing and the failing half of an axis."""
    passing, failing, both = (1, 0), (0, 1), (1, 1)
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = [(o, i) for o in orders for i in range(len(FILTERS))]
    rules = {
        "kept": lambda place, at: passing if place <= at else both,
        "removed": lambda place, at: failing if place == at else passing if place < at else both,
        "failing": lambda place, at: failing if place == at else both,
        "unique_fails": lambda place, at: failing if place == at else passing,
    }
    return orders, np.array([FILTERS.index(o[i]) for o, i in steps]), {
        what: np.array([[rule(o.index(f), i) for f in FILTERS] for o, i in steps], np.int64) for what, rule in rules.items()}


def contract(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by (part, step) from tensors[part, a, b, c, d, e, kind]; kinds: all, good and toxic documents."""
    _, filters, selectors = _steps()
    select = lambda what, t: np.einsum("pabcdek,sa,sb,sc,sd,se->psk", t, *np.moveaxis(selectors[what], 1, 0), optimize=True)
    removed, plain = select("removed", tensors), tensors[..., :1]
    out = {"removed": removed[..., 0], "good_lost": removed[..., 1], "toxic_lost": removed[..., 2]}
    out |= {what: select(what, plain)[..., 0] for what in ("kept", "unique_fails")}
    out["redundant"] = select("failing", plain)[..., 0] - out["removed"]
    of_filter = np.stack([out["removed"][:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return out | {"shapley": of_filter[:, filters]}


def filter_audit(ws: Workspace, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: counts of documents, see the module's text and ``COUNTS``.

    A null text counts as empty, a null part as the empty string.  E fails what equals the text of a smaller id, whatever the
    parts; rows of one id and text do not count against each other, and rows with a null id fail E never and have no labels.  An
    id with several labels is good (toxic) if one of them says so.  Every row counts, repeated ones too.  Other columns are not read.
    An empty table gives an empty result; parts without failures give rows of zeros.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = ws.save(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        _place(text_failures(text)).cast("int").alias("place"), F.unhex(F.sha2(text, 256)).alias("digest"),
    ).groupBy("id", "part", "place", "digest").agg(F.count(F.lit(1)).alias("n")))
    # the first of a text is met by (digest, id), so that a text with many copies makes no hot key
    first = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    known = facts.where("id IS NOT NULL").join(first, ["digest", "id"], "left")
    cells = known.groupBy("id", "part", (F.col("place") + later).alias("place")).agg(F.sum("n").alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = cells.join(marks, "id", "left").select(
        "part", "place", "n", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    nameless = facts.where("id IS NULL").select("part", "place", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counts = labelled.unionByName(nameless).groupBy("part", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # at most 32 rows a part
    tensors = counts.groupBy("part").agg(F.collect_list(F.struct("place", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(o) for o in permutations(FILTERS)]
    width = len(FILTERS)

    def contracted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                block = batch.slice(at, PARTS_AT_ONCE)
                lists = block.column(1)
                rows = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
                place, *kinds = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
                flat = np.zeros((block.num_rows, 1 << width, 3), np.int64)
                flat[rows, place] = np.stack(kinds, axis=1)
                found = contract(flat.reshape(block.num_rows, *[2] * width, 3))
                n = len(orders) * width
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(np.repeat(np.arange(block.num_rows), n))),
                     pa.array(np.repeat(orders, width).tolist() * block.num_rows),
                     pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(orders) * block.num_rows)),
                     *[pa.array(found[c].reshape(-1)) for c in COUNTS]],
                    names=["part", "filter_order", "step", *COUNTS])

    return tensors.mapInArrow(contracted, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
