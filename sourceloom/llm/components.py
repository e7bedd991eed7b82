"""Connected components by contraction; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import Workspace


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b); nodes of one component share a root, which is one of them.

    Each level maps a node to the least node of its neighbourhood and replaces links by links between these.  A star is
    gone after one level; with nodes in random order, the rest shrinks by a constant factor at each.  A hub's
    neighbours are reduced before the shuffle, and the joins may be split where one node has many links.
    """
    levels, rows = [], 1
    while rows:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = ws.save(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        levels.append(level)
        named = lambda end: level.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}"))
        moved = links.join(named("a"), "a").join(named("b"), "b").where("to_a <> to_b")
        pair = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        links, seen = ws.save_counted(pair)
        rows = seen["rows"] or 0
    roots = levels.pop()
    while levels:
        below = levels.pop()
        above = roots.select(F.col("node").alias("up"), F.col("root").alias("above"))
        roots = below.join(above, below.root == F.col("up"), "left").select("node", F.coalesce("above", "root").alias("root"))
    return roots
