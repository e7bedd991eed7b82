"""Positions, running totals and next values over long ordered groups.

A window function sends each group to one task, which fails when one group holds a third of
all rows.  Here rows are range-partitioned by (keys, order), so a long group spans as many
partitions as its size asks for.  Each (group, partition) piece is scanned on its own and the
pieces are tied together by a table of one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.session import Workspace

_PIECE, _SEQ = "_piece", "_seq"


def _pieces(ws: Workspace, df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # Range bounds come from a sample, so the cut is written down once and then read by all.
    by = [F.col(k) for k in keys] + order
    cut = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn(_PIECE, F.spark_partition_id())
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    return ws.save(cut)


def running_totals(
    ws: Workspace, df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column],
    wholes: dict[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Add inclusive running sums per group; ``F.lit(1)`` gives the position from 1.

    ``wholes`` adds aggregates over the whole group, each as the aggregate of a piece and the
    function that merges pieces, so that no row is ever joined on the group key alone.
    """
    wholes = wholes or {}
    inputs = {f"_in_{name}": value for name, value in totals.items()}
    cut = _pieces(ws, df.withColumns(inputs), keys, order)
    piece = [*keys, _PIECE]
    sums = cut.groupBy(*piece).agg(
        *[F.sum(f"_in_{n}").alias(f"_all_{n}") for n in totals],
        *[aggregate.alias(f"_part_{n}") for n, (aggregate, _) in wholes.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *piece,
        *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
        *[merge(f"_part_{n}").over(Window.partitionBy(*keys)).alias(n) for n, (_, merge) in wholes.items()],
    )
    upto = Window.partitionBy(*piece).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(
        *df.columns, _PIECE, *[F.sum(f"_in_{n}").over(upto).alias(f"_loc_{n}") for n in totals]
    )
    return local.join(offsets, piece).select(
        *df.columns, *[(F.col(f"_loc_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals], *wholes
    )


def positions(ws: Workspace, df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return running_totals(ws, df, keys, order, {name: F.lit(1)})


def next_value(
    ws: Workspace, df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Add the first non-null ``value`` among the rows that follow in the group."""
    cut = _pieces(ws, df.withColumn("_value", value), keys, order)
    piece = [*keys, _PIECE]
    heads = (
        cut.filter(F.col("_value").isNotNull()).groupBy(*piece).agg(F.min_by("_value", _SEQ).alias("_head"))
    )
    marks = cut.select(*piece).distinct().join(heads, piece, "left")
    # backwards, so that the frame grows by a row at a time: one that shrinks is gone through anew for every row
    later = Window.partitionBy(*keys).orderBy(F.col(_PIECE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*piece, F.last("_head", ignorenulls=True).over(later).alias("_later"))
    after = Window.partitionBy(*piece).orderBy(F.col(_SEQ).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        *df.columns, _PIECE, F.last("_value", ignorenulls=True).over(after).alias("_near")
    )
    return local.join(marks, piece).select(*df.columns, F.coalesce("_near", "_later").alias(name))


def first_rows(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows per group; each task keeps at most ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n)
