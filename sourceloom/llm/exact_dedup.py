"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass over the texts keeps 24 bytes a row.  Rows whose length is unique leave at once, rows whose
(length, prefix hash) is unique next.  What survives is passed to the second pass as a bitmap of fixed
size, and only rows that hit it have their full content hashed.  Texts are never shuffled: grouping
and joins move keys, with counts combined before the shuffle, and hot groups are split by the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import bit_table, in_bits
from sourceloom.session import Workspace

PREFIX_CHARS = 128


def exact_groups(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS, **extra: Column) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, and the ``extra`` columns (computed from the input row).

    Texts are equal when their bytes are; null counts as empty.  keep_id is the largest id among equal
    texts (null only if all their ids are null, and then all are kept), group_size their number of rows.  Repeated rows with one id
    each come out, with the same answer.  Other columns are not read unless ``extra`` does.  An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, prefix = F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix_chars))
    narrow = ws.save(docs.select(size.alias("size"), prefix.alias("prefix")))

    several = lambda df, *keys: df.groupBy(*keys).count().where(F.col("count") > 1).drop("count")
    sizes = several(narrow, "size").select(F.xxhash64("size").alias("key"))
    same_size = in_bits(narrow, F.xxhash64("size"), bit_table(sizes, "key")).where("_maybe")
    prefixes = several(same_size, "size", "prefix").select(F.xxhash64("size", "prefix").alias("key"))
    survivors = ws.save(bit_table(prefixes, "key"))

    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), prefix.alias("prefix"), text.alias("_text"),
                       *[c.alias(f"extra_{k}") for k, c in extra.items()])
    marked = in_bits(rows, F.xxhash64("size", "prefix"), survivors)
    # unique rows get a key of their own, so that they spread like the others in the join
    full = F.when(F.col("_maybe"), F.unhex(F.sha2(F.col("_text"), 256)))
    keyed = ws.save(marked.withColumn("full", full).drop("_text", "_maybe"))
    alike = keyed.where(F.col("full").isNotNull())
    groups = alike.groupBy("size", "prefix", "full").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = alike.join(groups, ["size", "prefix", "full"], "left")
    single = keyed.where(F.col("full").isNull()).withColumns({"top": F.col("id"), "n": F.lit(1).cast("bigint")})
    both = joined.select(*single.columns).union(single)
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top"))
    return both.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), *[F.col(f"extra_{k}").alias(k) for k in extra],
    )
