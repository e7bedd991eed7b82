"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import DEFAULTS, Workspace, give_back

MOST_BITS = 28
BITS_PER_KEY = 16
FILTER_BITS = 22  # 2**22 bits: at most 65,536 rows of 16 bytes are broadcast, whatever the input
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession, batch_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Session settings that the operators' memory bounds rest on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def share(spark: SparkSession, thing) -> Callable:
    """Broadcast an object of bounded size; each worker process unpacks it once and keeps it.

    It travels by value, so that workers need no copy of this package.
    """
    return share_packed(spark, cloudpickle.dumps(thing))


def share_packed(spark: SparkSession, packed: bytes) -> Callable:
    """The same for an object that comes packed, and is not unpacked on the driver."""
    sent = spark.sparkContext.broadcast({"packed": packed})

    def get():
        held = sent.value
        if "live" not in held:
            held["live"] = pickle.loads(held.pop("packed"))
        return held["live"]

    return get


def share_made(spark: SparkSession, make: Callable, *args) -> Callable:
    """The same for an object of bounded size that a task makes of ``args``; the driver passes its packed form on and never holds it."""

    def packed(values):
        out = cloudpickle.dumps(make(*values))
        give_back()
        return out

    return share_packed(spark, spark.sparkContext.parallelize([args], 1).map(packed).collect()[0])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bucket(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def bit_table(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A set of 64-bit hashes as a bitmap of fixed size: (word, bits), 64 buckets in a row.

    However many keys there are, the table has at most ``2**(bits - 6)`` rows, so it may be broadcast.
    """
    bucket = _bucket(F.col(key), bits)
    rows = keys.where(F.col(key).isNotNull()).select(
        F.shiftright(bucket, 6).alias("word"), bucket.bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("place")
    )
    return rows.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))


def in_bits(df: DataFrame, key: Column, table: DataFrame, bits: int = FILTER_BITS, flag: str = "_maybe") -> DataFrame:
    """``df`` with a flag that is true for every row whose hash is in the set, and for a few others.

    Filters rows before a shuffle; what it lets through by accident the exact join behind it removes.
    """
    bucket_, word_, bits_ = free_names(df, "_bucket", "_word", "_bits")
    small = F.broadcast(table.select(F.col("word").alias(word_), F.col("bits").alias(bits_)))
    bucket = _bucket(key, bits)
    joined = df.withColumn(bucket_, bucket).join(small, F.shiftright(F.col(bucket_), 6) == F.col(word_), "left")
    found = F.getbit(F.coalesce(F.col(bits_), F.lit(0).cast("bigint")), F.col(bucket_).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return joined.withColumn(flag, F.coalesce(found == 1, F.lit(False))).drop(bucket_, word_, bits_)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


@dataclass
class Pages:
    """A set of 64-bit hashes as a bitmap whose size follows the number of keys: rows (page, words), 64 words of 64 bits in a page."""

    rows: DataFrame | None  # None: no keys
    bits: int
    small: bool  # the rows may be broadcast


def pages(ws: Workspace, keys: DataFrame, key: str) -> Pages:
    """At least ``BITS_PER_KEY`` bits for each row of ``keys``, up to 2**MOST_BITS bits (32 MB), the most that is ever broadcast."""
    count = keys.count()
    if not count:
        return Pages(None, FILTER_BITS, True)
    bits = max(FILTER_BITS, (count * BITS_PER_KEY - 1).bit_length())
    if bits > MOST_BITS:
        return Pages(None, bits, False)
    words = bit_table(keys, key, bits)
    inside = F.struct(F.col("word").bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("at"), "bits")
    held = words.groupBy(F.shiftright("word", 6).alias("page")).agg(F.map_from_entries(F.collect_list(inside)).alias("held"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("bigint")))
    return Pages(ws.save(held.select("page", filled.alias("words"))), bits, True)


def in_pages(df: DataFrame, key: str, found: Pages, flag: str) -> DataFrame:
    """``df``, whose columns are the caller's own, with a flag that is true for every row whose hash is in the set and few others."""
    if found.rows is None:
        return df.withColumn(flag, F.lit(not found.small))
    bucket = _bucket(F.col(key), found.bits)
    low = lambda c: c.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    joined = df.join(F.broadcast(found.rows), F.shiftright(bucket, 12) == F.col("page"), "left")
    word = F.coalesce(F.element_at("words", low(F.shiftright(bucket, 6)) + 1), F.lit(0).cast("bigint"))
    return joined.withColumn(flag, F.getbit(word, low(bucket)) == 1).drop("page", "words")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Identifies a row by id and text; null and empty text are alike, null ids too."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(whole: the row as it is, id, row), so that no name of the row's own columns meets a name used here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("id"),
                       row_key(id_col, text_col).alias("row"))


def drop_rows(ws: Workspace, docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows in ``dropped`` (id, row: the hash by ``row_key``), all columns kept, whatever their names.

    ``dropped`` should be written already; it is read several times.  Rows outside a bitmap of ``dropped`` pass where they are read.  Of
    those inside, the few that are not to go are found by id and hash alone, and get a bitmap of their own: rows inside the first and
    outside the second go for certain.  Only rows inside both meet ``dropped`` with all their columns.  If there are too many dropped rows for
    a bitmap of ``MOST_BITS`` bits, all rows are joined.
    """
    rows = packed_rows(docs, id_col, text_col)
    gone = dropped.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    same = F.col("gone_id").eqNullSafe(F.col("id")) & (F.col("gone_row") == F.col("row"))
    first = pages(ws, dropped, "row")
    if first.small and first.rows is None:
        return docs
    marked = in_pages(rows, "row", first, "hit")
    if not first.small:
        return marked.join(gone, same, "left_anti").select("whole.*")
    staying = ws.save(in_pages(rows.select("id", "row"), "row", first, "hit").where("hit").join(gone, same, "left_anti").select("row"))
    second = pages(ws, staying, "row")
    if second.small and second.rows is None:
        return marked.where("NOT hit").select("whole.*")
    doubtful = in_pages(marked.where("hit"), "row", second, "again").where("again").join(gone, same, "left_anti")
    return marked.where("NOT hit").select("whole.*").union(doubtful.select("whole.*"))
