"""A training-data pipeline over the operators of ``sourceloom.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import decontamination, exact_dedup, near_dup, packing, toxicity
from sourceloom.llm.common import drop_rows, packed_rows, prepare, row_key, table
from sourceloom.session import Workspace, delete_path, scratch_path

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 2 << 20  # of text in a worker at once; several stages share the workers of an executor
ORACLE_SQL = None  # tokenisation and packing are beyond SQL; tests/llm checks every stage against brute force
_open: list[Workspace] = []  # intermediate tables of the stages, until ``run`` has written what they lead to


def _workspace(spark: SparkSession, label: str) -> Workspace:
    prepare(spark, BATCH_BYTES)
    _open.append(Workspace(spark, label))
    _open[-1].tidy()  # what stages before have left
    return _open[-1]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is fitted on the labels of the documents at hand.

    Null and empty texts have no features and are judged by the thresholds alone, which keep them.  Null ids have no labels; repeated rows
    go or stay together.  Without labels of both kinds, or without documents, nothing goes.
    """
    _workspace(spark, "toxicity")
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest id; null equals empty.

    Null ids come last and count as one id.  Rows repeated with one id and text become one.  An empty table stays empty.
    """
    ws = _workspace(spark, "exact")
    groups = ws.save(exact_dedup.exact_groups(ws, docs, row=row_key("doc_id", "text")).where("group_size > 1"))
    dropped = ws.save(groups.where("NOT kept").select(F.col("doc_id").alias("id"), "row"))
    repeated = groups.where("kept").groupBy("doc_id", "row").count().where("count > 1")
    once = drop_rows(ws, docs, dropped, "doc_id", "text")
    # rows repeated with one id and text are rare; only they meet in a shuffle
    again = ws.save(repeated.select(F.col("doc_id").alias("id"), "row"))
    if again.isEmpty():
        return once
    unique = drop_rows(ws, once, again, "doc_id", "text")
    wanted = again.select(F.col("id").alias("again_id"), F.col("row").alias("again_row"))
    copies = packed_rows(once, "doc_id", "text").join(wanted, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("row") == F.col("again_row")), "left_semi")
    return unique.union(copies.dropDuplicates(["id", "row"]).select("whole.*"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays; five words a shingle, similarity of 0.8.

    Texts without words and null ids without a link stay; repeated rows go or stay together.  An empty table stays empty.
    """
    ws = _workspace(spark, "near")
    dropped = ws.save(near_dup.near_duplicates(ws, docs).where("NOT kept").select(F.col("doc_id").alias("id"), "row"))
    return drop_rows(ws, docs, dropped, "doc_id", "text")


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and wordless texts stay, repeated rows go or stay together.

    Without benchmark items or documents nothing goes.
    """
    ws = _workspace(spark, "benchmark")
    found = decontamination.contamination(ws, docs, table(spark, sf_dir, "benchmark"))
    dropped = ws.save(found.where("contaminated").select(F.col("doc_id").alias("id"), "row"))
    return drop_rows(ws, docs, dropped, "doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; null and empty texts are one piece of the end token, every row is packed."""
    ws = _workspace(spark, "packing")
    return packing.pack(ws, docs, packing.worker_vocabulary(spark, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark_passages),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; what only led to a written stage is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        while _open:
            _open.pop().close()
        if last:
            delete_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
