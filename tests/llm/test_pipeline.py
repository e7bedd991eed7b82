"""The stages, each over its own input, against brute force."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from .conftest import make, prose
from .test_exact_and_near import brute
from .test_decontamination import brute_hits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of every kind the stages know, with labels and a benchmark."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 10 == 0
        text = prose(1000 + i, 80)
        rows.append((i, text + (" vilewort grimslur" if toxic else ""), "en"))
        labels.append((i, int(toxic)))
    rows += [(300, rows[1][1], "en"), (301, rows[1][1], "en"), (301, rows[1][1], "en"), (302, rows[2][1] + " tail", "en"), (303, None, "en"), (304, None, None),
             (305, "start " + prose(9, 20) + " end " + prose(77, 50), "en"), (None, "no id here", None)]
    make(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(9, 20)), (2, None), (3, "no such words at all anywhere in these texts my friend")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, benchmark = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            expected = [r for r in before if "vilewort" not in (r[1] or "")]
        elif name == "exact_dedup":
            last = {}
            for i, t in before:
                last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
            expected = sorted({(i, t) for i, t in before if (-1 if i is None else i) == last[t or ""]}, key=repr)
        elif name == "near_dedup":
            known = [r for r in before if r[0] is not None]
            groups = brute(known, 5)
            expected = [r for r in before if r[0] is None or groups[r[0]][1] == r[0]]
        else:
            expected = [r for r in before if not brute_hits(r[1], benchmark)[1]]
        assert sorted(after, key=repr) == sorted(expected, key=repr), name
        assert len(after) < len(before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in before)
    assert docs.selectExpr("sum(length)").first()[0] == total


def test_run_equals_the_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    # pieces of one length may change places; everything else is the same row by row
    plain = [c for c in docs.columns if c not in ("sequence_id", "offset")]
    got = corpus_pipeline.run(spark, folder)
    assert not corpus_pipeline._open
    assert sorted(got.select(*plain).collect(), key=repr) == sorted(docs.select(*plain).collect(), key=repr)
    used = lambda df: sorted(tuple(r) for r in df.groupBy("sequence_id").agg(F.sum("length"), F.count("*")).drop("sequence_id").collect())
    assert used(got) == used(docs)


def test_stages_keep_columns_of_any_name(spark, folder, tmp_path):
    from .test_exact_and_near import clashing

    rows = [(i, prose(3000 + i, 60)) for i in range(60)] + [(60, prose(3001, 60)), (61, prose(3002, 60) + " end"), (62, prose(9, 20)), (62, prose(9, 20)), (None, None)]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.columns == docs.columns
        docs = back
    # the copy with the larger id, of the near copies that with the smaller one; the benchmark passage is gone
    assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted([None, 0, *range(2, 61)], key=repr)


def test_empty_documents(spark, folder, tmp_path):
    import os

    for name in ("labels", "benchmark"):
        os.symlink(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
