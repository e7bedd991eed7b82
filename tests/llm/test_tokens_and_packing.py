"""Token counts and packing against the tokenizer itself."""

import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sourceloom.llm import packing, token_counts
from sourceloom.llm.bpe import Vocabulary

from .conftest import edge_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
VOCABULARY = token_counts.whole_token_vocabulary(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeT's ll1²\n\t  é中дあ—<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_library(text):
    assert list(array("I", VOCABULARY.ids(text))) == ids(text)
    assert VOCABULARY.count(text) == len(ids(text))


def test_shortcuts_are_in_use_and_special_strings_are_kept():
    assert VOCABULARY.ranked and VOCABULARY.shortcut and len(VOCABULARY.whole) > 40_000
    text = "one<|endoftext|><|endoftext|> two <|endoftext|"
    assert list(array("I", VOCABULARY.ids(text))) == ids(text) and 50256 in ids(text)


def test_a_vocabulary_with_another_pattern_goes_to_the_library():
    other = Vocabulary(public_tokenizers.path("word_bpe_49k.json")).prove_whole_tokens()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Some words, 12 of them!", ""):
        assert list(array("I", other.ids(text))) == plain.encode(text, add_special_tokens=False).ids


def test_counts_on_all_edge_cases(edges, nothing):
    rows = token_counts.token_counts(edges, VOCABULARY, limit=100).collect()
    expected = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t, _ in edge_rows()]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    assert token_counts.token_counts(nothing, VOCABULARY).count() == 0


def check_packing(rows, texts, capacity):
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        tokens = ids(text) + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(tokens) // capacity)
        assert all(r.length == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and zlib.crc32(array("I", tokens[at:at + r.length]).tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(tokens)
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_gapless_and_whole(spark, ws, edges, capacity):
    texts = {n: t for n, (_, t, _) in enumerate(edge_rows())}
    docs = spark.createDataFrame([(n, t, "x") for n, t in texts.items()], "doc_id bigint, text string, offset string").repartition(4)
    check_packing(packing.pack(ws, docs, VOCABULARY, capacity=capacity).collect(), texts, capacity)
    assert packing.pack(ws, edges, VOCABULARY, capacity=capacity).selectExpr("sum(length)").first()[0] == sum(len(ids(t)) + 1 for t in texts.values())


def test_packing_of_nothing_and_kept_ids(ws, nothing, edges):
    assert packing.pack(ws, nothing, VOCABULARY).count() == 0
    kept = packing.pack(ws, edges.where("doc_id = 12"), VOCABULARY, keep_ids=True).collect()
    assert b"".join(bytes(r.ids) for r in sorted(kept, key=lambda r: r.start)) == array("I", ids(prose(2, 60)) + [0]).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=30))
def test_plan_holds_the_histogram_exactly(histogram):
    plan = packing.configuration_plan(histogram, 64, rounds=6)
    held = {}
    for copies, times in plan:
        assert times > 0 and sum(n * k for n, k in copies.items()) <= 64
        for n, k in copies.items():
            held[n] = held.get(n, 0) + k * times
    assert held == histogram


def test_plan_is_close_to_the_bound():
    histogram = {n: 1000 + 7 * n % 301 for n in range(40, 1800, 3)}
    used = sum(times for _, times in packing.configuration_plan(histogram))
    large = sum(k for n, k in histogram.items() if n > 1024)
    assert used <= 1.01 * max(sum(n * k for n, k in histogram.items()) / 2048, large)


def test_the_pipeline_packs_without_a_tokenizer_on_the_driver(spark, edges, monkeypatch):
    """The vocabulary is parsed and proven by a task; the driver only passes on what that has packed."""
    import corpus_pipeline

    monkeypatch.setattr("tokenizers.Tokenizer", None)
    rows = corpus_pipeline.packed(spark, edges, "").collect()
    while corpus_pipeline._open:
        corpus_pipeline._open.pop().close()
    assert sum(r.length for r in rows) == sum(len(ids(t)) + 1 for _, t, _ in edge_rows())
