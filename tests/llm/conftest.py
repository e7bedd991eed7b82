import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, id string, row int, n_tokens string"


def make(spark, rows):
    """A documents table with extra columns whose names clash with results and internals."""
    full = [(i, t, lang, "s", None if t is None else len(t), "x", "y", 1, "z") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, words):
    rng = random.Random(seed)
    ends = ("ra", "mi", "to", "ñe", "x1", "'s", "la", "ko", "zu", "pe")
    stock = [a + b + c for a in ("al", "be", "co", "di", "Éo", "fu", "ga", "ho") for b in ends for c in ends]
    return " ".join(rng.choice(stock) for _ in range(words))


def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows, ties, one long word, special strings, rare characters."""
    long_text = prose(1, 30_000)
    return [
        (1, "", "en"), (2, None, "en"), (3, " \t\n ", None), (4, long_text, "en"), (5, long_text, "en"), (6, "a", "en"), (None, "null id", "en"),
        (7, "twice", "en"), (7, "twice", "en"), (8, "x" * 50_000, "de"), (9, "before<|endoftext|>after  \n\n  end", "de"),
        (10, "日本語のテキスト \U0001F600 Ω≈ç√   x y ²½ don't we'll", "ja"), (11, "same id", "fr"), (11, "other text", "fr"),
        (12, prose(2, 60), "en"), (13, prose(2, 60) + " more", "en"), (14, prose(2, 60), "en"), (15, prose(3, 12), None), (16, "1 2 3 4", None), (None, None, None),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, edge_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])


@pytest.fixture(scope="session", autouse=True)
def settings(spark):
    from sourceloom.llm.common import prepare

    prepare(spark)
