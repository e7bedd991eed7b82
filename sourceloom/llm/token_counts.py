"""Token counts with a whole-token shortcut.

Before any text is read, the driver proves which vocabulary strings encode alone as one token.  In the
texts, pre-tokens among them count one; only the others are merged, each distinct one once while a
worker remembers it.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.bpe import Vocabulary
from sourceloom.llm.common import share

MAX_TOKENS = 1024


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = MAX_TOKENS) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows come out as they are, one
    row for each row.  Other columns are not read.  An empty table gives an empty result.
    """
    shared = share(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        encoder = shared()
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()),
                 pa.array([encoder.count(t.as_py()) for t in texts], pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def whole_token_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path).prove_whole_tokens()
