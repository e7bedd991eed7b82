"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted once on a bounded sample and then
frozen.  A byte's code length is minus the base-2 logarithm of its count in the longest
context seen in training over that context's total; a byte not seen there costs the escape (method C:
distinct followers over total plus distinct followers) and is coded in the next shorter context, at last
uniformly.  A text's language is the one whose trees give the shortest exact code for all its bytes.

Since the statistics are frozen, the cost of a byte depends on it and its context alone.  All costs are worked
out on the driver per context and follower, and looked up in the texts by hash, one pass,
no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import share
from sourceloom.llm.words import text_bytes

ORDER = 3
SAMPLE_DOCS = 400  # expected number of training texts for each language
MAX_GRAMS = 300_000  # most frequent contexts with follower kept for each language
CHUNK = 1 << 19
UNKNOWN = "und"


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its ORDER predecessors in its text as one number; zero bytes stand before a text."""
    codes = data.astype(np.uint32)
    for k in range(1, ORDER + 1):
        codes[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    # the first bytes of a text must not see the text before
    for k in range(ORDER):
        at = offsets[:-1][offsets[1:] - offsets[:-1] > k] + k
        codes[at] &= np.uint32((1 << (8 * (k + 1))) - 1)
    return codes


def _gram_counts(batches):
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang in set(langs):
            chosen = texts.take(pa.array([i for i, x in enumerate(langs) if x == lang]))
            grams, counts = np.unique(_codes(*text_bytes(chosen)), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing: (key + 1 by slot, index by slot)."""
    size = 1 << max(4, int(4 * len(keys) + 1).bit_length())
    slots, index = np.zeros(size, np.uint64), np.zeros(size, np.int32)
    todo, at = np.arange(len(keys)), _slot(keys, size)
    while len(todo):
        free = slots[at] == 0
        _, first = np.unique(at, return_index=True)
        chosen = np.zeros(len(todo), bool)
        chosen[first] = True
        chosen &= free
        slots[at[chosen]], index[at[chosen]] = keys[todo[chosen]].astype(np.uint64) + np.uint64(1), todo[chosen]
        todo, at = todo[~chosen], (at[~chosen] + 1) & (size - 1)
    return slots, index


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    hashed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (hashed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where absent."""
    slots, index = table
    at, wanted = _slot(keys, len(slots)), keys.astype(np.uint64) + np.uint64(1)
    held = slots[at]
    found = np.where(held == wanted, index[at], np.int32(-1))
    open_ = np.flatnonzero((held != wanted) & (held != 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & (len(slots) - 1)
        held = slots[at[open_]]
        hit = held == wanted[open_]
        found[open_[hit]] = index[at[open_[hit]]]
        open_ = open_[~hit & (held != 0)]
    return found


@dataclass
class Models:
    """Frozen code lengths of all languages; row order of the arrays follows the hash tables."""

    langs: list[str]
    grams: list[tuple]  # by order: table of contexts with follower
    costs: list[np.ndarray]  # by order: code length of that follower, a column for each language
    contexts: list[tuple]  # by order: table of contexts
    escapes: list[np.ndarray]  # by order: cost of leaving that context; 0 where a language has not seen it
    uniform: float = 8.0

    def byte_costs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order < 0:
            return np.full((len(codes), len(self.langs)), self.uniform, np.float32)
        codes = codes & np.uint32((1 << (8 * (order + 1))) - 1)
        row = _find(self.grams[order], codes)
        out = self.costs[order][row]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            context = _find(self.contexts[order], codes[missing] >> np.uint32(8))
            left = np.where((context >= 0)[:, None], self.escapes[order][context], np.float32(0))
            out[missing] = left + self.byte_costs(codes[missing], order - 1)
        return out


def train(docs: DataFrame, lang_col: str, text_col: str, id_col: str, sample_docs: int = SAMPLE_DOCS,
          max_grams: int = MAX_GRAMS) -> Models | None:
    """Trees of all languages among rows with non-null language and text, or None if there are none.

    The sample is of whole texts, chosen by a hash of the id, about ``sample_docs`` for each
    language; at most ``max_grams`` contexts with follower of each language reach the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    if not sizes:
        return None
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(scale, scale * sample_docs // n))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(scale)) < limits[F.col(lang_col)])
    grams = (chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
             .mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs, by_lang = [], []
    for lang in sorted(sizes):
        rows = grams.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(max_grams).select("gram", "n").toArrow()
        if rows.num_rows:
            langs.append(lang)
            by_lang.append((rows["gram"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(np.float64)))
    return build(langs, by_lang) if langs else None


def build(langs: list[str], by_lang: list[tuple[np.ndarray, np.ndarray]]) -> Models:
    """Code lengths from the counts of ORDER + 1 bytes in each language."""
    models = Models(langs, [], [], [], [])
    for order in range(ORDER + 1):
        stats = []
        for grams, counts in by_lang:
            g, inverse = np.unique(grams & np.uint32((1 << (8 * (order + 1))) - 1), return_inverse=True)
            n = np.bincount(inverse, counts)
            c, where = np.unique(g >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(where, n), np.bincount(where)
            stats.append((g, np.log2((total + distinct)[where] / n), c, np.log2((total + distinct) / distinct)))
        all_grams = np.unique(np.concatenate([s[0] for s in stats]))
        all_contexts = np.unique(np.concatenate([s[2] for s in stats]))
        escapes = np.zeros((len(all_contexts), len(langs)), np.float32)
        for j, (_, _, c, cost) in enumerate(stats):
            escapes[np.searchsorted(all_contexts, c), j] = cost
        # a language that has not seen the follower escapes from the context, if it has seen that
        shorter = models.byte_costs(all_grams, order - 1)
        costs = (shorter + escapes[np.searchsorted(all_contexts, all_grams >> np.uint32(8))]).astype(np.float32)
        for j, (g, cost, _, _) in enumerate(stats):
            costs[np.searchsorted(all_grams, g), j] = cost
        models.grams.append(_table(all_grams))
        models.costs.append(costs)
        models.contexts.append(_table(all_contexts))
        models.escapes.append(escapes)
    return models


def code_lengths(models: Models, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(offsets) - 1, len(models.langs)))
    start, n = 0, len(data)
    while start < n:
        end = min(start + CHUNK, n)
        first = int(np.searchsorted(offsets, start, side="right")) - 1
        reach = max(start - ORDER, int(offsets[first]))  # context from the chunk before, within the text
        last = int(np.searchsorted(offsets, end, side="left"))
        local = np.clip(offsets[first:last + 1] - reach, 0, end - reach)
        costs = models.byte_costs(_codes(data[reach:end], local))[start - reach:]
        local = np.clip(offsets[first:last] - start, 0, end - start)
        full = np.flatnonzero(np.diff(np.append(local, end - start)) > 0)
        out[first + full] += np.add.reduceat(costs, local[full], axis=0, dtype=np.float64)
        start = end
    return out


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (posterior of the language, all being equally likely before), bits_per_byte.

    Null, empty and letterless texts are ``und`` with score 0; so are all texts if nothing was learned.  Ties go to the
    language first in the alphabet.  Repeated rows come out as they are, null ids too.  Other columns are not read.
    """
    shared = share(docs.sparkSession, models)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches):
        learned = shared()
        for batch in batches:
            texts = batch.column(1)
            lettered = np.array([any(map(str.isalpha, t.as_py() or "")) for t in texts], bool)
            pred, sure, bits = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            if learned and lettered.any():
                data, offsets = text_bytes(texts)
                lengths = code_lengths(learned, data, offsets)
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(len(texts)), best]
                posterior = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
                pred = np.where(lettered, np.array(learned.langs, object)[best], UNKNOWN)
                sure = np.where(lettered, posterior, 0.0)
                bits = np.where(lettered, least / np.maximum(np.diff(offsets), 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(sure), pa.array(bits)],
                names=["id", "lang_pred", "score", "bits_per_byte"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)
