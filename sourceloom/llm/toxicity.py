"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's severity grade is 0 (not toxic), 1 (toxic) or 2 (toxic with more than the usual number of telltale words).  One
linear score is shared by all thresholds: P(grade > k) = sigmoid(score - threshold k).  The output is the expected severity,
the sum of these probabilities.  Features are the distinct words of a text and the heads of its longer words, hashed;
weights are made sparse by a one-norm.

The model is fitted on a bounded sample of labelled texts, then applied to all texts in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import share
from sourceloom.llm.words import BLOCK, NOT_ALNUM, mix, text_bytes, word_hashes

DIMENSIONS = 1 << 22
HEAD = 4
SAMPLE_CLEAN, SAMPLE_TOXIC = 5000, 3000  # expected numbers of training texts
ROUNDS, RATE, ONE_NORM, LEAST_TEXTS = 400, 1.0, 0.5, 3
SURPRISE = 11.5  # a feature is used if chance explains its split between the classes with a probability below exp(-SURPRISE)
FOLDS = 4  # one in so many training texts calibrates the threshold of rejection


@dataclass
class Model:
    used: np.ndarray  # features with a weight, ascending
    weights: np.ndarray  # of these
    thresholds: np.ndarray  # ascending, one less than grades
    reject: float = 0.5  # texts with P(grade > 0) at or above go

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted; only ``wanted`` features, if given (ascending).

    The upper half of the feature numbers is for heads of words.  Texts are taken in blocks of about ``BLOCK`` bytes, or one that is longer.
    """
    data, offsets = text_bytes(column)
    half = np.uint64(DIMENSIONS // 2)
    found, at = [], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        words, first, heads = word_hashes(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at], NOT_ALNUM, HEAD)
        text = np.repeat(np.arange(at, end), np.diff(first))
        longer = heads != 0
        pairs = []
        for part, of, base in ((words % half, text, 0), (heads[longer] % half, text[longer], int(half))):
            feature = part.astype(np.int64) + base
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted, feature), max(len(wanted) - 1, 0))
                chosen = wanted[place] == feature if len(wanted) else np.zeros(len(feature), bool)
                feature, of = feature[chosen], of[chosen]
            pairs.append(of * DIMENSIONS + feature)
        found.append(np.unique(np.concatenate(pairs)))
        at = end
    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str,
                    clean: int = SAMPLE_CLEAN, toxic: int = SAMPLE_TOXIC) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
    """(labels, features) of about so many labelled texts of each class, and how many labels there are of each."""
    given = labels.where(F.col(toxic_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(toxic_col).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    scale = 1 << 30
    share_of = lambda y, n: F.lit(min(scale, scale * n // max(counts.get(y, 0), 1)))
    limit = F.when(F.col("toxic") == 1, share_of(1, toxic)).otherwise(share_of(0, clean))
    few = given.where(F.pmod(F.xxhash64("label_id", F.lit("toxicity")), F.lit(scale)) < limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(few), F.col("id") == F.col("label_id")).select("toxic", "text")  # about clean + toxic rows

    def extract(batches):
        for batch in batches:
            text, feature = features(batch.column(1))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], names=["toxic", "features"])

    got = rows.mapInArrow(extract, "toxic int, features array<int>").toArrow()
    return got["toxic"].to_pylist(), [x.values.to_numpy() for x in got["features"]], counts


def grades(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Severity: toxic texts with more telltale words (three toxic texts or more have them, no clean one) than their median are 2.

    ``words`` tells which columns are whole words.
    """
    in_toxic = np.bincount(cols, toxic[rows], len(words))
    in_clean = np.bincount(cols, 1 - toxic[rows], len(words))
    telltale = (in_toxic >= LEAST_TEXTS) & (in_clean == 0) & words
    number = np.bincount(rows, telltale[cols], len(toxic))
    usual = np.median(number[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 1, 1 + (number > usual), 0)


def telling(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Mask of the features whose texts are split between the classes unlike all texts (Chernoff bound)."""
    n = np.bincount(cols)
    share_, usual = np.bincount(cols, toxic[rows]) / np.maximum(n, 1), toxic.mean()
    part = lambda a, b: a * np.log(np.maximum(a, 1e-300) / b)
    return n * (part(share_, usual) + part(1 - share_, 1 - usual)) >= SURPRISE


def unlike(lists: list[np.ndarray]) -> list[int]:
    """Texts that share no three minimal hashes with an earlier one: many copies of one text must not vouch for its words."""
    seen, kept = set(), []
    for i, x in enumerate(lists):
        mark = tuple(int(mix(x.astype(np.uint64) + np.uint64(k << 32)).min()) for k in range(1, 4)) if len(x) else ()
        if mark not in seen:
            seen.add(mark)
            kept.append(i)
    return kept


def fit(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: dict[int, int]) -> Model | None:
    """Proximal gradient on the weighted likelihood; None without both classes."""
    if len(set(toxic.tolist())) < 2:
        return None
    # the features that occur, numbered in order; without a sort of all pairs
    numbers = np.flatnonzero(np.bincount(cols))
    place = np.zeros(numbers[-1] + 1 if len(numbers) else 0, np.int32)
    place[numbers] = np.arange(len(numbers))
    cols = place[cols]
    y = grades(toxic, rows, cols, numbers < DIMENSIONS // 2)
    weight = np.where(toxic == 1, counts[1] / (toxic == 1).sum(), counts[0] / (toxic == 0).sum())
    weight = weight * len(toxic) / weight.sum()
    used = telling(toxic, rows, cols)
    rows, cols, numbers = rows[used[cols]], (np.cumsum(used) - 1)[cols[used[cols]]], numbers[used]
    top = int(y.max())
    above = np.array([(weight * (y > k)).sum() / weight.sum() for k in range(top)])
    thresholds = -np.log(above / (1 - above))
    w, seen, seen_t = np.zeros(len(numbers)), np.full(len(numbers), 1e-8), np.full(top, 1e-8)
    low, high = np.where(y > 0, y - 1, 0), np.minimum(y, top - 1)
    for _ in range(ROUNDS):
        score = np.bincount(rows, w[cols], len(y))
        sigmoid = lambda t: 1 / (1 + np.exp(np.clip(t, -500, 500)))
        p_low = np.where(y > 0, sigmoid(thresholds[low] - score), 1.0)  # P(grade >= y)
        p_high = np.where(y < top, sigmoid(thresholds[high] - score), 0.0)  # P(grade > y)
        likelihood = np.maximum(p_low - p_high, 1e-12)
        d_low, d_high = p_low * (1 - p_low) / likelihood * weight, p_high * (1 - p_high) / likelihood * weight
        slope = np.bincount(cols, (d_high - d_low)[rows], len(numbers))
        slope_t = np.bincount(low, d_low * (y > 0), top) - np.bincount(high, d_high * (y < top), top)
        seen += slope ** 2
        seen_t += slope_t ** 2
        step = RATE / np.sqrt(seen)
        w -= step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * ONE_NORM, 0)
        thresholds = np.maximum.accumulate(thresholds - RATE / np.sqrt(seen_t) * slope_t)
    return Model(numbers[w != 0], w[w != 0].astype(np.float32), thresholds)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model | None:
    """A model, or None if the labels are missing, or all of one kind, or on no text at hand."""
    toxic, lists, counts = training_sample(docs, labels, id_col, text_col, toxic_col)
    if not lists:
        return None
    kept = unlike(lists)
    toxic, lists = [toxic[i] for i in kept], [lists[i] for i in kept]
    fold = np.array([int(mix(np.array([len(x) + int(x.sum())], np.uint64))[0] % FOLDS) == 0 for x in lists])
    flat = lambda chosen: (np.array([toxic[i] for i in chosen]), np.repeat(np.arange(len(chosen), dtype=np.int32), [len(lists[i]) for i in chosen]),
                           np.concatenate([lists[i] for i in chosen]))
    trial = fit(*flat(np.flatnonzero(~fold)), counts) if (~fold).any() else None
    model = fit(*flat(range(len(lists))), counts)
    if trial is not None and model is not None:
        y, rows, cols = flat(np.flatnonzero(fold))
        rows, cols = rows[np.isin(cols, trial.used)], cols[np.isin(cols, trial.used)]
        got = trial.probabilities(np.bincount(rows, trial.weights[np.searchsorted(trial.used, cols)], len(y)))[:, 0]
        model.reject = best_threshold(got, y, np.where(y == 1, counts[1] / max(sum(toxic), 1), counts[0] / max(len(toxic) - sum(toxic), 1)))
    return model


def best_threshold(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """Threshold with the greatest F1 on held-out texts, halfway to the next lower value.

    0.5 if they have no toxic or no clean text, or if the threshold would be below their share of toxic ones.
    """
    if len(set(toxic.tolist())) < 2:
        return 0.5
    usual = float((weight * toxic).sum() / weight.sum())
    order = np.argsort(-p, kind="stable")
    p, hit, all_ = p[order], np.cumsum((weight * toxic)[order]), np.cumsum(weight[order])
    last = np.append(p[1:] != p[:-1], True)
    f1 = np.where(last, 2 * hit / (all_ + (weight * toxic).sum()), 0)
    best = int(f1.argmax())
    found = float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)
    return found if p[best] > usual else 0.5


def scores(model: Model | None, column: pa.Array) -> np.ndarray:
    """P(grade > k) of every text."""
    if model is None:
        return np.zeros((len(column), 1))
    text, feature = features(column, model.used)
    return model.probabilities(np.bincount(text, model.weights[np.searchsorted(model.used, feature)], len(column)))


def cut(model: Model | None, reject: float | None) -> float:
    return reject if reject is not None else model.reject if model is not None else 0.5


def severity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: float | None = None) -> DataFrame:
    """Per row: id, p_toxic, severity (expected grade), rejected (p_toxic at or above ``reject``, by default the
    threshold calibrated in training).

    Null and empty texts have no features and the probability that follows from that.  Without a model everything is 0 and
    nothing is rejected.  Repeated rows come out alike, null ids as they are.  Other columns are not read.
    """
    get, least = share(docs.sparkSession, model), cut(model, reject)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches):
        for batch in batches:
            p = scores(get(), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(p[:, 0] >= least)],
                                             names=["id", "p_toxic", "severity", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, p_toxic double, severity double, rejected boolean").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", reject: float | None = None) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    get, least = share(docs.sparkSession, model), cut(model, reject)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(get(), batch.column(at))[:, 0] < least))

    return docs.mapInArrow(keep, docs.schema)
