"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic model over hashed words and word beginnings.  A document's is
their noisy-or, 1 - prod(1 - p), so that one toxic sentence is enough.  Only documents are
labelled: training maximises the likelihood of the bags' labels, which teaches the sentences'
scores; the highest ones locate the offending sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SpanHasher, arrow_map, chunks, code_points, counts_by, is_ascii_space, lower_ascii, word_spans
from .samples import bounded_sample, crc_fold

BITS = 17
PREFIXES = (4, 5)
FOLDS, HELD_OUT = 5, 0
#: The bound of the training sample: documents of each label, and characters of each document.
TRAIN_DOCUMENTS = 2500
TRAIN_CHARS = 20_000
SCORED = "doc_id long, score double, predicted int, worst_start long, worst_end long, n_offending long"

#: A sentence ends with one of these marks before white space, or with its line.
ENDS = ".!?"


@dataclass
class Model:
    weights: np.ndarray  # of hashed features
    bias: float
    empty: float  # the score of a text without words


@dataclass
class Bags:
    """Words of several texts: hashed features of each distinct word, and where words occur."""

    features: np.ndarray  # distinct words x features
    word: np.ndarray  # of each occurrence, in distinct words
    sentence: np.ndarray  # of each occurrence
    text: np.ndarray  # of each sentence
    begin: np.ndarray  # of each sentence, in its text
    end: np.ndarray
    texts: int


def bags(texts: list[str]) -> Bags:
    points, starts = code_points(texts)
    points = lower_ascii(points)
    begin, end, text = word_spans(points, starts)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Bags(np.zeros((0, 1 + len(PREFIXES)), np.int64), none, none, none, none, none, len(texts))
    # A word's core, without the marks around it.
    letter = ~is_ascii_space(points) & ~np.isin(points, np.array([ord(c) for c in ".,;:!?\"'()[]"], np.uint32))
    n = len(points)
    at = np.arange(n)
    ahead = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(letter, at + 1, 0))
    low = np.minimum(ahead[begin], end)
    high = np.maximum(np.minimum(behind[end - 1], end), low)
    hasher = SpanHasher(points)
    codes, _ = pd.factorize(hasher(low, high))
    first = np.zeros(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    low, high = low[first], high[first]
    spans = [high] + [np.minimum(low + p, high) for p in PREFIXES]
    mask = np.uint64((1 << BITS) - 1)
    features = np.stack([(hasher(low, e) * np.uint64(2 * i + 3) >> np.uint64(20)) & mask for i, e in enumerate(spans)], axis=1)
    # Sentences: a new one after a closing mark, a line break or the text's beginning.
    closes = np.isin(points[end - 1], np.array([ord(c) for c in ENDS], np.uint32))
    breaks = np.zeros(n + 1, np.int64)
    np.cumsum(points == 10, out=breaks[1:])
    new = np.ones(len(begin), bool)
    new[1:] = closes[:-1] | (text[1:] != text[:-1]) | (breaks[begin[1:]] > breaks[end[:-1]])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(begin)) - 1
    own = text[heads]
    return Bags(features.astype(np.int64), codes, sentence, own, begin[heads] - starts[own], end[tails] - starts[own], len(texts))


def bags_in_parts(texts: list[str], size: int = 200) -> Bags:
    """The same bags, made of a few texts at a time to bound memory; words are distinct by part."""
    parts = [bags(texts[a : a + size]) for a in range(0, len(texts), size)]
    moved = lambda name, unit: np.concatenate(
        [getattr(b, name) + sum(unit(c) for c in parts[:i]) for i, b in enumerate(parts)]
    )
    return Bags(
        np.concatenate([b.features for b in parts]), moved("word", lambda b: len(b.features)), moved("sentence", lambda b: len(b.text)),
        moved("text", lambda b: b.texts), np.concatenate([b.begin for b in parts]), np.concatenate([b.end for b in parts]), len(texts),
    )


def sentence_logits(model: Model, b: Bags) -> np.ndarray:
    value = model.weights[b.features].sum(axis=1)
    return model.bias + np.bincount(b.sentence, weights=value[b.word], minlength=len(b.text))


def noisy_or(logits: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) of each text, through the sum of log(1 + exp(z))."""
    return -np.expm1(-np.bincount(text, weights=np.logaddexp(0, logits), minlength=texts))


def fit(b: Bags, labels: np.ndarray, weights: np.ndarray, rounds: int = 150, rate: float = 0.1, l1: float = 2e-5) -> Model:
    """Maximise the bags' weighted likelihood by Adam with a shrinking step."""
    total = weights.sum()
    base = float((weights * labels).sum() / total)
    w, bias = np.zeros(1 << BITS), -4.0
    m, v, bias_m, bias_v = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    positive = labels[b.text] > 0
    share = weights[b.text] / total
    distinct = len(b.features)
    for step in range(1, rounds + 1):
        z = sentence_logits(Model(w, bias, base), b)
        p = noisy_or(z, b.text, b.texts)
        ratio = (1 - p[b.text]) / np.maximum(p[b.text], 1e-9)
        g = share * np.where(positive, -ratio, 1.0) / (1 + np.exp(-np.clip(z, -50, 50)))
        by_word = np.bincount(b.word, weights=g[b.sentence], minlength=distinct)
        gradient = l1 * np.sign(w)
        for column in b.features.T:
            gradient += np.bincount(column, weights=by_word, minlength=len(w))
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        bias_m += 0.1 * (g.sum() - bias_m)
        bias_v += 0.01 * (g.sum() ** 2 - bias_v)
        pace = rate * (1 - 0.8 * step / rounds)
        first, second = 1 - 0.9**step, 1 - 0.99**step
        w -= pace * (m / first) / (np.sqrt(v / second) + 1e-8)
        bias -= pace * (bias_m / first) / (np.sqrt(bias_v / second) + 1e-8)
    return Model(w.astype(np.float32), float(bias), base)


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, characters: int = TRAIN_CHARS) -> Model | None:
    """Fit on at most ``documents`` rows of each label, of at most ``characters`` each, outside
    the held-out fold; ``labels`` (doc_id, toxic) counts once a doc_id. ``None`` without both labels."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    parts = [bounded_sample(known.filter(F.col("toxic") == y), "doc_id", documents, totals[y]) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x documents rows of two numbers
    rows = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.length("text") <= characters))
        .join(chosen, "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    counts = np.bincount(y, minlength=2)
    weights = np.array([totals[i] / counts[i] for i in (0, 1)])[y]  # back to the labels' shares
    weights = np.where(y == 1, np.sqrt(weights * weights[y == 1].max()), weights)
    return fit(bags_in_parts([r["text"] for r in rows]), y, weights)


def score_documents(docs: DataFrame, model: Model | None, offending: float = 0.5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): score, predicted, the worst sentence's start and end
    (code points; null without words) and the number of sentences with at least ``offending``.

    Without words the score is the training labels' share, or 0.5 without a model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def scored(batches):
        own = shared.value or Model(np.zeros(1 << BITS, np.float32), -50.0, 0.5)
        for rows, texts in chunks(batches, "text"):
            b = bags(texts)
            z = sentence_logits(own, b)
            p = noisy_or(z, b.text, len(texts))
            some = counts_by(b.text, len(texts)) > 0
            p = np.clip(np.where(some, p, own.empty), 0, 1)
            worst = np.zeros(len(texts), np.int64)
            order = np.lexsort((-np.arange(len(z)), z))
            worst[b.text[order]] = order  # the last written is the highest, the first of ties
            spans = [x[worst] if len(x) else np.zeros(len(texts), np.int64) for x in (b.begin, b.end)]
            columns = [
                rows.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                *(pa.array(np.where(some, x, 0), pa.int64(), mask=~some) for x in spans),
                pa.array(counts_by(b.text, len(texts), (z >= np.log(offending / (1 - offending))).astype(np.int64)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in SCORED.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), scored, SCORED)


def offending_sentences(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The sentences that score at least ``least``: doc_id, start, end, score, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def located(batches):
        own = shared.value
        for rows, texts in chunks(batches, "text"):
            ids, out = rows.column("doc_id").to_pylist(), []
            if own is not None:
                b = bags(texts)
                p = 1 / (1 + np.exp(-np.clip(sentence_logits(own, b), -50, 50)))
                for i in np.flatnonzero(p >= least).tolist():
                    d, start, end = int(b.text[i]), int(b.begin[i]), int(b.end[i])
                    out.append((ids[d], start, end, float(p[i]), texts[d][start:end]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "end", "score", "sentence"])

    return arrow_map(docs.select("doc_id", "text"), located, "doc_id long, start long, end long, score double, sentence string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic) and score every row.

    Returns doc_id, held_out, score, predicted and where the worst sentence is.  A null text is
    an empty one; a null doc_id is not held out (and not learned from); repeated rows are
    repeated; other columns are left aside; an empty table gives no rows.
    """
    held_out = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst_start", "worst_end", "n_offending")
