"""Document quality by hierarchical empirical Bayes.

A logistic model over a few text statistics gives each document's own evidence.  Grouped sums of
it by host and by path within host give posteriors: a site's mean quality is shrunk toward the
global prior, and a path's toward its host's posterior, the more the fewer documents it has.
How strongly is estimated from the data, by the spread between sites beyond what the spread
within them explains.  A document's score combines its own evidence with its path's posterior
from the other documents, so nothing counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import SpanHasher, arrow_map, chunks, code_points, counts_by, line_spans, word_spans
from .linear import inverted, times
from .samples import bounded_sample
from .storage import checkpointed

#: The bound of the training sample: documents of each label, and characters of each document.
TRAIN_DOCUMENTS = 4000
TRAIN_CHARS = 20_000
LEAST_SCORE = 0.3
STATISTICS = (
    "log words", "mean word length", "symbol share", "table marks a word", "repeated words next to each other",
    "distinct words share", "most frequent word's share", "digit share", "upper-case share", "sentence marks a word",
    "commas a word", "mean line words", "repeated lines share", "long words share", "words with symbols share",
)


def statistics(texts: list[str]) -> np.ndarray:
    """Texts x ``STATISTICS``; an empty text has zeros."""
    n = len(texts)
    points, starts = code_points(texts)
    begin, end, text = word_spans(points, starts)
    words = np.maximum(counts_by(text, n), 1)
    chars = np.maximum(np.diff(starts), 1)
    share = lambda member: np.diff(np.concatenate([[0], np.cumsum(member)])[starts])
    symbol = np.isin(points, np.array([ord(c) for c in "#*$%&|<>{}[]^~_=\\/@+"], np.uint32))
    hasher = SpanHasher(points)
    identity = hasher(begin, end)
    beside = np.zeros(len(text), bool)
    beside[1:] = (identity[1:] == identity[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((identity, text))
    new = np.ones(len(text), bool)
    new[1:] = (identity[order][1:] != identity[order][:-1]) | (text[order][1:] != text[order][:-1])
    edges = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    if len(edges):
        np.maximum.at(most, text[order][edges], np.diff(np.append(edges, len(text))))
    line_begin, line_end, line_text = line_spans(points, starts)
    lines = hasher(line_begin, line_end)
    full = line_end > line_begin
    lines, line_text = lines[full], line_text[full]
    order_lines = np.lexsort((lines, line_text))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order_lines][1:] == lines[order_lines][:-1]) & (line_text[order_lines][1:] == line_text[order_lines][:-1])
    line_count = np.maximum(counts_by(line_text, n), 1)
    marked = np.zeros(len(points) + 1, np.int64)
    np.cumsum(symbol, out=marked[1:])
    return np.stack(
        [
            np.log1p(counts_by(text, n)),
            counts_by(text, n, end - begin) / words,
            share(symbol) / chars,
            share(points == ord("|")) / words,
            counts_by(text[beside], n) / words,
            counts_by(text[order][edges], n) / words,
            most / words,
            share((points >= 48) & (points <= 57)) / chars,
            share((points >= 65) & (points <= 90)) / chars,
            share(np.isin(points, np.array([33, 46, 63], np.uint32))) / words,
            share(points == 44) / words,
            np.log1p(words / line_count),
            counts_by(line_text[order_lines][again], n) / line_count,
            counts_by(text[(end - begin) > 20], n) / words,
            counts_by(text[marked[end] > marked[begin]], n) / words,
        ],
        axis=1,
    )


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the bias last

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
    """Ridge-penalised maximum likelihood by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        curve = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = times(inverted(curve), gradient)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, characters: int = TRAIN_CHARS) -> Logistic | None:
    """Fit on at most ``documents`` rows of each label, of at most ``characters`` each.  ``labels``
    (doc_id, quality) counts once a doc_id; ``None`` unless both labels occur."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    parts = [bounded_sample(known.filter(F.col("quality") == y), "doc_id", documents, totals[y]) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x documents rows of two numbers
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= characters)).join(chosen, "doc_id")

    def measured(batches):
        for rows, texts in chunks(batches, "text"):
            values = pa.array(statistics(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), values], ["doc_id", "quality", "x"])

    rows = arrow_map(sample, measured, "doc_id long, quality int, x array<double>").collect()
    if len({r["quality"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in rows], float)
    share = np.array([totals[0] / (y == 0).sum(), totals[1] / (y == 1).sum()])
    weight = share[y.astype(int)]
    return fit_logistic(np.array([r["x"] for r in rows]), y, weight / weight.mean())


def evidence(docs: DataFrame, model: Logistic | None) -> DataFrame:
    """doc_id, host, path and the classifier's probability ``own`` of each row (doc_id, text, host, path);
    0.5 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        own = shared.value
        for rows, texts in chunks(batches, "text"):
            p = own(statistics(texts)) if own is not None else np.full(len(texts), 0.5)
            columns = [rows.column(c) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64())], ["doc_id", "host", "path", "own"])

    return arrow_map(docs.select("doc_id", "text", "host", "path"), scored, "doc_id long, host string, path string, own double")


def prior_strength(groups: DataFrame, mean: float) -> float:
    """How many documents the prior counts as: within-site variance over between-site variance.

    ``groups`` has n, total and squares of each site.  Moments: the weighted spread of the site
    means, less what the variance within sites explains.
    """
    centre = F.col("total") / F.col("n")
    r = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
        F.sum(F.col("n") * (centre - mean) * (centre - mean)).alias("spread"), F.sum(F.col("squares") - F.col("total") * centre).alias("inner"),
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] <= r["k"]:
        return 10.0
    within = max(r["inner"] / (r["n"] - r["k"]), 1e-9)
    between = (r["spread"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(within / max(between, 1e-9), 1.0), 1e6))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def hierarchical_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Quality of each row of ``docs`` (doc_id, text, host, path), trained on ``labels`` (doc_id, quality).

    Returns doc_id, host, path, own, host_posterior, path_posterior, score and kept (score at
    least ``least``).  A null host or path is a site of its own; a site's only document has its
    host's or the global prior.  Equal rows have equal scores.  A null text is an empty one;
    repeated rows are repeated; other columns are left aside; an empty table gives no rows.
    """
    scored = checkpointed(evidence(docs, train(docs, labels)))
    own = F.col("own")
    # Sums by path first, with map-side combining; hosts are sums of their paths.
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own).alias("total"), F.sum(own * own).alias("squares")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n = whole["n"] or 1
    mean = min(max((whole["total"] or 0.5 * n) / n, 1e-3), 1 - 1e-3)
    by_host, by_path = prior_strength(hosts, mean), prior_strength(paths, mean)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("p"), "n", "total", "host_n", "host_total")
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    # Posteriors of the other documents: a row's own evidence is left out of both sums.
    placed = scored.join(sites, same)
    placed = placed.withColumn("host_posterior", (F.col("host_total") - own + by_host * mean) / (F.col("host_n") - 1 + by_host))
    placed = placed.withColumn("path_posterior", (F.col("total") - own + by_path * F.col("host_posterior")) / (F.col("n") - 1 + by_path))
    odds = _logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return placed.select(
        "doc_id", "host", "path", "own", "host_posterior", "path_posterior", score.alias("score"), (score >= least).alias("kept")
    )
