"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of each word forwards and backwards, labels every byte
position with language probabilities, and a document's probability of a language is the mean
over all its positions.  It is trained here in numpy by backpropagation through time.

A word is a sequence of its own (words over ``WINDOW`` bytes are several), so equal words have
equal labels: a chunk of documents labels each distinct word once and counts it as often as it
occurs, which gives exactly the sums over all positions of the whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SpanHasher, arrow_map, chunks, code_points, word_spans
from .pretokens import LETTER, character_classes
from .samples import bounded_sample, crc_fold

WINDOW = 24
HIDDEN = 12
#: The bound of the training sample: documents, and words of each.
TRAIN_DOCUMENTS = 3000
TRAIN_WORDS = 60
UNDETERMINED = "und"
PREDICTED = "doc_id long, lang_pred string, score double"
FOLDS, HELD_OUT = 4, 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.clip(x, -30, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One direction's weights: gates are reset, update and candidate."""

    table: np.ndarray  # 3 x 256 x H: a byte's part of each gate, with the bias in it
    turn: np.ndarray  # 3 x H x H

    def steps(self, ids: np.ndarray, mask: np.ndarray, keep: bool):
        """ids, mask: positions x words. Hidden states of each position, and what training needs."""
        n, words = ids.shape
        size = self.turn.shape[1]
        h = np.zeros((words, size), np.float32)
        states, kept = np.empty((n, words, size), np.float32), []
        for t in range(n):
            gates = [np.take(self.table[g], ids[t], axis=0) for g in range(3)]
            for g in (0, 1):
                gates[g] += h @ self.turn[g]
                gates[g] = _sigmoid(gates[g])
            reset, update, candidate = gates
            mixed = h @ self.turn[2]
            candidate += reset * mixed
            np.multiply(candidate, 2, out=candidate)  # tanh x = 2 sigmoid 2x - 1
            candidate = _sigmoid(candidate)
            candidate *= 2
            candidate -= 1
            new = h + update * (candidate - h)
            new *= mask[t][:, None]  # a padded position leaves and passes on nothing
            if keep:
                kept.append((h, reset, update, candidate, mixed))
            states[t] = h = new
        return states, kept

    def gradients(self, ids, mask, kept, outer):
        """Backpropagation through time; outer: the loss's gradient at each state."""
        table, turn = np.zeros_like(self.table), np.zeros_like(self.turn)
        back = np.zeros_like(outer[0])
        for t in range(len(ids) - 1, -1, -1):
            h, reset, update, candidate, mixed = kept[t]
            d = (outer[t] + back) * mask[t][:, None]
            d_candidate = d * update * (1 - candidate**2)
            d_update = d * (candidate - h) * update * (1 - update)
            d_reset = d_candidate * mixed * reset * (1 - reset)
            d_mixed = d_candidate * reset
            back = d * (1 - update) + d_reset @ self.turn[0].T + d_update @ self.turn[1].T + d_mixed @ self.turn[2].T
            turn[0] += h.T @ d_reset
            turn[1] += h.T @ d_update
            turn[2] += h.T @ d_mixed
            for g, part in enumerate((d_reset, d_update, d_candidate)):
                np.add.at(table[g], ids[t], part)
        return table, turn


class ByteTagger:
    """The network; ``languages`` are its labels."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, len(languages)
        scale = 1 / np.sqrt(hidden)
        make = lambda *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.ways = [Direction(make(3, 256, hidden), make(3, hidden, hidden)) for _ in range(2)]
        self.out, self.bias = make(2, hidden, k), np.zeros(k, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [x for way in self.ways for x in (way.table, way.turn)] + [self.out, self.bias]

    def forward(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, kept_ahead = self.ways[0].steps(ids, mask, keep)
        behind, kept_behind = self.ways[1].steps(ids[::-1], mask[::-1], keep)
        logits = ahead @ self.out[0] + behind[::-1] @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, (ahead, behind, kept_ahead, kept_behind)

    def loss_gradients(self, ids, mask, labels, weights):
        """Cross entropy of every position against its word's label; gradients as in ``parameters``."""
        p, (ahead, behind, kept_ahead, kept_behind) = self.forward(ids, mask, keep=True)
        share = mask * weights[None, :]
        share = share / share.sum()
        right = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*ids.shape, 1)), 2)[..., 0]
        loss = -float((share * np.log(right + 1e-9)).sum())
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(labels[None, :, None], (*ids.shape, 1)), right[..., None] - 1, 2)
        d *= share[..., None].astype(np.float32)
        turned = d[::-1]
        out = np.stack([np.einsum("twh,twk->hk", ahead, d), np.einsum("twh,twk->hk", behind, turned)])
        one = self.ways[0].gradients(ids, mask, kept_ahead, d @ self.out[0].T)
        two = self.ways[1].gradients(ids[::-1], mask[::-1], kept_behind, turned @ self.out[1].T)
        return loss, [*one, *two, out, d.sum(axis=(0, 1))]

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 384, rate: float = 0.02, seed: int = 11):
        """Adam over random batches of words; languages count alike."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.languages))
        weight = (1 / np.maximum(share, 1))[labels].astype(np.float32)
        weight /= weight.mean()
        slow = [np.zeros_like(x) for x in self.parameters()]
        fast = [np.zeros_like(x) for x in self.parameters()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(words), batch)
            ids, mask = padded([words[i] for i in pick])
            _, gradients = self.loss_gradients(ids, mask, labels[pick], weight[pick])
            pace = rate * (1 - 0.9 * step / steps)
            for x, g, a, b in zip(self.parameters(), gradients, slow, fast, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def position_sums(self, words: list[bytes], batch: int = 8192) -> np.ndarray:
        """For each word (of at most ``WINDOW`` bytes) its positions' probabilities, summed."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sums = np.zeros((len(words), len(self.languages)))
        for a in range(0, len(words), batch):
            at = order[a : a + batch]
            ids, mask = padded([words[i] for i in at.tolist()])
            p, _ = self.forward(ids, mask)
            sums[at] = (p * mask[..., None]).sum(axis=0)
        return sums


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions x words: byte values, and 1 where a word has that position."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    longest = max(1, int(sizes.max()))
    flat = np.frombuffer(b"".join(word.ljust(longest, b"\0") for word in words), np.uint8).reshape(-1, longest)
    mask = (np.arange(longest)[:, None] < sizes[None, :]).astype(np.float32)
    return np.ascontiguousarray(flat.T), mask


def lettered_words(texts: list[str]):
    """Words with a letter: joined text, begin, end, text index, hash of each occurrence."""
    points, starts = code_points(texts)
    begin, end, text = word_spans(points, starts)
    letters = np.zeros(len(points) + 1, np.int64)
    np.cumsum(character_classes()[points] == LETTER, out=letters[1:])
    has = letters[end] > letters[begin]
    begin, end, text = begin[has], end[has], text[has]
    return "".join(texts), begin, end, text, SpanHasher(points)(begin, end)


def windows(word: bytes) -> list[bytes]:
    return [word[a : a + WINDOW] for a in range(0, len(word), WINDOW)]


def document_probabilities(model: ByteTagger, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities over all positions of each text, and the number of positions."""
    joined, begin, end, text, hashes = lettered_words(texts)
    codes, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    parts, owner = [], []
    for n, (b, e) in enumerate(zip(begin[first].tolist(), end[first].tolist(), strict=True)):
        word = joined[b:e].encode("utf-8", "surrogatepass")
        if len(word) <= WINDOW:
            parts.append(word)
            owner.append(n)
        else:
            pieces = windows(word)
            parts += pieces
            owner += [n] * len(pieces)
    k = len(model.languages)
    sums, size = np.zeros((len(distinct), k)), np.zeros(len(distinct))
    if parts:
        np.add.at(sums, owner, model.position_sums(parts))
        np.add.at(size, owner, np.fromiter(map(len, parts), np.int64, len(parts)))
    pooled = np.stack([np.bincount(text, weights=sums[codes, i], minlength=len(texts)) for i in range(k)], axis=1)
    positions = np.bincount(text, weights=size[codes], minlength=len(texts))
    return pooled / np.maximum(positions, 1)[:, None], positions


def train(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, words: int = TRAIN_WORDS) -> ByteTagger | None:
    """Fit on at most ``documents`` rows of ``docs`` (doc_id, text, lang) outside the held-out
    fold, and on ``words`` word occurrences of each, spread over the whole text.  ``None``
    without labelled text."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT)
    )

    def drawn(batches):
        for rows, texts in chunks(batches, "text"):
            joined, begin, end, text, _ = lettered_words(texts)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = np.unique(np.linspace(a, b - 1, min(words, b - a)).astype(np.int64)) if b > a else []
                out.append([part for i in at for part in windows(joined[begin[i] : end[i]].encode("utf-8", "surrogatepass"))])
            columns = [rows.column("doc_id"), rows.column("lang"), pa.array(out, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "words"])

    sample = bounded_sample(labelled, "doc_id", documents, labelled.select("doc_id").count())
    rows = arrow_map(sample, drawn, "doc_id long, lang string, words array<binary>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    pairs = [(bytes(word), r["lang"]) for r in rows for word in r["words"]]
    if not pairs:
        return None
    languages = sorted({lang for _, lang in pairs})
    place = {lang: i for i, lang in enumerate(languages)}
    return ByteTagger(languages).fit([word for word, _ in pairs], np.array([place[lang] for _, lang in pairs]))


def predict(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, lang_pred and score (the pooled probability) for each row of ``docs`` (doc_id, text).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def predicted(batches):
        own = shared.value
        for rows, texts in chunks(batches, "text", 1 << 21):
            if own is None:
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                p, positions = document_probabilities(own, texts)
                best = p.argmax(axis=1)
                langs = [own.languages[i] if n else UNDETERMINED for i, n in zip(best.tolist(), positions.tolist(), strict=True)]
                scores = np.where(positions > 0, np.minimum(p.max(axis=1), 1.0), 0.0)
            columns = [rows.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text"), predicted, PREDICTED)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text, lang) and predict every row: doc_id, held_out, lang_pred, score.

    A null doc_id is not held out (and not learned from).  Repeated rows are repeated, other
    columns are left aside, an empty table gives no rows.
    """
    held_out = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: How far the best language's pooled probability must be from chance (0) to certainty (1).
LEAST_LEAD = 0.12


def accepted(docs: DataFrame, least: float = LEAST_LEAD) -> DataFrame:
    """``docs`` without the rows that language identification rejects: text without a letter, or text
    whose best language of k has a pooled probability under 1 / k + ``least`` (1 - 1 / k).

    One pass, no shuffle; all columns stay as they are, whatever they are called.  Where nothing
    was learned, as without labelled text or with one language only, text with a letter stays.
    Repeated rows are treated alike and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def kept(batches):
        own = shared.value
        for rows, texts in chunks(batches, "text", 1 << 21):
            good = lettered(texts)
            if own is not None and len(own.languages) > 1:
                chance = 1 / len(own.languages)
                p, _ = document_probabilities(own, texts)
                good &= p.max(axis=1) >= chance + least * (1 - chance)
            if good.any():
                yield rows.filter(pa.array(good))

    return arrow_map(docs, kept, docs.schema)


def lettered(texts: list[str]) -> np.ndarray:
    """Which texts have a letter."""
    points, starts = code_points(texts)
    letters = np.zeros(len(points) + 1, np.int64)
    np.cumsum(character_classes()[points] == LETTER, out=letters[1:])
    return np.diff(letters[starts]) > 0
