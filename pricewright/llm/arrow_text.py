"""Vectorised text helpers for use inside Arrow map tasks.

A chunk is a list of whole texts, never a cut one; its size only bounds memory.  Texts are
laid out as one array of code points, and spans (words, lines, pre-tokens) are index pairs
into that array, hashed by their code points and the places of these within the span.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHUNK_CHARS = 1 << 19



#: Rows of a record batch at most; a session setting that asks for fewer holds.
BATCH_ROWS = 500


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with what Python workers need to import this package from where it lies.

    A task's end gives back the memory that its worker no longer needs, as the worker is used again.
    """
    spark: SparkSession = df.sparkSession
    asked = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < asked <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, pickled = _packed(function)

    def task(batches):
        import sys

        from pyspark import cloudpickle

        if root not in sys.path:
            sys.path.append(root)
        yield from cloudpickle.loads(pickled)(batches)
        from pricewright.llm.arrow_text import memory_released

        memory_released()

    return df.mapInArrow(task, schema)


def _packed(function: Callable) -> tuple[str, bytes]:
    """The folder that this package lies in and the function, for workers that don't have it on their path."""
    return str(Path(__file__).resolve().parents[2]), cloudpickle.dumps(function)


def arrow_groups(df: DataFrame, keys: list[str], function: Callable, schema) -> DataFrame:
    """``applyInArrow`` by ``keys`` with what Python workers need, as in ``arrow_map``.

    A group is in memory as a whole, so the keys must bound it.
    """
    root, pickled = _packed(function)

    def task(rows):
        import sys

        from pyspark import cloudpickle

        if root not in sys.path:
            sys.path.append(root)
        return cloudpickle.loads(pickled)(rows)

    return df.groupBy(*keys).applyInArrow(task, schema)


def memory_released() -> None:
    """Give unused memory of Arrow's pool and of the C library back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS):
    """Yield ``(record_batch_slice, texts)``; a null text is an empty one."""
    for batch in batches:
        texts = [text or "" for text in batch.column(column).to_pylist()]
        begin = size = 0
        for at, text in enumerate(texts):
            if at > begin and size + len(text) > limit:
                yield batch.slice(begin, at - begin), texts[begin:at]
                begin, size = at, 0
            size += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and each text's start with the total at the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), starts


def mix64(values: np.ndarray) -> np.ndarray:
    """The finalising permutation of splitmix64."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


class SpanHasher:
    """Hashes spans of one code-point array; equal spans have equal hashes anywhere.

    A span's hash is the sum of a pseudo-random number for each pair of a code point and its place
    in the span.  Unlike a polynomial modulo 2^64, which has equal values for a long Thue-Morse
    word and its complement whatever the multiplier, no such regular texts collide.
    """

    def __init__(self, points: np.ndarray):
        self.points = points

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        first = np.cumsum(size) - size
        total = int(size.sum())
        place = np.arange(total)
        place -= np.repeat(first, size)
        keys = place.astype(np.uint64)
        keys <<= np.uint64(32)
        place += np.repeat(starts, size)
        keys |= self.points[place]
        del place
        keys += np.uint64(0x9E3779B97F4A7C15)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(32)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(keys, out=sums[1:])
        return mix64(sums[first + size] - sums[first] + size.astype(np.uint64))


def is_ascii_space(points: np.ndarray) -> np.ndarray:
    """U+0009 to U+000D and U+0020."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other code points stay."""
    return points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))


def runs(member: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true positions, cut at the text starts: (begin, end)."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(member[1:], member[:-1], out=change[1:])
    change[starts[:-1][starts[:-1] < n]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], n)
    inside = member[edges]
    return edges[inside], ends[inside]


def word_spans(points: np.ndarray, starts: np.ndarray):
    """Words between ASCII white space: (begin, end, text index)."""
    begin, end = runs(~is_ascii_space(points), starts)
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def line_spans(points: np.ndarray, starts: np.ndarray):
    r"""Lines of every text, split at ``\n``: (begin, end, text index)."""
    texts = len(starts) - 1
    breaks = np.flatnonzero(points == 10)
    owner = np.searchsorted(starts, breaks, side="right") - 1
    begin = np.concatenate([starts[:-1], breaks + 1])
    end = np.concatenate([breaks, starts[1:]])
    text = np.concatenate([np.arange(texts), owner])
    # A break ends a line of its own text; the last line ends with the text.
    begin_order = np.lexsort((begin, text))
    end_text = np.concatenate([owner, np.arange(texts)])
    end_order = np.lexsort((end, end_text))
    return begin[begin_order], end[end_order], text[begin_order]


def counts_by(index: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows (or the sum of integer weights) for each index below ``size``."""
    if weights is None:
        return np.bincount(index, minlength=size)
    return np.bincount(index, weights=weights, minlength=size).astype(np.int64)
