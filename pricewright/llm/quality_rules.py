"""Repetition rules from a suffix array over each document's words.

The longest-common-prefix intervals of the suffix array are its maximal repeated substrings.
An interval of value v puts a span of v words at each of its suffixes, so the union of the
spans of all intervals of at least ``min_words`` words is the union, over positions i, of
[i, i + L(i)), where L(i) is the larger of the two common prefixes beside suffix i.  A document
is dropped if that union covers too large a share of its words or if its longest repeat is too
long.  One suffix array serves a chunk of documents: a suffix starts with its document's number
in its first key, so no repeat spans two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import SpanHasher, arrow_map, chunks, code_points, counts_by, is_ascii_space, line_spans, word_spans

RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_repeated_substrings long"
)

#: Characters that count as symbols, fixed by the rule.
SYMBOLS = "#*$%&|<>"

WINDOW = 8
MIN_REPEAT = 4
MAX_COVERED = 0.4
MAX_LONGEST = 100


def repeats(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word position the longest repeat that starts there, and the number of intervals
    (maximal repeated substrings) by the text of one of their suffixes, by prefix doubling.

    ``words`` are word identities and ``text`` the document of each, in ascending order.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest, np.zeros(n, np.int64)
    order = np.lexsort((words, text))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    last = np.searchsorted(text, text, side="right")  # the end of each position's text
    levels = [rank]
    step = 1
    # Only suffixes whose rank isn't unique yet take part; a rank is its group's first place.
    groups = np.append(np.flatnonzero(new), n)
    open_ = np.repeat(np.diff(groups) > 1, np.diff(groups))
    place = np.flatnonzero(open_)
    while len(place):
        suffix = order[place]
        beyond = suffix + step
        follow = np.where(beyond < last[suffix], rank[np.minimum(beyond, n - 1)], -1)
        head = rank[suffix]
        key = head * np.int64(n + 1) + follow + 1
        sort = np.argsort(key, kind="stable")
        suffix, key, head = suffix[sort], key[sort], head[sort]
        order[place] = suffix
        fresh = np.ones(len(place), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        edges = np.flatnonzero(fresh)
        rank[suffix] = place[edges][np.cumsum(fresh) - 1]
        levels.append(rank)
        step *= 2
        sizes = np.diff(np.append(edges, len(place)))
        place = place[np.repeat(sizes > 1, sizes)]
    # Common prefix of neighbours, by the levels' ranks from long to short.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero((levels[0][a] == levels[0][b]))
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        inside = (x < last[a[live]]) & (y < last[b[live]])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        # Ranks of a level are equal for suffixes alike in that many words, if both have them.
        same &= (x + (1 << k) <= last[a[live]]) & (y + (1 << k) <= last[b[live]])
        lcp[live[same]] += 1 << k
    both = np.zeros(n + 1, np.int64)
    both[1:n] = lcp
    longest[order] = np.maximum(both[:-1], both[1:])
    # An interval's first place of its value is one before which the last smaller or equal value is smaller.
    before = np.arange(n - 1) - 1
    live = np.flatnonzero(lcp[:-1] > lcp[1:]) + 1
    while len(live):  # what lies between a place and its pointer is larger than the place's own value
        before[live] = before[before[live]]
        live = live[(before[live] >= 0) & (lcp[before[live]] > lcp[live])]
    first = (lcp > 0) & ((before < 0) | (lcp[before] < lcp))
    intervals = np.zeros(n, np.int64)
    intervals[order[1:][first]] = 1
    return longest, intervals


def covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(texts)
    points, starts = code_points(texts)
    hasher = SpanHasher(points)
    begin, end, text = word_spans(points, starts)
    out = {"n_words": counts_by(text, n), "word_chars": counts_by(text, n, end - begin)}
    symbol = np.flatnonzero(np.isin(points, np.array([ord(c) for c in SYMBOLS], np.uint32)))
    out["n_symbols"] = counts_by(np.searchsorted(starts, symbol, side="right") - 1, n)
    line_begin, line_end, line_text = line_spans(points, starts)
    solid = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~is_ascii_space(points), out=solid[1:])
    worded = solid[line_end] > solid[line_begin]
    line_text = line_text[worded]
    lines = hasher(line_begin[worded], line_end[worded])
    order = np.lexsort((lines, line_text))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    out["n_dup_lines"] = counts_by(line_text[order][again], n)
    longest, intervals = repeats(hasher(begin, end).view(np.int64), text)
    total = len(longest)
    at = np.flatnonzero(longest >= WINDOW)
    out["n_repeat_words"] = counts_by(text[covered(at, np.full(len(at), WINDOW), total)], n)
    at = np.flatnonzero(longest >= min_repeat)
    out["covered_words"] = counts_by(text[covered(at, longest[at], total)], n)
    out["n_repeated_substrings"] = counts_by(text, n, intervals)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], text, longest)
    return out


def repetition_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text), over the whole text.

    A null or empty text has no words and fails the base rule (fewer than 20 words).  Repeated
    rows give repeated results, a null doc_id stays null, other columns are left aside and an
    empty table gives no rows.
    """

    def rules(batches):
        for rows, texts in chunks(batches, "text"):
            m = measure(texts, min_repeat)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            passes = (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            more = ["covered_words", "longest_repeat", "n_repeated_substrings"]
            columns = [rows.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in names), pa.array(failed)]
            columns += [pa.array(passes & ~failed), *(pa.array(m[c], pa.int64()) for c in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", *more])

    return arrow_map(docs.select("doc_id", "text"), rules, RULES)
