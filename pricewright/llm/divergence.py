"""Divergence of sources: how far the term shares of (lang, source) groups are apart, exactly.

A term's share in a group is an integer, parts of 10**9 with additive smoothing, so a term that a
group lacks has the group's base share.  The distance of two groups of a lang is the sum of the
absolute differences of their shares over all kept terms of that lang.

The sum is split by how many groups have a term.  Heavy terms, found in ``HEAVY`` of a lang's
groups or more, are laid out as dense tiles: a block of groups by a bucket of terms, where all
pairs of rows are subtracted.  Light terms are posting lists.  For groups g and h with base shares
a and b, V kept terms and shares p and q::

    sum over all terms  =  V |a - b|
                        +  sum over a tile's heavy terms (|p - q| - |a - b|)
                        +  sum over g's light terms (|p - b| - |a - b|)
                        +  sum over h's light terms (|q - a| - |a - b|)
                        +  sum over common light terms (|p - q| - |p - b| - |q - a| + |a - b|)

The first and the third and fourth need only how often each share occurs in a group; the last is a
sparse correction for each pair of one posting list.  Tiles, posting corrections and base sums are
integers, added in any order, so the result is exact.

Blocks and buckets bound every task: at most about ``BLOCK`` groups on either side and
``BUCKET`` terms, whatever a group's or a lang's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import arrow_groups, arrow_map, chunks, mix64
from .storage import stored, written
from .terms import Terms, is_letter, tallied

MIN_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
#: Terms in this part of a lang's groups, or more, are heavy.
HEAVY = 0.5
BLOCK = 128
BUCKET = 2048
#: Counted terms that a task holds before it passes their sums on.
HELD = 1 << 19


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) in part of the rows; null lang,
    source and text are empty.  A row with a null term names each group, with terms or without."""

    def counted(batches):
        numbers: dict[tuple[str, str], int] = {}
        named = 0
        held, amount = [], 0

        def summed():
            keys, group, n, docs = (np.concatenate([h[i] for h in held]) for i in range(4))
            first, inverse, _ = tallied(keys)
            names = list(numbers)
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group[first])) for i in range(2))
            terms = pa.chunked_array([h[4] for h in held], pa.string()).take(pa.array(first)).combine_chunks()
            total = [pa.array(np.bincount(inverse, weights=x, minlength=len(first)).astype(np.int64)) for x in (n, docs)]
            return pa.RecordBatch.from_arrays([lang, source, terms, *total], ["lang", "source", "term", "n", "docs"])

        for rows, texts in chunks(batches, "text"):
            pairs = zip(*([x or "" for x in rows.column(c).to_pylist()] for c in ("lang", "source")), strict=True)
            group = np.array([numbers.setdefault(pair, len(numbers)) for pair in pairs], np.int64)
            terms = Terms(texts, is_letter)
            # Occurrences in a document, then documents and occurrences in a group.
            first, _, times = tallied(terms.hashes ^ mix64(terms.text.astype(np.uint64) + np.uint64(1)))
            of = group[terms.text[first]]
            keys = terms.hashes[first] ^ mix64(of.astype(np.uint64) + np.uint64(1 << 40))
            one, inverse, docs = tallied(keys)
            n = np.bincount(inverse, weights=times, minlength=len(one)).astype(np.int64)
            held.append((keys[one], of[one], n, docs, pa.array(terms.strings(first[one]), pa.string())))
            amount += len(one)
            if amount >= HELD:
                yield summed()
                held, amount = [], 0
        if held and amount:
            yield summed()
        new = list(numbers)[named:]
        none = pa.array(np.zeros(len(new), np.int64))
        columns = [pa.array([x[i] for x in new], pa.string()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(new), pa.string()), none, none], ["lang", "source", "term", "n", "docs"])

    return arrow_map(docs.select("text", "lang", "source"), counted, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * n / total) for n <= total < 9 * 10**15, three digits at a time, in 64 bits."""
    digits, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + F.floor(_quotient(rest, total)), rest % total
    return digits + 1


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _absolute_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all rows of ``left`` and ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, row in enumerate(left):
        out[i] = np.abs(right - row).sum(axis=1)
    return out


def dense_sums(base: np.ndarray, place: np.ndarray, term: np.ndarray, p: np.ndarray, terms: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What heavy terms add to the distances of the base shares, for the groups of ``left`` and ``right`` (places in ``base``)."""
    tile = np.repeat(base[:, None], terms, axis=1)
    tile[place, term] = p
    return _absolute_sums(tile[left], tile[right]) - terms * np.abs(base[left][:, None] - base[right][None, :])


def base_sums(base: np.ndarray, terms: int, place: np.ndarray, p: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The distances of the base shares over all terms, and what light terms add for each group alone:
    how often (times) it has p."""
    gap = np.abs(base[left][:, None] - base[right][None, :])
    out = terms * gap
    order = np.lexsort((p, place))
    place, p, times = place[order], p[order], times[order]
    bounds = np.searchsorted(place, np.arange(len(base) + 1))
    for own, others, sums, gaps in ((left, right, out, gap), (right, left, out.T, gap.T)):
        for i, g in enumerate(own.tolist()):
            values, n = p[bounds[g] : bounds[g + 1]], times[bounds[g] : bounds[g + 1]]
            if len(values):
                many, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * values))
                cut = np.searchsorted(values, base[others])
                below, above = base[others] * many[cut] - total[cut], total[-1] - total[cut] - base[others] * (many[-1] - many[cut])
                sums[i] += below + above - gaps[i] * many[-1]
    return out


def sparse_sums(base: np.ndarray, place: np.ndarray, term: np.ndarray, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Corrections for light terms that both groups have, from the pairs of each posting list."""
    at = np.full((2, len(base)), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.int64)
    order = np.argsort(term, kind="stable")
    place, p, term = place[order], p[order], term[order]
    ends = np.flatnonzero(np.diff(term, append=-1)) + 1
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        g, own = place[begin:end], p[begin:end]
        x, y = np.flatnonzero(at[0, g] >= 0), np.flatnonzero(at[1, g] >= 0)
        a, b, pa_, pb = base[g[x]][:, None], base[g[y]][None, :], own[x][:, None], own[y][None, :]
        out[(at[0, g[x]][:, None] * len(right) + at[1, g[y]][None, :]).ravel()] += (
            np.abs(pa_ - pb) - np.abs(pa_ - b) - np.abs(pb - a) + np.abs(a - b)
        ).ravel()
    return out.reshape(len(left), len(right))


def _tile(rows: pa.Table) -> pa.Table:
    """Partial distances of one tile: lang, g, h and value."""
    source = rows.column("source").combine_chunks().dictionary_encode()
    names, place = source.dictionary, source.indices.to_numpy()
    lang, kind, i, j = (rows.column(c)[0].as_py() for c in ("lang", "kind", "i", "j"))
    block, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    block[place], base[place] = rows.column("block").to_numpy(), rows.column("base").to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    given = np.flatnonzero(rows.column("p").is_valid().to_numpy(zero_copy_only=False))
    part = rows.take(pa.array(given))
    place, p = place[given], part.column("p").to_numpy()
    if kind == "base":
        value = base_sums(base, rows.column("v")[0].as_py(), place, p, part.column("times").to_numpy(), left, right)
    else:
        term = part.column("term").combine_chunks().dictionary_encode()
        code = term.indices.to_numpy()
        if kind == "heavy":
            value = dense_sums(base, place, code, p, len(term.dictionary), left, right)
        else:
            value = sparse_sums(base, place, code, p, left, right)
    g, h = np.repeat(left, len(right)), np.tile(right, len(left))
    once = np.flatnonzero((g < h) if i == j else np.ones(len(g), bool))
    columns = [pa.array([lang] * len(once), pa.string()), names.take(pa.array(g[once])), names.take(pa.array(h[once])), pa.array(value.ravel()[once])]
    return pa.Table.from_arrays(columns, ["lang", "g", "h", "value"])


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row for every pair of blocks (i, j) that has its own block."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _distances(groups: DataFrame, kept: DataFrame, heavy: float) -> DataFrame:
    """lang, g, h and value of each unordered pair of groups of a lang."""
    group = groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).select("lang", "source", "base", "block", "blocks", "v", "light", "heavy", "n_groups")
    rows = kept.select("lang", "source", "term", "p", "spread").join(group, ["lang", "source"])
    many = F.col("spread") >= heavy * F.col("n_groups")
    buckets = F.greatest(F.lit(1).cast("long"), F.ceil(F.when(F.col("kind") == "heavy", F.col("heavy")).otherwise(F.col("light")) / BUCKET))
    postings = rows.withColumn("kind", F.when(many, "heavy").otherwise("light")).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets))
    values = rows.filter(~many).groupBy("lang", "source", "p", "base", "block", "blocks", "v").agg(F.count("*").alias("times"))
    none = {"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long"), "times": F.lit(None).cast("long")}
    every = group.withColumns(none)
    columns = ("lang", "source", "kind", "bucket", "term", "p", "times", "base", "block", "blocks", "v")
    dense = every.filter("heavy > 0").withColumn("kind", F.lit("heavy")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
    whole = (
        postings.withColumn("times", none["times"]).select(*columns)
        .unionByName(dense.select(*columns))
        .unionByName(every.withColumn("kind", F.lit("base")).withColumn("bucket", F.lit(0).cast("long")).select(*columns))
        .unionByName(values.withColumn("kind", F.lit("base")).withColumn("bucket", F.lit(0).cast("long")).withColumn("term", none["term"]).select(*columns))
    )
    parts = arrow_groups(_tiled(whole), ["lang", "i", "j", "kind", "bucket"], _tile, "lang string, g string, h string, value long")
    ordered = parts.select("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "value")
    return ordered.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, heavy: float = HEAVY) -> DataFrame:
    """The audit of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    A lang keeps the terms that ``min_docs`` of its rows have.  Part ``pair`` ranks each group's
    distances to all other sources of its lang, part ``term`` the ``top`` kept terms that the group
    has and uses more than its lang does.  Ranks go by value, descending, and UTF-8 item.

    Null text, lang and source are empty strings, and such groups are groups like others; a group
    without terms has pairs, too.  Repeated rows count again, other columns are left aside, and an
    empty table gives no rows.
    """
    counted = stored(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted-terms")
    present = counted.frame.filter("term is not null")
    terms = present.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("spread"))
    terms = terms.filter(F.col("docs") >= min_docs).drop("docs")
    held = stored(present.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    kept = held.frame
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.frame.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna({"total": 0})
    sized = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("total").alias("lang_total"))
    spreads = kept.groupBy("lang", "term").agg(F.first("spread").alias("spread")).join(sized.select("lang", "n_groups"), "lang")
    kinds = spreads.groupBy("lang").agg(F.count("*").alias("v"), F.count_if(F.col("spread") >= heavy * F.col("n_groups")).alias("heavy"))
    sized = sized.join(kinds, "lang", "left").fillna({"v": 0, "heavy": 0})
    room = lambda total: F.col(total) + SMOOTHING * F.col("v")
    base = F.when(F.col("v") > 0, share(F.lit(SMOOTHING).cast("long"), room("total"))).otherwise(F.lit(0).cast("long"))
    groups = groups.join(sized, "lang").withColumns({"base": base, "light": F.col("v") - F.col("heavy"), "blocks": F.ceil(F.col("n_groups") / BLOCK)})
    groups = written(groups, "divergence-groups")
    counted.drop()

    facts = groups.select("lang", "source", "total", "lang_total", "v")
    shares = kept.join(facts, ["lang", "source"]).withColumn("p", share(F.col("n") + SMOOTHING, room("total")))
    shares = written(shares.withColumn("q", share(F.col("lang_n") + SMOOTHING, room("lang_total"))).select("lang", "source", "term", "spread", "p", "q"), "shares")
    held.drop()
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = _distances(groups, shares, heavy)
    both = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"))))
    apart = pairs.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return apart.select("*", rank).unionByName(over.select("*", rank).filter(F.col("rank") <= top))
