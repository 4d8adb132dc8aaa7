"""MinHash near-duplicates with tensored banding.

A document is the set of its word shingles.  Two small collections of keys are computed, ``KEYS`` in
each and every key made of ``ROWS`` minhash values; the tables' keys are all pairs of a key of the
first and a key of the second collection.  So KEYS * KEYS tables of 2 * ROWS values each cost
2 * KEYS * ROWS minhash values, about the square root of what tables of their own would.  Sets of
similarity s share a key of one collection with probability 1 - (1 - s ** ROWS) ** KEYS, and in
tables they meet as often as the product of the shared keys of either collection: a pair that meets
in fewer than ``MEETINGS`` tables is no candidate.  At s = 0.8 that misses about 7 in a million pairs.

Candidates are verified on whole sets, and what is wanted are classes.  Equal sets are one
representative from the start.  Then ``STARS`` tables link each document with two heads of its
tables, a head being the document whose tables have most documents, of near copies the one that
most of the others are near to; that settles large groups in a few pairs for each member.  After
that only keys, and then only tables, count that hold documents of several classes, and in a table
pairs of different classes are wanted.  Each of these documents is held against a reference, the
head that most of its kind are near to, and only its difference from it is kept.  Two sets of
one reference differ by what is in just one of their differences, so these give the links within
a reference exactly, in blocks that only links leave; pairs of other references are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import arrow_groups, arrow_map, chunks, mix64
from .components import connected_components
from .jaccard_join import alike, shingle_sets, verified
from .storage import narrowed, stored

#: Keys of a collection and minhash values of a key.
KEYS, ROWS = 24, 4
#: Tables, each of a key of either collection, that give every document's first pairs.
STARS = 12
#: Tables that a candidate pair is in at least.
MEETINGS = 4
#: Documents of a table or reference that one task pairs with others, about.
SHARE = 2_000

_DRAWS = mix64(np.arange(1, 4 * KEYS * ROWS + 1, dtype=np.uint64)).astype(np.uint32).reshape(2, 2 * KEYS, ROWS)
_FLIPS, _FACTORS = _DRAWS[0], _DRAWS[1] | np.uint32(1)


def minhash_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 * KEYS 64-bit keys for each set (hashes and bounds as of ``shingle_sets``); zeros for an empty one."""
    filled = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, 2 * KEYS), np.uint64)
    if not len(filled):
        return keys.view(np.int64)
    starts = bounds[:-1][filled]
    drawn = (values.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    mixed = np.empty_like(drawn)
    least = np.empty((ROWS, len(filled)), np.uint64)
    for t in range(2 * KEYS):
        for r in range(ROWS):
            np.bitwise_xor(drawn, _FLIPS[t, r], out=mixed)
            np.multiply(mixed, _FACTORS[t, r], out=mixed)
            least[r] = np.minimum.reduceat(mixed, starts)
        key = np.full(len(filled), t + 1, np.uint64)
        for r in range(0, ROWS, 2):
            key = mix64(key + (least[r] << np.uint64(32) | least[min(r + 1, ROWS - 1)]))
        keys[filled, t] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the size (n) and a 128-bit fingerprint (k1, k2) of each row's set, and its keys."""

    def signed(batches):
        for rows, texts in chunks(batches, "text"):
            values, bounds = shingle_sets(texts, size)
            raw, prints = values.view(np.uint64), []
            for mixed in (mix64(raw + np.uint64(1)), mix64(raw ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                prints.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
            lists = pa.array(np.arange(0, 2 * KEYS * len(texts) + 1, 2 * KEYS, dtype=np.int32))
            keys = pa.ListArray.from_arrays(lists, pa.array(minhash_keys(values, bounds).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), *prints, keys], ["doc_id", "n", "k1", "k2", "keys"])

    return arrow_map(docs.select("doc_id", "text"), signed, "doc_id long, n long, k1 long, k2 long, keys array<long>")


def star_pairs(signed: DataFrame) -> DataFrame:
    """Pairs (a, b): each document b with the head that it shares most tables with, and with the head of the fullest tables."""
    tables = F.array(*(F.xxhash64(F.col("keys")[i], F.col("keys")[KEYS + i], F.lit(i)) for i in range(STARS)))
    rows = signed.select("node", F.explode(tables).alias("table"))
    several = rows.groupBy("table").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(rows.join(several, "table"), "star-tables").frame
    full = met.groupBy("node").agg(F.sum("members").alias("full"))
    heads = met.join(full, "node").groupBy("table").agg(F.max(F.struct("full", (-F.col("node")).alias("a"))).alias("head"))
    pairs = met.join(heads, "table").select("node", (-F.col("head.a")).alias("a"), "head.full").filter("a <> node")
    pairs = pairs.groupBy("node", "a", "full").agg(F.count("*").alias("common")).groupBy(F.col("node").alias("b"))
    best = pairs.agg(F.max(F.struct("common", (-F.col("a")).alias("a"))).alias("nearest"), F.max(F.struct("full", (-F.col("a")).alias("a"))).alias("fullest"))
    return best.select(F.explode(F.array_distinct(F.array(-F.col("nearest.a"), -F.col("fullest.a")))).alias("a"), "b")


def spanning(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in several classes (component)."""
    several = rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(key)
    return rows.join(several, key, "left_semi")


def references(members: DataFrame) -> DataFrame:
    """ref of each node of ``members`` (node, key): of the heads of its keys the one with the fullest keys, maybe itself."""
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    full = members.join(sizes, "key").groupBy("node").agg(F.sum("members").alias("full"))
    rank = F.max(F.struct("full", (-F.col("node")).alias("minus"))).alias("head")
    heads = members.join(full, "node").groupBy("key").agg(rank)
    best = members.join(heads, "key").groupBy("node").agg(F.max("head").alias("head"))
    return best.select("node", (-F.col("head.minus")).alias("ref"))


def differences(placed: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``placed`` (node, component, ref) with the set's size (n), how many shingles of it and of its
    reference's aren't in both (delta), and those of them (tokens) that a node of the same reference
    and another class has, too."""
    asked = stored(placed, "references").frame
    shares = asked.groupBy("ref").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    groups = asked.join(shares, "ref").select("node", "component", "ref", F.pmod(F.xxhash64("node"), "shares").alias("share"))
    ids = asked.select("node").unionByName(asked.select(F.col("ref").alias("node"))).distinct()
    texts = narrowed(docs.select("doc_id", "text"), ids).join(ids, F.col("doc_id") == F.col("node"), "left_semi")
    texts = stored(texts.distinct(), "placed-texts").frame

    def compared(batches):
        for batch in batches:
            for rows, own in chunks([batch], "own"):
                others = [text or "" for text in rows.column("other").to_pylist()]
                known = {text: len(own) + k for k, text in enumerate(dict.fromkeys(others))}
                values, bounds = shingle_sets([*own, *known], size)
                tokens, sizes = [], []
                for k, text in enumerate(others):
                    at = known[text]
                    x, y = values[bounds[k] : bounds[k + 1]], values[bounds[at] : bounds[at + 1]]
                    # What is missing is another thing than what is more.
                    tokens += [np.setdiff1d(x, y, assume_unique=True), ~np.setdiff1d(y, x, assume_unique=True)]
                    sizes.append(len(tokens[-1]) + len(tokens[-2]))
                lists = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                tokens = pa.ListArray.from_arrays(lists, pa.array(np.concatenate(tokens)))
                columns = [*(rows.column(c) for c in ("node", "component", "ref")), pa.array(np.diff(bounds)[: len(own)]), pa.array(np.array(sizes, np.int64)), tokens]
                yield pa.RecordBatch.from_arrays(columns, ["node", "component", "ref", "n", "delta", "tokens"])

    one = texts.select(F.col("doc_id").alias("node"), F.col("text").alias("own"))
    two = texts.select(F.col("doc_id").alias("ref"), F.col("text").alias("other")).join(groups.select("ref", "share").distinct(), "ref")
    joined = groups.join(one, "node").join(two, ["ref", "share"]).select("node", "component", "ref", "own", "other")
    found = stored(arrow_map(joined, compared, "node long, component long, ref long, n long, delta long, tokens array<long>").distinct(), "differences").frame
    # A document of several texts has several rows, each with a number of its own.
    named = stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "named-differences").frame
    keyed = named.select("row", "component", F.explode("tokens").alias("token"), F.xxhash64("ref", "token").alias("key"))
    common = spanning(keyed, "key").groupBy("row").agg(F.collect_list("token").alias("tokens"))  # within the row's own
    return named.drop("tokens").join(common, "row", "left").drop("row")


def _linked(rows: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between rows of either side of one reference: of two classes the first."""
    side = rows.column("side").to_numpy(zero_copy_only=False)
    parts = [rows.filter(pa.array(side == k)) for k in (0, 1)]
    node, component, n, delta = ([p.column(c).to_numpy() for p in parts] for c in ("node", "component", "n", "delta"))
    owners, tokens = [], []
    for p in parts:
        lists = p.column("tokens").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
        owners.append(np.repeat(np.arange(len(lists)), sizes))
        tokens.append(lists.flatten().to_numpy())
    order = [np.argsort(t, kind="stable") for t in tokens]
    tokens, owners = ([x[o] for x, o in zip(both, order, strict=True)] for both in (tokens, owners))
    common = np.zeros((len(node[0]), len(node[1])), np.int32)
    both = np.intersect1d(*tokens)
    bounds = [(np.searchsorted(t, both), np.searchsorted(t, both, side="right")) for t in tokens]
    for b0, e0, b1, e1 in zip(*(x.tolist() for pair in bounds for x in pair), strict=True):
        common[np.ix_(owners[0][b0:e0], owners[1][b1:e1])] += 1
    apart = delta[0][:, None] + delta[1][None, :] - 2 * common
    near = ((100 + percent) * apart <= (100 - percent) * (n[0][:, None] + n[1][None, :])) & (component[0][:, None] != component[1][None, :])
    x, y = np.nonzero(near)
    classes = np.stack([component[0][x], component[1][y]], axis=1)
    _, first = np.unique(classes, axis=0, return_index=True)
    return pa.Table.from_arrays([pa.array(node[0][x[first]]), pa.array(node[1][y[first]])], ["a", "b"])


def near_links(facts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one reference, by their differences from it.

    Those outside a reference's largest class meet all of that reference, in blocks of about
    ``SHARE`` by ``SHARE``; only links leave a block.
    """
    sizes = facts.groupBy("ref", "component").count().groupBy("ref").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("members"))
    sizes = sizes.select("ref", F.col("top.component").alias("largest"), F.ceil(F.col("members") / SHARE).alias("blocks"), (F.col("members") > F.col("top.count")).alias("several"))
    rows = facts.join(sizes.filter("several"), "ref").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ("ref", "i", "j", "side", "node", "component", "n", "delta", "tokens")
    x = rows.filter("component <> largest").withColumns({"i": F.col("block"), "side": F.lit(0)}).withColumn("j", other).select(*columns)
    y = rows.withColumns({"j": F.col("block"), "side": F.lit(1)}).withColumn("i", other).select(*columns)
    return arrow_groups(x.unionByName(y), ["ref", "i", "j"], lambda group: _linked(group, percent), "a long, b long")


def remaining_links(signed: DataFrame, labels: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Between different classes: links (a, b) of documents of one reference, and candidate pairs of others."""
    placed = signed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keyed = placed.select("node", "n", "component", F.posexplode("keys").alias("place", "key"))
    kept = spanning(keyed, "key").groupBy("node", "n", "component").agg(F.collect_list(F.struct("place", "key")).alias("keys"))  # at most 2 * KEYS
    kept = stored(kept, "spanning-keys").frame
    side = lambda test: F.transform(F.filter("keys", lambda k: test(k["place"])), lambda k: k["key"])
    pairs = kept.select("node", "n", "component", F.explode(side(lambda p: p < KEYS)).alias("one"), side(lambda p: p >= KEYS).alias("others"))
    rows = pairs.select("node", "n", "component", "one", F.explode("others").alias("other")).select("node", "n", "component", F.xxhash64("one", "other").alias("table"))
    rows = stored(spanning(rows, "table"), "tables").frame
    there = rows.select("node", "component").distinct()
    members = kept.join(there.select("node"), "node", "left_semi").select("node", F.explode("keys.key").alias("key"))
    refs = stored(references(members), "refs").frame
    facts = stored(differences(there.join(refs, "node"), docs, size), "facts").frame
    rows = rows.join(refs, "node")
    sizes = rows.groupBy("table", "ref").count().groupBy("table").agg(F.max(F.struct("count", "ref")).alias("top"), F.sum("count").alias("members"))
    sizes = sizes.filter(F.col("members") > F.col("top.count")).select("table", F.col("top.ref").alias("largest"), F.ceil(F.col("members") / SHARE).alias("shares"))
    rows = rows.join(sizes, "table")
    of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "ref")]
    x = rows.filter("ref <> largest").select("table", F.pmod(F.xxhash64("node"), "shares").alias("share"), *of("x"))
    y = rows.select("table", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), (F.col("ref") == F.col("largest")).alias("inside"), *of("y"))
    once = F.col("inside") | (F.col("node_x") < F.col("node_y"))
    met = x.join(y, ["table", "share"]).filter((F.col("component_x") != F.col("component_y")) & (F.col("ref_x") != F.col("ref_y")) & once & alike("n_x", "n_y", percent))
    met = met.groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).count()
    return near_links(facts, percent), met.filter(F.col("count") >= MEETINGS).select("a", "b")


def minhash_components(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Link rows of ``docs`` (doc_id, text) whose shingle sets have
    100 * |intersection| >= percent * |union|: doc_id, n_shingles, component_id and kept for each row.

    ``component_id`` is the smallest doc_id reachable and ``kept`` tells whether it is the row's own.
    A null, empty or wordless text has an empty set and links with nothing.  Repeated rows are one
    document and give equal results; of one doc_id with several texts any link counts for all.  A
    null doc_id is in no component (null), and its row is kept.  Other columns are left aside; an
    empty table gives no rows.  Linked sets are found with the probabilities above, and a
    component is missed only if all its links between two parts are; no pair is linked unverified.
    """
    docs = docs.select("doc_id", "text")
    known = stored(signatures(docs, size), "signatures").frame
    named = known.filter("n > 0 and doc_id is not null")
    classes = stored(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), "classes").frame
    # Different sets can't be similar enough if one has so few shingles.
    signed = named.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).join(classes, ["k1", "k2", "n"]).filter(F.col("doc_id") == F.col("node"))
    signed = stored(signed.dropDuplicates(["k1", "k2", "n"]).select("node", "n", "keys"), "signed")
    links = verified(star_pairs(signed.frame), docs, size, percent)
    # Classes that a few rounds of labels leave apart cost time only: the last components have all links.
    labels = connected_components(links.frame, rounds=3)
    links.drop()
    near, pairs = remaining_links(signed.frame, labels.frame, docs, size, percent)
    more = verified(pairs, docs, size, percent)
    signed.drop()
    same = labels.frame.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    # A doc_id with several texts is one node through its classes' representatives.
    twice = named.groupBy("doc_id").agg(F.min("k1").alias("k"), F.max("k1").alias("l")).filter("k < l")
    bridges = named.select("doc_id", "k1", "k2", "n").join(twice.select("doc_id"), "doc_id", "left_semi").join(classes, ["k1", "k2", "n"])
    bridges = bridges.filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    whole = connected_components(more.frame.unionByName(near).unionByName(same).unionByName(bridges)).frame
    labels.drop()
    more.drop()
    reached = classes.join(whole, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    out = known.select("doc_id", "n", "k1", "k2").join(reached, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
