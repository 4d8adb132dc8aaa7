"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word shingles.  All sets are put in one global order, frequent
shingles last.  If two sets share at least t shingles, then the first |x| - t + l of one and the
first |y| - t + l of the other share at least l; here t is the least overlap that a set's own
size allows.  Each document chooses its l: a longer prefix asks for more shared shingles, which
pays where its prefix holds shingles that many documents have.  A pair is a candidate if its
prefixes share at least the smaller l of the two, and candidates are verified on whole sets.
The k-th shared shingle has k - 1 before it, and so leaves room for t only if it stands early
enough in both sets; shared shingles that don't, with l for k, needn't be counted.

Of a pair, call the document whose prefix ends first in the global order the earlier one.  A
shingle of its prefix that is in no other document's prefix isn't in the other set at all, so
what both sets share is at most the earlier one's listed shingles and those beyond its prefix.
Nor does the earlier one have the later one's unlisted shingles of frequency 1, if its prefix goes
beyond that frequency.  With shingles counted well that leaves few pairs that aren't links.

Equal sets are one representative from the start.  What is wanted are classes, so no pair whose
ends are already in one class is looked at again: first each document is verified against the
document of its lists that has the fewest shingles of its own, which settles large groups of
copies in as many pairs as they have members; then every remaining candidate pair between
different classes is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import CHUNK_CHARS, SpanHasher, arrow_map, chunks, code_points, lower_ascii, mix64, word_spans
from .components import connected_components
from .storage import Stored, fresh, narrowed, stored

#: A speed parameter: how many of the most frequent shingles have their frequency in the order.
FREQUENT = 200_000
#: Shingles counted together before those that occur twice or more go to the shuffle.
COUNTED = 1 << 21
#: Prefixes may ask for that many shared shingles.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Other documents that the cost estimate expects for a shingle not among the frequent ones.
UNSEEN = 0.2
#: What verifying a pair costs for each shingle of a set, a meeting of two documents in a list being 1.
VERIFYING = 1 / 256
#: Documents of a frequent shingle in one list, and pairs of a document in one group, about.
LIST_SHARE = 1_000
#: Frequencies are found in so many classes an octave.
OCTAVE = 16


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes) of the texts, in ascending order within each, and their bounds.

    Words are runs of other than ASCII white space, A-Z in lower case.  A text of fewer than
    ``size`` words has its whole sequence as its one shingle, one without words none.
    """
    points, starts = code_points(texts)
    points = lower_ascii(points)
    begin, end, text = word_spans(points, starts)
    words = SpanHasher(points)(begin, end)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    count = np.diff(first)
    multipliers = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(len(words), bool)
    if len(words) >= size:
        full[: len(words) - size + 1] = text[: len(words) - size + 1] == text[size - 1 :]
    at = np.flatnonzero(full)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(size):
        hashes += words[at + j] * multipliers[j]
    short = np.flatnonzero((count > 0) & (count < size))
    few = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = count[short] > j
        few[has] += words[first[short[has]] + j] * multipliers[j]
    few += (count[short] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    owner = np.concatenate([text[at], short])
    values = mix64(np.concatenate([hashes, few])).view(np.int64)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts.  Rows of kind 0 describe a document: its id, its set's size and a
    128-bit fingerprint of the set; rows of kind 1 count a frequent shingle in part of the rows."""

    def described(batches):
        held, amount = [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = np.flatnonzero(counts > 1)
            none = np.zeros(len(many), np.int64)
            arrays = [np.ones(len(many), np.int8), values[many], none, none, counts[many].astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["kind", "k1", "k2", "doc_id", "n"])

        for rows, texts in chunks(batches, "text"):
            values, bounds = shingle_sets(texts, size)
            held.append(values)
            amount += len(values)
            raw = values.view(np.uint64)
            one = _sums(mix64(raw + np.uint64(1)), bounds)
            two = _sums(mix64(raw ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
            arrays = [pa.array(np.zeros(len(texts), np.int8)), pa.array(one), pa.array(two), rows.column("doc_id"), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "k1", "k2", "doc_id", "n"])
            if amount >= COUNTED:
                yield frequent()
                held, amount = [], 0
        if held:
            yield frequent()

    return arrow_map(docs.select("doc_id", "text"), described, "kind byte, k1 long, k2 long, doc_id long, n long")


def choose_matches(frequency: np.ndarray, size: int, least: int) -> int:
    """The number of shared shingles to ask for, by estimated cost.

    ``frequency`` has how many documents the set's shingles are in, in the global order.  Other
    documents met in the prefix are looked up, and at most a matches-th of them can be met that
    often, to be verified at a cost by the set's size.
    """
    best, cheapest = 1, None
    for matches in MATCHES:
        if matches > least:
            break
        met = float(np.maximum(frequency[: size - least + matches] - 1, UNSEEN).sum())
        cost = met + (size - least + matches) + VERIFYING * size * met / matches
        if cheapest is None or cost < cheapest:
            best, cheapest = matches, cost
    return best


def frequencies(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` shingles (k1) of the highest counts (n), ascending, and the counts."""
    octaves = F.floor(F.log2("n") * OCTAVE).alias("octave")
    amounts = {r["octave"]: r["count"] for r in counted.groupBy(octaves).count().collect()}  # at most 64 octaves' classes
    least, total = None, 0
    for octave in sorted(amounts, reverse=True):
        total += amounts[octave]
        if total > FREQUENT:
            break
        least = octave
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counted.filter(octaves >= least).select("k1", "n").toArrow()  # at most FREQUENT rows of two numbers
    values, counts = (rows.column(c).to_numpy() for c in ("k1", "n"))
    order = np.argsort(values)
    return values[order], counts[order]


def prefixes(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every document with a shingle: doc_id, k1 (half of its set's fingerprint), n, matches, where its
    prefix ends in the global order (end), how many of its shingles have frequency 1 (single), and
    the prefix as tokens and salts.

    A frequent shingle's documents are split, by salts from 1 on, into lists of about
    ``LIST_SHARE``; salts 0 and, of frequency 1, -1 are undivided lists.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches):
        known, counts = shared.value
        for rows, texts in chunks(batches, "text"):
            values, bounds = shingle_sets(texts, size)
            one = _sums(mix64(values.view(np.uint64) + np.uint64(1)), bounds)
            frequency = np.ones(len(values), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                hit = known[place] == values
                frequency[hit] = counts[place[hit]]
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            order = np.lexsort((values, frequency, owner))
            values, frequency = values[order], frequency[order]
            sizes = np.diff(bounds)
            least = -(-percent * sizes // 100)
            matches, length = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for d in np.flatnonzero(sizes).tolist():
                n, t = int(sizes[d]), int(least[d])
                matches[d] = choose_matches(frequency[bounds[d] : bounds[d] + n - t + MATCHES[-1]], n, t)
                length[d] = n - t + matches[d]
            first = np.cumsum(length) - length
            at = np.repeat(bounds[:-1] - first, length) + np.arange(int(length.sum()))
            lists = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            shares = -(-frequency[at] // LIST_SHARE)
            draw = mix64(one.view(np.uint64)) >> np.uint64(33)
            salt = np.where(shares > 1, 1 + (np.repeat(draw, length) % shares.astype(np.uint64)).astype(np.int32), 0).astype(np.int32)
            salt[frequency[at] == 1] = -1
            single = np.concatenate([[0], np.cumsum(salt == -1)])
            single = single[lists[1:]] - single[lists[:-1]]
            last = np.where(length > 0, bounds[:-1] + length - 1, 0)
            ends = [pa.array(x[last] if len(x) else np.zeros(len(texts), np.int64)) for x in (frequency, values)]
            columns = [
                rows.column("doc_id"), pa.array(one), pa.array(sizes.astype(np.int32)), pa.array(matches.astype(np.int32)),
                pa.StructArray.from_arrays(ends, ["f", "v"]), pa.array(single.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(values[at])),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(salt)),
            ]
            batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "n", "matches", "end", "single", "tokens", "salts"])
            yield batch.filter(pa.array(sizes > 0))

    schema = "doc_id long, k1 long, n int, matches int, end struct<f: long, v: long>, single int, tokens array<long>, salts array<int>"
    return arrow_map(docs.select("doc_id", "text"), cut, schema)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> Stored:
    """The pairs (a, b) whose whole sets are similar enough.

    Only texts of candidates are shuffled, and as texts, which compress better than their sets.
    Pairs of one ``a`` are dealt into groups of about ``LIST_SHARE``, each with the text of ``a``
    once; so a document with very many pairs is in no task alone.
    """
    asked = stored(pairs, "pairs")
    shares = asked.frame.groupBy("a").agg(F.ceil(F.count("*") / LIST_SHARE).alias("shares"))
    groups = asked.frame.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    ends = asked.frame.select(F.explode(F.array("a", "b")).alias("node"))
    texts = narrowed(docs.select("doc_id", "text"), ends).join(ends, F.col("doc_id") == F.col("node"), "left_semi")
    texts = stored(texts.distinct(), "texts")

    def compared(batches):
        for rows in batches:
            a, left, right = (rows.column(c).to_pylist() for c in ("a", "left", "right"))
            begin = 0
            while begin < len(a):
                end = begin
                place: dict = {}  # pairs of one text stand together
                some: list[str] = []
                amount = 0
                while end < len(a) and (end == begin or amount + len(left[end] or "") + len(right[end] or "") <= CHUNK_CHARS):
                    key = (a[end], left[end])
                    if key not in place:
                        place[key] = len(some)
                        some.append(left[end] or "")
                        amount += len(some[-1])
                    some.append(right[end] or "")
                    amount += len(some[-1])
                    end += 1
                values, bounds = shingle_sets(some, size)
                alike, at = np.zeros(end - begin, bool), -1
                for i in range(begin, end):
                    own = place[(a[i], left[i])]
                    at = at + 1 if own != at + 1 else at + 2
                    x, y = values[bounds[own] : bounds[own + 1]], values[bounds[at] : bounds[at + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    alike[i - begin] = 100 * both >= percent * (len(x) + len(y) - both)
                kept = rows.slice(begin, end - begin).filter(pa.array(alike))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])
                begin = end

    two = texts.frame.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    one = texts.frame.select(F.col("doc_id").alias("a"), F.col("text").alias("left")).join(groups.select("a", "share").distinct(), "a")
    joined = groups.join(two, "b").join(one, ["a", "share"]).select("a", "b", "left", "right")
    links = stored(arrow_map(joined, compared, "a long, b long"), "links")
    asked.drop()
    texts.drop()
    return links


def alike(a: str, b: str, percent: int) -> Column:
    """No pair of other sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def enough(overlap: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of these sizes, together, can be similar enough with that overlap."""
    return (100 + percent) * overlap >= percent * sizes


#: What a member of a list tells of its document.
FACTS = ("place", "doc_id", "n", "matches", "end", "most", "free")


def _of(side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in FACTS]


def shareable(earlier: str, later: str) -> Column:
    """How many shingles two sets can share, by the sides of the earlier and the later one."""
    free = F.when(F.col(f"end_{earlier}").getField("f") > 1, F.col(f"free_{later}")).otherwise(F.col(f"n_{later}"))
    return F.least(F.col(f"most_{earlier}"), free)


def meetings(percent: int) -> Column:
    """Whether a row of two members of a list counts: early enough in both sets, of fitting sizes."""
    after = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + F.least("matches_x", "matches_y") - 1
    return alike("n_x", "n_y", percent) & enough(after, F.col("n_x") + F.col("n_y"), percent)


def counted_pairs(met: DataFrame, *more: Column) -> DataFrame:
    """Pairs (x, y) that meet as often as the smaller number of matches asks, with how often (common)."""
    pairs = met.groupBy(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y"), F.least("matches_x", "matches_y").alias("asked"))
    return pairs.agg(F.count("*").alias("common"), *more).filter(F.col("common") >= F.col("asked"))


def list_members(cut: DataFrame, percent: int) -> Stored:
    """token, salt and ``FACTS`` of each document in a list that others are in too.

    ``place`` counts the shingles before this one; ``most`` those that are listed or beyond the
    prefix, which is what the set can share with one whose prefix ends later; ``free`` all but
    unlisted ones of frequency 1.
    """
    posted = cut.select("doc_id", F.posexplode(F.arrays_zip("tokens", "salts")).alias("place", "p"))
    posted = posted.select(F.col("p.tokens").alias("token"), F.col("p.salts").alias("salt"), "place", "doc_id")
    # A list of one has nobody to link with, unless it is a share of a longer list.
    lists = posted.withColumn("members", F.count("*").over(Window.partitionBy("token", "salt")))
    lists = stored(lists.filter("members > 1 or salt > 0").select("token", "salt", "place", "doc_id"), "lists")
    present = lists.frame.groupBy("doc_id").agg(F.count("*").alias("listed"), F.count_if(F.col("salt") == -1).alias("listed_single"))
    rest = F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") - F.col("matches")
    facts = cut.select("doc_id", "n", "matches", "end", "single", rest.alias("rest")).join(present, "doc_id")
    facts = facts.withColumn("free", F.least(F.col("n"), F.col("n") - F.col("single") + F.col("listed_single")))
    facts = facts.withColumn("most", F.least(F.col("n"), F.col("rest") + F.col("listed")))
    members = stored(lists.frame.join(facts, "doc_id").select("token", "salt", *FACTS), "members")
    lists.drop()
    return members


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member with two heads of its lists, the one that it shares most with and the one that has
    the fewest shingles of its own; and heads of one shingle with the first of them.

    A list's head is the document of the smallest share of unlisted shingles: of a group of near
    copies, the one that most of the others are near to.
    """
    head = F.max(F.struct((F.col("most") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("order"), *FACTS)).alias("h")
    heads = members.groupBy("token", "salt").agg(head)
    met = members.select("token", "salt", *_of("y")).join(heads.select("token", "salt", *(F.col(f"h.{c}").alias(f"{c}_x") for c in FACTS)), ["token", "salt"])
    bound = F.when(F.col("end_x") <= F.col("end_y"), shareable("x", "y")).otherwise(shareable("y", "x"))
    met = met.filter((F.col("doc_id_x") != F.col("doc_id_y")) & meetings(percent) & enough(bound, F.col("n_x") + F.col("n_y"), percent))
    nearest, cleanest = F.struct("common", (-F.col("x")).alias("x")), F.struct("share", "common", (-F.col("x")).alias("x"))
    best = counted_pairs(met, F.max(F.col("most_x") / F.col("n_x")).alias("share")).groupBy(F.col("y").alias("b"))
    best = best.agg(F.max(nearest).alias("nearest"), F.max(cleanest).alias("cleanest"))
    stars = best.select(F.explode(F.array(-F.col("nearest.x"), -F.col("cleanest.x"))).alias("a"), "b")
    shares = heads.filter("salt > 0").select("token", F.col("h.doc_id").alias("b"), F.struct("h.share", "h.order").alias("r"))
    first = shares.groupBy("token").agg((-F.max("r").getField("order")).alias("a"))
    return stars.unionByName(shares.join(first, "token").filter("a <> b").select("a", "b")).distinct()


def remaining_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs (a, b) between different classes.

    Members too late in their sets for any of their list are left out, so of a list whose near
    copies are one class by now few are left to meet.  The earlier document of a pair must itself
    leave room for enough shared shingles, and the later one's prefix ends no earlier than the
    first such document of the list.
    """
    placed = members.drop("salt").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    lists = placed.frame.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"))
    left = placed.frame.join(lists.filter("low < high").select("token", "least"), "token")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100.0 - 1e-9))
    left = left.filter(enough(F.col("n") - F.col("place") + F.col("matches") - 1, F.col("n") + smallest, percent))
    left = left.withColumn("able", enough(F.col("most"), F.col("n") + smallest, percent))
    ends = left.groupBy("token").agg(F.min(F.when(F.col("able"), F.col("end"))).alias("begin"), F.count("*").alias("members"))
    left = left.join(ends.filter("begin is not null"), "token").filter(F.col("end") >= F.col("begin"))
    shares = F.ceil(F.col("members") / (2 * LIST_SHARE)).cast("int")
    x = left.filter("able").select("token", F.pmod(F.xxhash64("doc_id"), shares).cast("int").alias("share"), F.col("component").alias("c_x"), *_of("x"))
    y = left.select("token", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("component").alias("c_y"), *_of("y"))
    able = (F.col("c_x") != F.col("c_y")) & (F.col("end_x") <= F.col("end_y")) & meetings(percent) & enough(shareable("x", "y"), F.col("n_x") + F.col("n_y"), percent)
    pairs = counted_pairs(x.join(y, ["token", "share"]).filter(able))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Link rows of ``docs`` (doc_id, text) whose shingle sets have
    100 * |intersection| >= percent * |union|: doc_id, n_shingles, component_id for each row.

    ``component_id`` is the smallest doc_id reachable.  A null, empty or wordless text has an
    empty set and links with nothing.  Repeated rows are one document and give equal results; of
    one doc_id with several texts any link counts for all.  A null doc_id is in no component
    (null).  Other columns are left aside; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    described = stored(describe(docs, size), "described").frame
    known = described.filter("kind = 0").select("doc_id", "n", "k1", "k2")
    named = known.filter("n > 0 and doc_id is not null")
    classes = stored(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), "classes").frame
    counted = stored(described.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")), "counted")
    cut = prefixes(docs, size, percent, frequencies(counted.frame))
    counted.drop()
    cut = cut.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "k1"])
    cut = stored(cut, "prefixes")
    members = list_members(cut.frame, percent)
    cut.drop()
    links = verified(star_pairs(members.frame, percent), docs, size, percent)
    # Classes that a few rounds of labels leave apart cost time only: the last components have all links.
    labels = connected_components(links.frame, rounds=3)
    links.drop()
    more = verified(remaining_pairs(members.frame, labels.frame, percent), docs, size, percent)
    members.drop()
    same = labels.frame.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    # A doc_id with several texts is one node through its classes' representatives.
    twice = named.groupBy("doc_id").agg(F.min("k1").alias("k"), F.max("k1").alias("l")).filter("k < l")
    bridges = named.join(twice.select("doc_id"), "doc_id", "left_semi").join(classes, ["k1", "k2", "n"]).filter(F.col("doc_id") != F.col("node"))
    links = more.frame.unionByName(same).unionByName(bridges.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    whole = connected_components(links).frame
    labels.drop()
    more.drop()
    reached = classes.join(whole, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    return (
        known.join(reached, ["k1", "k2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id.

    All columns stay as they are, whatever they are called.  Documents without words, or without
    an id, stay; so do repeated rows of a document that stays, and an empty table stays empty.
    """
    copy = fresh("copy", docs.columns)
    marked = jaccard_components(docs, size, percent).filter("component_id < doc_id")
    copies = stored(marked.select(F.col("doc_id").alias(copy)).distinct(), "near-copies").frame
    return docs.join(copies, docs["doc_id"] == F.col(copy), "left_anti")
