"""Ranked lexical search over a bit-sliced impact index.

A document's score for an item sums, over the item's terms, weight times a saturated term
frequency, all in integers.  The index keeps these products, the impacts, by blocks of up to
``BLOCK`` documents: of each term the places of the block's documents that have it, and for each
bit of the impact a bitmap over these documents.

A search lays a term's bitmaps out over the whole block and adds them up, slice by slice, by
bitwise carry arithmetic: one operation adds a bit of 64 documents, for many items at once.  The
top k are then found from the most significant slice down: while more than k documents have the
bit, those without it go; where fewer have it, they are in, and the rest go on.  What is left
at the end are ties, taken by document id.

Blocks are searched where they lie, without a shuffle; k rows of each block and item meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import arrow_map, chunks, mix64
from .storage import stored
from .terms import Terms, is_letter_or_digit, tallied

TOP = 50
#: Documents of a block.
BLOCK = 4096
#: Pairs of an item and a term that are searched together; their terms are broadcast.
BATCH = 8192
#: Items whose sums are held at once.
ITEMS = 256
#: Bits of an impact: a weight is below 2 ** 16 and a saturated frequency below 2 ** 20.
SLICES = 36
SATURATION = 1_000_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text)."""

    def found(batches):
        for rows, texts in chunks(batches, "text"):
            terms = Terms(texts, is_letter_or_digit)
            first, _, _ = tallied(terms.hashes ^ mix64(terms.text.astype(np.uint64) + np.uint64(1)))
            columns = [rows.column("item_id").take(pa.array(terms.text[first])), pa.array(terms.strings(first), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return arrow_map(items.select("item_id", "text"), found, f"item_id {kind}, term string").distinct()


POSTINGS = "doc_ids array<long>, lengths array<int>, n_docs long, n_terms long, terms array<string>, sizes array<int>, places array<int>, counts array<int>"


def posting_blocks(docs: DataFrame, vocabulary: list[str], block: int = BLOCK) -> DataFrame:
    """Blocks of documents, by id within each, with the postings of the vocabulary's terms.

    n_docs counts documents with a term of any kind, n_terms all terms; a block's postings stand
    term by term, ``sizes`` of each, as places in the block and counts.
    """
    names = np.array(vocabulary, object)
    known = Terms(vocabulary, is_letter_or_digit).hashes  # each is one whole term
    order = np.argsort(known)
    shared = docs.sparkSession.sparkContext.broadcast((known[order], names[order]))

    def blocks(batches):
        known, names = shared.value
        ids, lengths, owner, code, count, size = [], [], [], [], [], 0

        def gathered():
            doc_ids = [x for some in ids for x in some]
            by_id = sorted(range(len(doc_ids)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0))
            place = np.empty(size, np.int64)
            place[by_id] = np.arange(size)
            n = np.concatenate(lengths)
            at, of, times = place[np.concatenate(owner)], np.concatenate(code), np.concatenate(count)
            order = np.lexsort((at, of))
            at, of, times = at[order], of[order], times[order]
            terms, sizes = np.unique(of, return_counts=True)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            columns = [
                one([doc_ids[k] for k in by_id], pa.int64()), one(n[by_id], pa.int32()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                one(names[terms].tolist(), pa.string()), one(sizes, pa.int32()), one(at, pa.int32()), one(times, pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "lengths", "n_docs", "n_terms", "terms", "sizes", "places", "counts"])

        for rows, texts in chunks(batches, "text"):
            found = Terms(texts, is_letter_or_digit)
            n = np.bincount(found.text, minlength=len(texts))
            at = np.searchsorted(known, found.hashes)
            hit = np.flatnonzero(at < len(known))
            hit = hit[known[at[hit]] == found.hashes[hit]]
            first, _, times = tallied(found.text[hit] * len(known) + at[hit])
            doc, term = found.text[hit][first], at[hit][first]
            doc_ids, begin = rows.column("doc_id").to_pylist(), 0
            while begin < len(texts):
                end = min(len(texts), begin + block - size)
                some = slice(*np.searchsorted(doc, [begin, end]))
                ids.append(doc_ids[begin:end])
                lengths.append(n[begin:end])
                owner.append(doc[some] - begin + size)
                code.append(term[some])
                count.append(times[some])
                size, begin = size + end - begin, end
                if size == block:
                    yield gathered()
                    ids, lengths, owner, code, count, size = [], [], [], [], [], 0
        if size:
            yield gathered()

    return arrow_map(docs.select("doc_id", "text"), blocks, POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


INDEX = "doc_ids array<long>, terms array<string>, sizes array<int>, places array<int>, slices array<binary>"


def impact_index(blocks: DataFrame) -> DataFrame:
    """The bit-sliced index of ``posting_blocks``, a row for each block.

    A term's slices are ``SLICES`` bitmaps, least bit first, each over the documents of its places
    and filled up to whole bytes.
    """
    total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    counted = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df"))
    # One row for each term of the vocabulary at most.
    weights = {r["terms"]: weight(total[0], r["df"]) for r in counted.collect()}
    shared = blocks.sparkSession.sparkContext.broadcast((total[0] or 0, total[1] or 0, weights))

    def sliced(batches):
        n_docs, n_terms, weights = shared.value
        for batch in batches:
            for row in batch.select(["doc_ids", "lengths", "terms", "sizes", "places", "counts"]).to_pylist():
                lengths, sizes, places, counts = (np.array(row[c], np.int64) for c in ("lengths", "sizes", "places", "counts"))
                norm = 50 + 50 * lengths * n_docs // max(n_terms, 1)
                impact = SATURATION * counts // (1000 * counts + 20 * norm[places])
                impact *= np.repeat(np.array([weights[t] for t in row["terms"]], np.int64), sizes)
                ends = np.cumsum(sizes)
                bit = np.arange(SLICES)[:, None]
                slices = [np.packbits((impact[e - s : e] >> bit & 1).astype(np.uint8), axis=1, bitorder="little").tobytes() for s, e in zip(sizes, ends, strict=True)]
                columns = [pa.array([row[c]], kind) for c, kind in (("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([slices], pa.list_(pa.binary()))], ["doc_ids", "terms", "sizes", "places", "slices"])

    return arrow_map(blocks, sliced, INDEX)


def spread_slices(slices: bytes, places: np.ndarray, words: int) -> np.ndarray:
    """A term's bitmaps over the whole block: ``SLICES`` rows of 64-bit words."""
    held = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(SLICES, -1), axis=1, count=len(places), bitorder="little")
    whole = np.zeros((SLICES, 64 * words), np.uint8)
    whole[:, places] = held
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


def add_slices(total: np.ndarray, more: np.ndarray) -> None:
    """Add numbers in slices (axis 1) to ``total``, in place, from the least bit up."""
    carry = np.zeros_like(total[:, 0])
    for s in range(total.shape[1]):
        a = total[:, s]
        if s < more.shape[1]:
            b = more[:, s]
            half = a ^ b
            total[:, s], carry = half ^ carry, (a & b) | (half & carry)
        elif carry.any():
            total[:, s], carry = a ^ carry, a & carry
        else:
            break


def top_slices(total: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents above the k-th score, and of those that have it, if there are k.

    Documents of score 0, or not allowed, are never in.
    """
    ahead = np.zeros_like(total[:, 0])
    even = np.bitwise_or.reduce(total, axis=1) & allowed
    for s in range(total.shape[1] - 1, -1, -1):
        has = even & total[:, s]
        n = np.bitwise_count(ahead | has).sum(axis=1)[:, None]
        ahead = np.where(n <= k, ahead | has, ahead)
        even = np.where(n > k, has, even & ~total[:, s])
    return ahead, even


def search_block(row: dict, queries: list[tuple[int, list[str]]], k: int) -> list[tuple[int, int, int]]:
    """(item, doc_id, score) of the block's k best documents for each item."""
    doc_ids, words = row["doc_ids"], -(-len(row["doc_ids"]) // 64)
    ends = np.cumsum(row["sizes"])
    places, spread = np.array(row["places"], np.int64), {}
    number = {t: i for i, t in enumerate(row["terms"])}
    allowed = np.packbits(np.array([d is not None for d in doc_ids] + [False] * (64 * words - len(doc_ids))), bitorder="little").view(np.uint64)
    out = []
    present = [(item, [number[t] for t in terms if t in number]) for item, terms in queries]
    present = sorted((x for x in present if x[1]), key=lambda x: -len(x[1]))
    for begin in range(0, len(present), ITEMS):
        some = present[begin : begin + ITEMS]
        bits = SLICES + len(some[0][1]).bit_length()
        total = np.zeros((len(some), bits, words), np.uint64)
        for step in range(len(some[0][1])):
            now = [terms[step] for _, terms in some if len(terms) > step]  # those with most terms stand first
            for i in now:
                if i not in spread:
                    spread[i] = spread_slices(row["slices"][i], places[ends[i] - row["sizes"][i] : ends[i]], words)
            add_slices(total[: len(now)], np.stack([spread[i] for i in now]))
        ahead, even = top_slices(total, k, allowed)
        chosen, ties = (np.unpackbits(x.view(np.uint8), axis=1, bitorder="little") for x in (ahead, even))
        for i, (item, _) in enumerate(some):
            at = np.flatnonzero(chosen[i])
            at = np.concatenate([at, np.flatnonzero(ties[i])[: k - len(at)]])
            own = np.unpackbits(np.ascontiguousarray(total[i]).view(np.uint8), axis=1, bitorder="little")[:, at].astype(np.int64)
            scores = (own << np.arange(bits)[:, None]).sum(axis=0)
            out += [(item, doc_ids[p], s) for p, s in zip(at.tolist(), scores.tolist(), strict=True)]
    return out


def search(index: DataFrame, queries: dict[int, list[str]], k: int = TOP) -> DataFrame:
    """The k best documents of the whole index for each query (a number and its terms): query, rank, doc_id, score."""
    shared = index.sparkSession.sparkContext.broadcast(sorted(queries.items()))

    def searched(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = search_block(row, shared.value, k)
                columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    best = arrow_map(index, searched, "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """The k highest-scoring rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id,
    text), of score above 0: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    Items are searched in batches of about ``batch`` pairs of an item and a term, each over all
    documents; the index has the terms of its batch.  Counts (documents, terms, documents of a
    term) are of all documents, those with a null id included, which are never returned.  A null
    or empty text has no terms; as an item it has no rows.  Repeated rows of one doc_id are
    documents of their own; rows of one item_id are one item of all their terms, and a null
    item_id is left out.  Other columns are left aside.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items.filter(F.col("item_id").isNotNull())), "item-terms").frame
    batches = max(1, math.ceil(wanted.count() / batch))
    results = []
    for turn in range(batches):
        # About ``batch`` rows.
        pairs = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == turn).collect()
        items_of: dict = {}
        for r in pairs:
            items_of.setdefault(r["item_id"], []).append(r["term"])
        names = sorted(items_of)
        blocks = stored(posting_blocks(docs, sorted({r["term"] for r in pairs}), block), "posting-blocks").frame
        found = search(impact_index(blocks), {n: sorted(items_of[name]) for n, name in enumerate(names)}, k)
        named = spark.createDataFrame(list(enumerate(names)), f"query long, item_id {wanted.schema['item_id'].dataType.simpleString()}")
        results.append(found.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
