"""Line deduplication by log templates: a fixed-depth parse tree over the lines of all documents.

A line's path in the tree is its number of tokens and its first ``DEPTH`` tokens, where tokens
with a digit are variable (``<*>``).  A line with fewer than ``MIN_SAME`` other tokens, or with
more variable tokens than others, such as a row of numbers, has none: its tokens stay as they are.
Lines on one path form a leaf.  The leaf's template has at each position the token that most of
the leaf's distinct lines share, or none where no token has ``SHARE`` of them or several have the
most.  What the path fixes tells nothing, so a line belongs to the template by the tokens after it: ``MIN_SAME`` of
them at least, and ``ALIKE`` of those that aren't variable in both, are the template's.  A line
of its own wording (variable tokens aside) is a template by itself.  A wording found in a second
document recurs, and so does a leaf's template whose lines are in at least ``MIN_DOCS`` documents
(distinct doc_ids): its lines are dropped, except in the document of the smallest doc_id, so a
first copy stays whole.  What another document's line has at the template's open positions is
dropped with it.

Unlike an online parser the result doesn't depend on the order of lines: all of it is sums by
path, by position and by template, combined before each shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import SpanHasher, arrow_map, chunks, code_points, line_spans, mix64, word_spans
from .storage import checkpointed, fresh, stored, written

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 3
SHARE = 0.3
ALIKE = 0.6
MIN_SAME = 2
#: A wording or leaf with this part of all lines or more is hot; so at most as many are.
HOT_KEYS = 1 << 14
SALTS = 64
#: The hash of a variable token.
VARIABLE = np.uint64(0x2A2A2A2A2A2A2A2A)


def parsed_lines(texts: list[str], depth: int = DEPTH, least: int = MIN_TOKENS):
    """Lines of at least that many tokens: text index, line number, path, wording, token hashes and bounds."""
    points, starts = code_points(texts)
    hasher = SpanHasher(points)
    begin, end, _ = word_spans(points, starts)
    tokens = hasher(begin, end)
    digits = np.zeros(len(points) + 1, np.int64)
    np.cumsum((points >= 48) & (points <= 57), out=digits[1:])
    variable = digits[end] > digits[begin]
    line_begin, line_end, text = line_spans(points, starts)
    first = np.searchsorted(begin, line_begin)
    size = np.searchsorted(begin, line_end) - first
    counted = np.concatenate([[0], np.cumsum(variable)])
    others = size - (counted[first + size] - counted[first])
    loose = (others < MIN_SAME) | (2 * others < size)
    tokens[variable & ~np.repeat(loose, size)] = VARIABLE
    number = np.arange(len(text)) - np.searchsorted(text, text)
    kept = size >= max(least, 1)
    first, size, text, number = first[kept], size[kept], text[kept], number[kept]
    path = mix64(size.astype(np.uint64))
    for k in range(depth):
        has = size > k
        path[has] = mix64(path[has] ^ (tokens[first[has] + k] + np.uint64(k + 1)))
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - bounds[:-1], size) + np.arange(int(bounds[-1]))
    own = tokens[at]
    place = np.arange(len(at)) - np.repeat(bounds[:-1], size)
    mixed = mix64(own + mix64(place.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    wording = mix64(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    return text, number, path.view(np.int64), wording.view(np.int64), own, bounds


def _line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, path, wording and tokens (32-bit) of each distinct wording of a document.

    Lines that no general template can hold have no tokens.
    """

    def rows_of(batches):
        for rows, texts in chunks(batches, "text"):
            text, _, path, wording, tokens, bounds = parsed_lines(texts)
            order = np.lexsort((path, wording, text))
            new = np.ones(len(order), bool)
            new[1:] = (text[order][1:] != text[order][:-1]) | (wording[order][1:] != wording[order][:-1])
            pick = np.sort(order[new])
            size = np.diff(bounds)[pick]
            size[size < DEPTH + MIN_SAME + 1] = 0
            lists = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(bounds[:-1][pick] - lists[:-1], size) + np.arange(int(lists[-1]))
            lists = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(tokens[at].astype(np.uint32).view(np.int32)))
            columns = [rows.column("doc_id").take(pa.array(text[pick])), pa.array(path[pick]), pa.array(wording[pick]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "wording", "tokens"])

    return arrow_map(docs.select("doc_id", "text"), rows_of, "doc_id long, path long, wording long, tokens array<int>")


def recurring_templates(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, alike: float = ALIKE) -> DataFrame:
    """(doc_id, wording, keeper) of every line whose template recurs: keeper is the doc_id that keeps it."""
    parsed = stored(_line_rows(docs.filter(F.col("doc_id").isNotNull())), "parsed-lines")
    lines = parsed.frame
    found = checkpointed(
        lines.groupBy("path", "wording").agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    )
    total = found.agg(F.sum("docs")).first()[0] or 0
    leaves = found.groupBy("path").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("wordings"))
    leaves = written(leaves.filter((F.col("leaf_docs") >= min_docs) & (F.col("wordings") > 1)), "template-leaves")
    hot_leaves = leaves.filter(F.col("leaf_docs") >= total / HOT_KEYS).select("path")
    hot_wordings = found.groupBy("wording").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= total / HOT_KEYS).select("wording")
    # One row for each distinct wording of a leaf with several, with its tokens.
    members = (
        spread_join(lines.select("path", "wording", "tokens").filter(F.size("tokens") > 0), leaves.select("path", "wordings"), "path", "wording", hot_leaves)
        .groupBy("path", "wording", "wordings")
        .agg(F.first("tokens").alias("tokens"))
    )
    members = checkpointed(members)
    variable = F.lit(int(np.uint32(VARIABLE & np.uint64(0xFFFFFFFF)).view(np.int32)))
    cells = members.select("path", "wordings", F.posexplode("tokens").alias("place", "token")).filter((F.col("token") != variable) & (F.col("place") >= DEPTH))
    cells = cells.groupBy("path", "place", "token", "wordings").agg(F.count("*").alias("n"))
    cells = cells.filter(F.col("n") >= F.greatest(F.lit(2), F.col("wordings") * share))
    # Of tokens found in equally many lines none is the position's.
    first, last = F.max(F.struct("n", "token")).alias("top"), F.max(F.struct("n", (-F.col("token").cast("long")).alias("token"))).alias("tied")
    constant = cells.groupBy("path", "place").agg(first, last).filter(F.col("top.token") == -F.col("tied.token"))
    # A leaf's positions are as many as its lines have tokens.
    templates = constant.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("place", "top.token"))).alias("constants"))
    found_same, decided = _agreement(variable)
    matched = spread_join(members, templates, "path", "wording", hot_leaves).filter((found_same >= MIN_SAME) & (found_same >= alike * decided)).select("path", "wording")
    whole = found.filter(F.col("keeper") < F.col("last")).select("wording", "keeper")
    recurring = (
        whole.withColumn("leaf", F.lit(None).cast("long"))
        .unionByName(matched.select("wording", F.lit(None).cast("long").alias("keeper"), F.col("path").alias("leaf")))
        .groupBy("wording").agg(F.min("keeper").alias("keeper"), F.min("leaf").alias("leaf"))
    )
    hits = spread_join(lines.select("doc_id", "wording"), recurring, "wording", "doc_id", hot_wordings)
    hits = written(hits, "template-lines")
    parsed.drop()
    several = hits.filter(F.col("leaf").isNotNull())
    general = several.groupBy("leaf").agg(F.count_distinct("doc_id").alias("all_docs"), F.min("doc_id").alias("first"))
    general = general.filter(F.col("all_docs") >= min_docs).select("leaf", "first")
    alone = hits.filter(F.col("leaf").isNull()).select("doc_id", "wording", "keeper")
    placed = spread_join(several, general, "leaf", "doc_id", hot_leaves.withColumnRenamed("path", "leaf"), "left")
    return alone.unionByName(placed.select("doc_id", "wording", F.least("keeper", "first").alias("keeper")))


def _agreement(variable: Column) -> tuple[Column, Column]:
    """Positions after the path where a line has its leaf's token, and those that aren't open in both."""
    places = F.sequence(F.lit(DEPTH), F.size("tokens") - 1)
    own, constant = lambda place: F.get("tokens", place), lambda place: F.element_at("constants", place)
    same = F.size(F.filter(places, lambda place: F.coalesce(own(place) == constant(place), F.lit(False))))
    both_open = F.size(F.filter(places, lambda place: (own(place) == variable) & constant(place).isNull()))
    return same, F.size(places) - both_open


def spread_join(rows: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has at most one row a key: those of each hot key go to
    ``SALTS`` tasks by the column ``by``, and its row of ``one`` to all of these.

    ``hot`` has keys only, distinct and at most ``HOT_KEYS``, so it can be broadcast at any size.
    """
    salts = F.broadcast(hot.withColumn("salts", F.lit(SALTS)))
    several = F.coalesce("salts", F.lit(1))
    left = rows.join(salts, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), several)).drop("salts")
    right = one.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), several.cast("long") - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")


def dropped_lines(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and the wordings that are dropped from it, one row for each document with any."""
    hits = recurring_templates(docs, **settings).filter(F.col("doc_id") != F.col("keeper"))
    return hits.groupBy("doc_id").agg(F.collect_set("wording").alias("dropped"))


def without_lines(texts: list[str], wordings: list[set[int]]) -> list[str]:
    """The texts without their lines of each one's wordings."""
    text, number, _, wording, _, _ = parsed_lines(texts)
    out = [set() for _ in texts]
    for t, n, w in zip(text.tolist(), number.tolist(), wording.tolist(), strict=True):
        if w in wordings[t]:
            out[t].add(n)
    return ["\n".join(line for n, line in enumerate(t.split("\n")) if n not in o) if o else t for t, o in zip(texts, out, strict=True)]


def drop_recurring_lines(docs: DataFrame, **settings) -> DataFrame:
    """All rows of ``docs`` with ``text`` freed of recurring lines; other columns stay as they are.

    Null and empty texts and null ids stay.  Repeated rows of one doc_id are one document.  Names
    of other columns are no matter, and an empty table stays empty.
    """
    names = docs.columns
    doc, gone = fresh("line_doc", names), fresh("line_dropped", names)
    dropped = written(dropped_lines(docs, **settings).select(F.col("doc_id").alias(doc), F.col("dropped").alias(gone)), "dropped-lines")
    joined = docs.join(dropped, docs["doc_id"] == F.col(doc), "left").select(*(docs[c] for c in names), gone)
    schema = docs.schema

    def cleaned(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = [i for i, wordings in enumerate(batch.column(gone).to_pylist()) if wordings and texts[i] is not None]
            changed = []
            for rows, part in chunks([batch.select(["text", gone]).take(pa.array(at, pa.int64()))], "text"):
                changed += without_lines(part, [set(wordings) for wordings in rows.column(gone).to_pylist()])
            for i, text in zip(at, changed, strict=True):
                texts[i] = text
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(joined, cleaned, schema)


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """The operator's digest for each row of ``docs`` (doc_id, text): n_lines, n_dropped and the
    SHA-256 of the remaining text.

    A null text is an empty one, with no lines.  A line of fewer than ``MIN_TOKENS`` tokens is
    never dropped.  Repeated rows are repeated, other columns are left aside, an empty table
    gives no rows.
    """
    docs = docs.select("doc_id", "text").withColumn("_line_before", _line_count())
    return drop_recurring_lines(docs, **settings).select(
        "doc_id",
        F.col("_line_before").alias("n_lines"),
        (F.col("_line_before") - _line_count()).alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def _line_count() -> Column:
    """Lines of the text; an empty text has none."""
    return F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
