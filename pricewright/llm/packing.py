"""Best-fit packing of documents into fixed-length token sequences by linear grouping.

Documents are tokenised once into pieces of at most ``capacity`` tokens.  All that planning
needs is how many pieces there are of each length, at most ``capacity`` numbers however large
the corpus is.  The plan for those numbers is made on the driver:

1. Large lengths are sorted and cut into groups of equal cardinality, and each is rounded up
   to its group's largest, so few distinct sizes are left.
2. The cutting-stock linear program over these sizes is solved by column generation; whole
   configurations are taken and the remainder is packed best-fit decreasing.
3. The slots of each group are filled with the group's real lengths, which gives back what
   rounding added.
4. Small lengths go, in decreasing order, where they fit best.

The plan is a table of runs, "the pieces of this length from this rank to that one go to these
sequences at this offset", and one join over (length, rank) carries it out.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import arrow_map, chunks
from .linear import inverted, times
from .pretokens import PretokenEncoder, spelled
from .storage import checkpointed

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str) -> PretokenEncoder:
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    return PretokenEncoder(lambda strings: [[t.id for t in model.tokenize(spelled(s))] for s in strings])


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Only documents over the capacity are cut, into full pieces; the first may be shorter."""
    short = tokens % capacity
    return ([short] if short else []) + [capacity] * (tokens // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text)."""

    def pieces(batches):
        encode = _encoder(tokenizer)
        for rows, texts in chunks(batches, "text"):
            ids, first = encode(texts)
            columns: list[list] = [[], [], [], [], []]
            for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                start = 0
                for n, length in enumerate(piece_lengths(len(own), capacity)):
                    crc = zlib.crc32(own[start : start + length].tobytes())
                    for column, value in zip(columns, (doc_id, n, start, length, crc), strict=True):
                        column.append(value)
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return arrow_map(docs.select("doc_id", "text"), pieces, PIECES)


# ---------------------------------------------------------------- planning over the histogram


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups of the lengths, largest first: (rounded size, [[length, count]])."""
    total = int(counts.sum())
    out: list[tuple[int, list[list[int]]]] = []
    left = 0
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while count:
            if not left:
                share = -(-total // (groups - len(out))) if len(out) < groups else total
                out.append((length, []))
                left = max(1, share)
            take = min(left, count)
            out[-1][1].append([length, take])
            count, left, total = count - take, left - take, total - take
    merged: list[tuple[int, list[list[int]]]] = []
    for size, members in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(members)
        else:
            merged.append((size, members))
    return merged


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded-knapsack optimum: the most valuable multiset of sizes within the capacity."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
            if value > 1e-12:
                candidate = best[: capacity + 1 - size] + value
                better = candidate > new[size:] + 1e-12
                new[size:][better] = candidate[better]
                pick[size:][better] = i
        if np.array_equal(new, best):
            break
        picks.append(pick)
        best = new
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float((values * column).sum()), column


def optimal_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000):
    """Cutting stock over few sizes by column generation: [(configuration, uses)], fractional."""
    k = len(sizes)
    basis = np.diag(np.floor(capacity / sizes)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    uses = times(inverse, demand)
    for step in range(rounds):
        value, column = best_configuration(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = times(inverse, column)
        ratio = np.where(direction > 1e-9, uses / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if step % 100 == 99:
            inverse = inverted(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        uses = np.maximum(times(inverse, demand), 0)
    return [(basis[:, i].astype(np.int64), float(uses[i])) for i in range(k) if uses[i] > 1e-9]


class Plan:
    """Kinds of sequences: each has a pattern of lengths and a number of uses."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: by room left: list of [pattern as ((length, copies), ...), sequences]
        self.open: dict[int, list[list]] = {}
        self.sequences = 0

    def add(self, pattern: tuple, room: int, number: int) -> None:
        if number > 0:
            kinds = self.open.setdefault(room, [])
            for kind in kinds:
                if kind[0] == pattern:
                    kind[1] += number
                    break
            else:
                kinds.append([pattern, number])

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces of a length where the least room is left, new sequences last."""
        while count:
            fitting = [room for room in self.open if room >= length]
            if not fitting:
                copies = self.capacity // length
                full, rest = divmod(count, copies)
                self.add(((length, copies),), self.capacity - copies * length, full)
                if rest:
                    self.add(((length, rest),), self.capacity - rest * length, 1)
                return
            room = min(fitting)
            kinds = self.open[room]
            pattern, number = kinds.pop()
            if not kinds:
                del self.open[room]
            copies = room // length
            full = min(number, count // copies)
            self.add((*pattern, (length, copies)), room - copies * length, full)
            count, number = count - full * copies, number - full
            if count and number:
                self.add((*pattern, (length, count)), room - count * length, 1)
                count, number = 0, number - 1
            self.add(pattern, room, number)

    def runs(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, copies a sequence, offset)."""
        rank: dict[int, int] = {}
        out, sequence = [], 0
        for room in sorted(self.open):
            for pattern, number in self.open[room]:
                offset = 0
                for length, copies in pattern:
                    first = rank.get(length, 0)
                    rank[length] = first + copies * number
                    out.append((length, first, rank[length], sequence, copies, offset))
                    offset += length * copies
                sequence += number
        self.sequences = sequence
        return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 256, small: int | None = None) -> Plan:
    """Pack ``histogram[length]`` pieces of each length; a pure function of at most ``capacity`` numbers."""
    small = 2 * capacity // 5 if small is None else small
    plan = Plan(capacity)
    plan.add(((capacity, 1),), 0, histogram.get(capacity, 0))
    lengths = np.array(sorted(x for x, n in histogram.items() if small < x < capacity and n > 0), np.int64)
    if len(lengths):
        counts = np.array([histogram[int(x)] for x in lengths], np.int64)
        grouped = linear_groups(lengths, counts, min(groups, len(lengths)))
        sizes = np.array([size for size, _ in grouped], np.int64)
        demand = np.array([sum(n for _, n in members) for _, members in grouped], np.int64)
        stock = [[list(m) for m in members] for _, members in grouped]
        left = demand.copy()
        for column, uses in optimal_configurations(sizes, demand.astype(float), capacity):
            whole = int(uses + 1e-6)
            if column.any():
                whole = min(whole, int((left[column > 0] // column[column > 0]).min()))
            left -= column * whole
            substitute(plan, column, whole, stock, capacity)
        for members in stock:  # what whole configurations left
            for length, count in members:
                plan.best_fit(length, count)
    for length in sorted((x for x, n in histogram.items() if 0 < x <= small and n > 0), reverse=True):
        plan.best_fit(length, histogram[length])
    return plan


def substitute(plan: Plan, column: np.ndarray, uses: int, stock: list, capacity: int) -> None:
    """Use a configuration that often, with real lengths of each group in its slots."""
    slots = [g for g in np.flatnonzero(column).tolist() for _ in range(int(column[g]))]
    while uses > 0:
        taken: dict[tuple[int, int], int] = {}
        picks, heads = [], {}
        for g in slots:  # slots of one group are filled from one run of equal lengths while it lasts
            members = stock[g]
            while members and members[0][1] == 0:
                members.pop(0)
            at = heads.get(g, 0)
            if members[at][1] - taken.get((g, at), 0) < 1:
                at += 1
                heads[g] = at
            taken[(g, at)] = taken.get((g, at), 0) + 1
            picks.append(members[at][0])
        number = min(uses, *(stock[g][at][1] // n for (g, at), n in taken.items()))
        for (g, at), n in taken.items():
            stock[g][at][1] -= n * number
        pattern: dict[int, int] = {}
        for length in picks:
            pattern[length] = pattern.get(length, 0) + 1
        plan.add(tuple(pattern.items()), capacity - sum(picks), number)
        uses -= number
    for g in set(slots):
        stock[g] = [m for m in stock[g] if m[1]]


# ------------------------------------------------------------------------------- Spark operator


def best_fit_packing(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = 256, end_id: int = 0
) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.
    A null or empty text is one piece with the end id alone; a null doc_id stays null and
    repeated rows are packed as often as they occur.  Other columns are left aside.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or vocabulary_path("byte_bpe_50k.json")
    pieces = checkpointed(token_pieces(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = make_plan(histogram, capacity, groups).runs()
    # At most a few runs for each of the `capacity` lengths, whatever the number of pieces.
    plan = spark.createDataFrame(
        runs, "run_length long, run_first long, run_end long, run_sequence long, run_copies long, run_offset long"
    )
    # The rank of a piece among those of its length, without all of a length in one task:
    # ranks within (length, salt), plus the pieces of the length under smaller salts.
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("place", F.row_number().over(within) - F.lit(1))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("base"))
    inside = (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("run_first"), F.col("run_end") - 1)
    turn = F.col("rank") - F.col("run_first")
    return placed.join(F.broadcast(plan), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run_sequence") + F.floor(turn / F.col("run_copies"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(turn, F.col("run_copies")) * F.col("length")).cast("long").alias("offset"),
    )
