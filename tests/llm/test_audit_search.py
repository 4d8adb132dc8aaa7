"""The divergence audit and the lexical search against plain versions and their own SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pricewright.llm import divergence, entries, impact_index, sql


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def letters(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def alphanumeric(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def plain_divergence(docs, min_docs, top):
    docs = [(text or "", lang or "", source or "") for text, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(letters(text), source) for text, _, source in docs if _ == lang]
        df = Counter(t for terms, _ in own for t in set(terms))
        kept = {t for t in df if df[t] >= min_docs}
        counts = defaultdict(Counter)
        for terms, source in own:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, r) for r, (value, item) in enumerate(rows, 1)]
    return sorted(out)


def audited(df, **settings):
    rows = divergence.source_divergence(df, **settings).collect()
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows)


@pytest.mark.parametrize("heavy", [0.0, 0.4, 2.0])
def test_divergence_is_that_of_a_plain_version(spark, monkeypatch, heavy):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "BUCKET", 5)
    random.seed(8)
    own = {s: [f"{s}w{n}" for n in "abcd"] for s in "uvxyz"}
    docs = []
    for n in range(160):
        source = random.choice(["u", "v", "x", "y", "z", None, "é", "\U0001f600"])
        words = random.choices(["the", "Of", "ÀB", "naïve", "e1x", "a-b", "日本", *own.get(source, ["q"])], k=random.randint(0, 9))
        docs.append((random.choice([" ".join(words)] * 9 + [None, "", "12 34"]), random.choice(["en", "en", "de", None]), source))
    docs += [docs[0]] * 5 + [("", "fr", "only"), ("1", "fr", "other"), (None, "it", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, p int")
    assert audited(df, min_docs=4, top=3, heavy=heavy) == plain_divergence(docs, 4, 3)


def test_divergence_of_nothing(spark):
    assert audited(spark.createDataFrame([], "text string, lang string, source string")) == []
    df = spark.createDataFrame([("a b", "en", "x"), (None, "en", "y")], "text string, lang string, source string")
    assert audited(df) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_beyond_64_bit_products(spark):
    random.seed(2)
    cases = [(n, random.randint(max(n, 1), 8 * 10**15)) for n in (random.randint(1, 10 ** random.randint(1, 15)) for _ in range(200))] + [(5, 5)]
    df = spark.createDataFrame(cases, "n long, total long")
    got = [r[0] for r in df.select(divergence.share(df["n"], df["total"])).collect()]
    assert got == [1 + 10**9 * n // total for n, total in cases]


def plain_search(docs, items, k):
    found = [(doc_id, alphanumeric(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, terms in found for t in set(terms))
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(alphanumeric(text))
    out = []
    for item, terms in wanted.items():
        rows = []
        for doc_id, own in found:
            tf, score = Counter(own), 0
            for t in terms & set(tf):
                m = 100 - 50 + (50 * len(own) * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0 and doc_id is not None and item is not None:
                rows.append((-score, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def searched(docs, items, **settings):
    rows = impact_index.ranked_search(docs, items, **settings).collect()
    return sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in rows)


@pytest.mark.parametrize(("block", "batch"), [(4096, 8192), (7, 10)])
def test_search_is_that_of_a_plain_version(spark, block, batch):
    random.seed(5)
    vocabulary = ["The", "of", "x1", "é", "ÉCLAIR", "42", "naïve", "zeta", *(f"w{n}" for n in range(30))]
    make = lambda n: " ".join(random.choices(vocabulary, weights=[40, 30, 9, 5, 5, 5, 5, 5] + [1] * 30, k=n))
    docs = [(n, make(random.choice([1, 2, 2, 3, 8, 40]))) for n in range(230)]
    docs += [(300 + n, "the x1 of") for n in range(9)] + [(5, "the x1 of"), (None, "zeta zeta"), (400, None), (401, ""), (402, "?!"), (403, "the " * 5000)]
    random.shuffle(docs)
    items = [(n, make(random.randint(1, 12))) for n in range(12)] + [(20, None), (21, "absent"), (22, "zeta"), (22, "of"), (None, "the")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert searched(df, asked, k=6, block=block, batch=batch) == plain_search(docs, items, 6)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(docs, items) == []
    assert searched(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)) == []


def test_slices_add_up_and_rank():
    rng = np.random.default_rng(3)
    numbers = rng.integers(0, 1 << 34, (3, 5, 128)) * (rng.random((3, 5, 128)) < 0.4)
    bits = lambda x, n: np.packbits((x[:, None, :] >> np.arange(n)[:, None] & 1).astype(np.uint8), axis=2, bitorder="little").view(np.uint64)
    total = np.zeros((5, 38, 2), np.uint64)
    for one in numbers:
        impact_index.add_slices(total, bits(one, impact_index.SLICES))
    sums = numbers.sum(axis=0)
    assert (total == bits(sums, 38)).all()
    sums[:, 64:] = sums[:, :64]  # ties
    ahead, even = impact_index.top_slices(bits(sums, 38), 9, np.full(2, ~np.uint64(0)))
    for i in range(5):
        least = np.sort(sums[i])[-9]
        flags = [np.unpackbits(x[i].view(np.uint8), bitorder="little").astype(bool) for x in (ahead, even)]
        held = flags[0] | flags[1] if flags[1].any() else flags[0]
        assert (held == (sums[i] >= least)).all() and flags[0].sum() <= 9


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_rows_of_the_given_tables_are_those_of_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = entries.queries()[name](spark, sf_dir)
    want = base.execute(sql.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())
