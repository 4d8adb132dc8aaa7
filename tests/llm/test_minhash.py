"""Tensored minhash against all pairs of sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from pricewright.llm import jaccard_join, tensored_minhash


def shingles(text, size):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def plain_components(docs, size, percent):
    component = {d: d for d, _ in docs if d is not None}

    def top(d):
        while component[d] != d:
            d = component[d]
        return d

    sets = [(d, shingles(text, size)) for d, text in docs if d is not None]
    for (d, x), (e, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((top(d), top(e)))
            component[high] = low
    return [(d, len(shingles(text, size)), top(d) if d is not None else None, d is None or top(d) == d) for d, text in docs]


def linked(docs, **settings):
    rows = tensored_minhash.minhash_components(docs, **settings).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in rows), key=str)


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80), (3, 60)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(tensored_minhash, "SHARE", 5)
    random.seed(12)
    vocabulary = [f"w{n}" for n in range(400)]
    make = lambda n: random.choices(vocabulary, k=n)
    texts, shared = [], make(60)
    for _ in range(12):
        base = make(random.choice([6, 30, 80, 200]))
        for _ in range(random.randint(1, 9)):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 25))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [" ".join(shared + make(random.randint(1, 40))) for _ in range(20)]  # a passage that many share
    texts += [" ".join(make(random.randint(1, 5))) for _ in range(10)] + ["One\ttwo", "one TWO", "one", "", "  ", None, "é é é", "é é É"]
    texts += [" ".join(make(3000))] * 3
    docs = list(enumerate(texts))
    random.shuffle(docs)
    docs += [docs[0], (7, "a text of another kind here"), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, component_id string")
    assert linked(df, size=size, percent=percent) == sorted(plain_components(docs, size, percent), key=str)


def test_nothing_links_in_an_empty_table(spark):
    assert linked(spark.createDataFrame([], "doc_id long, text string")) == []


def test_keys_agree_as_often_as_similarity_tells():
    rng = np.random.default_rng(4)
    share = {0.8: [], 0.3: []}
    for similarity, found in share.items():
        for _ in range(120):
            both = int(200 * similarity)
            draw = jaccard_join.mix64(rng.integers(0, 1 << 62, 200).astype(np.uint64)).view(np.int64)
            own = (200 - both) // 2
            x, y = (np.sort(np.concatenate([draw[:both], part])) for part in (draw[both : both + own], draw[both + own : both + 2 * own]))
            keys = tensored_minhash.minhash_keys(np.concatenate([x, x[:0], y]), np.array([0, len(x), len(x), len(x) + len(y)]))
            assert not keys[1].any()
            found.append((keys[0] == keys[2]).mean())
        assert np.mean(found) == pytest.approx(similarity**tensored_minhash.ROWS, abs=0.02)


def test_hardly_a_pair_is_missed():
    """Pairs of 0.8 that meet in fewer tables than asked: under 10 in a million, by the binomial numbers of shared keys."""
    from math import comb

    p, n = 0.8**tensored_minhash.ROWS, tensored_minhash.KEYS
    one = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    assert sum(one[i] * one[j] for i in range(n + 1) for j in range(n + 1) if i * j < tensored_minhash.MEETINGS) < 1e-5
