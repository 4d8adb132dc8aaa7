"""Operators and pipeline stages against plain versions of themselves, and texts made to collide."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import (
    arrow_text, bpe_codec, gif_media, jaccard_join, language_id, line_templates, packing, pii, quality_classifier, quality_rules, storage, toxicity,
)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


WORD, OTHER = thue_morse(1024)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------------------- hashed spans


def test_regular_spans_do_not_collide():
    for n in (64, 1024, 4096):
        one, two = thue_morse(n)
        points, _ = arrow_text.code_points([one + two])
        a, b = arrow_text.SpanHasher(points)(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    points, _ = arrow_text.code_points(["xyzaxyz"])
    a, b, c = arrow_text.SpanHasher(points)(np.array([0, 4, 0]), np.array([3, 7, 2]))
    assert a == b != c


def test_operators_tell_regular_texts_apart(spark):
    text = f"{WORD}\n{OTHER}"
    docs = spark.createDataFrame([(1, text), (2, WORD), (3, OTHER)], "doc_id long, text string")
    own = bpe_codec.codec(bpe_codec.vocabulary_path())
    ids, _ = own.encode([text])
    assert own.decode(ids).decode() == text
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    pieces = {r["doc_id"]: r for r in packing.token_pieces(docs, packing.vocabulary_path("byte_bpe_50k.json"), capacity=1 << 20).collect()}
    for doc_id, t in ((1, text), (2, WORD), (3, OTHER)):
        want = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (pieces[doc_id]["length"], pieces[doc_id]["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3)}
    assert quality_rules.measure([text])["n_dup_lines"][0] == 0
    lines = f"one two {WORD}\nbeta one {OTHER}"
    kept = line_templates.drop_recurring_lines(spark.createDataFrame([(1, lines), (2, f"one two {OTHER}")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: lines, 2: f"one two {OTHER}"}


# ------------------------------------------------------------------------------- single operators


def test_pieces_are_those_of_the_whole_tokenizer(spark):
    from tokenizers import Tokenizer

    random.seed(8)
    path = packing.vocabulary_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["".join(random.choice("ab '\n1é") for _ in range(random.choice([0, 5, 400]))) for _ in range(40)]
    rows = packing.best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=50, groups=4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    filled = defaultdict(list)
    for doc_id, text in enumerate(texts):
        ids, start = [*whole.encode(text, add_special_tokens=False).ids, 0], 0
        for n, r in enumerate(sorted(by[doc_id], key=lambda r: r["piece"])):
            own = np.array(ids[start : start + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, start, zlib.crc32(own.tobytes()))
            assert len(ids) > 50 or r["length"] == len(ids)
            start += r["length"]
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert start == len(ids)
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 50


def test_links_with_few_and_many_own_words_are_those_of_brute_force(spark):
    """Families of near copies around the limit, common passages and sizes that differ."""
    random.seed(12)
    fresh = iter(f"n{i}" for i in range(10**6))
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for _ in range(120):
        text = list(base)
        for _ in range(random.randint(0, 4)):
            at = random.randrange(len(text))
            text[at : at + random.choice([0, 1])] = [random.choice([next(fresh), "m1", "m2", "m3"])]
        rows.append(text)
    rows += [passage + [next(fresh) for _ in range(random.randint(0, 8))] for _ in range(40)]
    rows += [passage[: random.randint(3, 25)] for _ in range(40)]
    random.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)}
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if component[a] > component[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    component[a], changed = component[b], True
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == component


def plain_lines(docs):
    """The line operator by dictionaries: doc_id -> text without its recurring lines."""
    found, lines_of = defaultdict(set), {}
    for doc_id, text in docs:
        held = []
        for line in (text or "").split("\n"):
            tokens = words(line)
            others = [t for t in tokens if not re.search("[0-9]", t)]
            loose = len(others) < 2 or 2 * len(others) < len(tokens)
            wording = tuple(t if loose or not re.search("[0-9]", t) else None for t in tokens)
            held.append((line, wording if len(tokens) >= line_templates.MIN_TOKENS else None))
            if held[-1][1] and doc_id is not None:
                found[held[-1][1]].add(doc_id)
        lines_of[doc_id] = held
    leaves = defaultdict(list)
    for wording in found:
        leaves[len(wording), wording[: line_templates.DEPTH]].append(wording)
    keeper = {w: min(ids) for w, ids in found.items() if len(ids) > 1}
    for (size, _), members in leaves.items():
        if size < line_templates.DEPTH + line_templates.MIN_SAME + 1 or len(members) < 2 or sum(len(found[w]) for w in members) < line_templates.MIN_DOCS:
            continue
        constant = {}
        for place in range(line_templates.DEPTH, size):
            top = Counter(w[place] for w in members if w[place] is not None).most_common(2)
            if top and top[0][1] >= max(2, len(members) * line_templates.SHARE) and top[0][1] > sum(n for _, n in top[1:]):
                constant[place] = top[0][0]
        matched = []
        for w in members:
            places = range(line_templates.DEPTH, size)
            same = sum(w[p] is not None and w[p] == constant.get(p) for p in places)
            decided = sum(not (w[p] is None and p not in constant) for p in places)
            if same >= line_templates.MIN_SAME and same >= line_templates.ALIKE * decided:
                matched.append(w)
        ids = set().union(*(found[w] for w in matched)) if matched else set()
        if len(ids) >= line_templates.MIN_DOCS:
            for w in matched:
                keeper[w] = min(keeper.get(w, min(ids)), min(ids))
    return {
        doc_id: "\n".join(line for line, w in held if not (w in keeper and doc_id is not None and keeper[w] != doc_id)) for doc_id, held in lines_of.items()
    }


def test_lines_are_those_of_a_plain_version(spark):
    random.seed(21)
    heads, tails = ["see the full", "page made by", "all rights of"], ["list", "of", "this", "shop", "9", "17", "today", "again"]
    make = lambda: f"{random.choice(heads)} {' '.join(random.choice(tails) for _ in range(random.choice([1, 3, 5])))}"
    own = lambda n: f"only {n} here w{n}x{n}"
    docs = [(n, "\n".join([own(n), *(make() for _ in range(random.randint(0, 3)))])) for n in range(60)] + [(100, None), (101, ""), (None, make())]
    docs += [(200 + n, f"open the door for {name} once more please\n{n} {n + 1} {n + 2}") for n, name in enumerate(["al", "bo", "cy", "di"])]
    got = {r["doc_id"]: r["text"] or "" for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_lines(docs)


def test_intervals_are_all_maximal_repeats():
    random.seed(3)
    texts = ["a b c x a b d y a b c z", "p q r s t p q r u p q v p w", "a a a a a", "", "x"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(2, 40))) for _ in range(60)]
    measured = quality_rules.measure(texts)
    symbols = quality_rules.measure(["#a $|b <&>", "", "plain"])["n_symbols"].tolist()
    assert symbols == [6, 0, 0]
    for i, text in enumerate(texts):
        w = tuple(text.split())
        after = defaultdict(set)
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                after[w[a:b]].add(w[b] if b < len(w) else (a, "end"))
        assert measured["n_repeated_substrings"][i] == sum(len(x) > 1 for x in after.values())
    assert measured["n_repeated_substrings"][:2].tolist() == [5, 6]


def test_scores_are_noisy_ors_of_sentences():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 0.5, 1 << toxicity.BITS).astype(np.float32), -1.0, 0.1)
    texts = ["One two. Three four! Five", "", "six seven\neight. nine", "..."]
    b = toxicity.bags(texts)
    z = toxicity.sentence_logits(model, b)
    got = toxicity.noisy_or(z, b.text, len(texts))
    for i in range(len(texts)):
        rest = 1.0
        for value in z[b.text == i]:
            rest *= 1 - 1 / (1 + math.exp(-value))
        assert got[i] == pytest.approx(1 - rest)
    assert [texts[t][s:e] for t, s, e in zip(b.text, b.begin, b.end, strict=True)][:3] == ["One two.", "Three four!", "Five"]


def test_languages_are_pooled_over_all_positions():
    model = language_id.ByteTagger(["a", "b", "c"], hidden=4)
    texts = ["wort für wort " + "ö" * 40, "12 34", "abc abc 7 d", ""]
    got, positions = language_id.document_probabilities(model, texts)
    for i, text in enumerate(texts):
        total, size = np.zeros(3), 0
        for word in words(text):
            if any(c.isalpha() for c in word):
                for part in language_id.windows(word.encode()):
                    p, _ = model.forward(*language_id.padded([part]))
                    total += p[:, 0].sum(axis=0)
                    size += len(part)
        assert positions[i] == size
        assert got[i] == pytest.approx(total / max(size, 1), abs=1e-5)


def test_rejected_languages(spark):
    random.seed(4)
    kinds = {"aa": ["the", "and", "with", "was"], "bb": ["der", "und", "fuer", "nicht"]}
    rows = [(i, " ".join(random.choice(kinds[k]) for _ in range(20)), k, "s", 1) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000, "12 34 ...", None, "s", 1), (1001, None, None, "s", 1), (1002, " ".join(["the der and und with nicht was fuer"] * 9), None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r["doc_id"] for r in language_id.accepted(docs).collect()}
    assert kept == set(range(200))  # no letter, null, and a text of both languages alike
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.accepted(unlabelled).collect()} == {*range(200), 1002}


def test_sites_shrink_as_a_plain_version_says(spark):
    """Made sites with known means, against sums in plain Python."""
    rng = np.random.default_rng(5)
    rows = []
    for h in range(6):
        centre = rng.uniform(0.2, 0.8)
        for p in range(4):
            mean = np.clip(centre + rng.normal(0, 0.1), 0.05, 0.95)
            for _ in range(int(rng.integers(1, 60))):
                rows.append((len(rows), f"h{h}" if h else None, f"p{p}", float(np.clip(mean + rng.normal(0, 0.05), 0.01, 0.99))))
    rows.append((len(rows), "single", "alone", 0.9))
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, own double")
    held = quality_classifier.evidence
    quality_classifier.evidence = lambda docs, model: scored
    try:
        docs = scored.select("doc_id", F.lit("t").alias("text"), "host", "path")
        got = {r["doc_id"]: r for r in quality_classifier.hierarchical_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    finally:
        quality_classifier.evidence = held
    own = np.array([r[3] for r in rows])
    mean = own.mean()

    def strength(keys):
        sites = defaultdict(list)
        for k, x in zip(keys, own, strict=True):
            sites[k].append(x)
        n = np.array([len(x) for x in sites.values()])
        m = np.array([np.mean(x) for x in sites.values()])
        within = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in sites.values()) / (n.sum() - len(n))
        between = ((n * (m - mean) ** 2).sum() - (len(n) - 1) * within) / (n.sum() - (n**2).sum() / n.sum())
        return min(max(within / max(between, 1e-9), 1.0), 1e6), sites

    by_host, hosts = strength([r[1] for r in rows])
    by_path, paths = strength([r[1:3] for r in rows])
    for doc_id, host, path, x in rows:
        h, p = hosts[host], paths[host, path]
        host_posterior = (sum(h) - x + by_host * mean) / (len(h) - 1 + by_host)
        path_posterior = (sum(p) - x + by_path * host_posterior) / (len(p) - 1 + by_path)
        logit = lambda q: math.log(q / (1 - q))
        want = 1 / (1 + math.exp(-(logit(x) + logit(path_posterior) - logit(mean))))
        assert got[doc_id]["path_posterior"] == pytest.approx(path_posterior) and got[doc_id]["score"] == pytest.approx(want)
    assert got[rows[-1][0]]["path_posterior"] == pytest.approx(mean)


def test_stored_media_are_read_back_by_the_formats_rules(spark):
    random.seed(9)
    line = "the same line again and again ".ljust(gif_media.WIDTH, ".")
    texts = ["", "x", "é" * 500, line * 300 + "end", "".join(random.choice("ab \n") for _ in range(30000)), line * 2]
    for text in texts:
        size, payload = gif_media.padded(text)
        media = gif_media.encode(payload)
        back, histogram, frames = gif_media.read_back(media)
        assert back == payload and size == len(text.encode())
        screen, found, _ = gif_media.decode(media)
        whole = sum(gif_media.colour_histogram(canvas) for canvas in gif_media.shown(screen, found))
        assert histogram.tolist() == whole.tolist()
    frames = gif_media.read_back(gif_media.encode(gif_media.padded(texts[3])[1]))[2]
    assert len(frames) == 3 and frames[1].height == 1 and frames[1].transparent >= 0 and frames[2].top > 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in gif_media.media_features(docs).collect()}
    media = {r["doc_id"]: bytes(r["content"]) for r in gif_media.store_texts(docs).collect()}
    for i in range(len(texts)):
        assert rows[i]["media_sha256"] == hashlib.sha256(media[i]).hexdigest() and rows[i]["media_bytes"] == len(media[i])
        assert rows[i]["feature"] == ",".join(map(str, gif_media.read_back(media[i])[1].tolist()))
    assert len({r["feature"] for r in rows.values()}) == len(texts)


def test_media_that_cannot_be_read(spark):
    huge = b"GIF89a" + b"\xff\xff\xff\xff\x00\x00\x00" + b";"
    good = gif_media.encode(bytes(64))
    rows = [(1, None, "x"), (2, b"", "x"), (3, good[:40], "x"), (4, huge, "x"), (None, good, "x"), (5, good, "x"), (5, good, "x")]
    media = spark.createDataFrame(rows, "media_id long, content binary, frame string")
    got = gif_media.decode_media(media).collect()
    assert Counter(r["media_id"] for r in got if r["error"]) == {1: 1, 2: 1, 3: 1, 4: 1}
    assert Counter(r["media_id"] for r in got if r["frame"] == 0) == {None: 1, 5: 2}
    assert gif_media.decode_media(media.limit(0)).count() == 0


def test_codec_on_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a é\U0001f600", 5), (3, "a é\U0001f600", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    encoded = bpe_codec.encode_documents(docs)
    back = sorted(((r["doc_id"], r["text"]) for r in bpe_codec.decode_documents(encoded).collect()), key=str)
    assert back == sorted([(1, ""), (2, ""), (3, "a é\U0001f600"), (3, "a é\U0001f600"), (None, "x")], key=str)
    assert bpe_codec.decode_documents(encoded.limit(0)).count() == 0


def test_clashing_names(spark):
    rows = [(1, "one two three four five six", "k", "l"), (2, "one two three four five six", "k", "l"), (3, "own words of this one here", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string, line_dropped string").withColumn("line_doc", F.lit(1))
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    cleaned = line_templates.drop_recurring_lines(docs)
    assert cleaned.columns == docs.columns and {r["doc_id"]: r["text"] for r in cleaned.collect()}[2] == ""
    assert jaccard_join.without_near_copies(docs.limit(0)).count() == 0
    assert storage.fresh("a", ["A", "_a"]) == "__a"


def test_a_text_of_some_megabytes(spark):
    docs = spark.createDataFrame([(1, "word and more words of it. " * 150_000)], "doc_id long, text string")
    assert bpe_codec.round_trip(docs).first()["decoded_sha256"] == hashlib.sha256(docs.first()["text"].encode()).hexdigest()
    assert pii.find_personal_data(docs).first()["n_email"] == 0
    assert quality_rules.repetition_rules(docs).first()["base_failed"]


# ------------------------------------------------------------------------------- the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(31)
    kinds = {"aa": ["the", "and", "with", "was", "house", "green"], "bb": ["der", "und", "nicht", "haus", "gruen", "weil"]}
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        body = " ".join(random.choice(kinds[lang]) + random.choice(["", "s", "en"]) for _ in range(40))
        rows.append((i, f"{body}\nprinted on page {i} of the green house", lang, f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " extra", rows[i][2], "s", 0) for i in range(10)]
    rows += [(300, "mail jo@ex.org about the green house and the other one", "aa", None, 0), (301, None, "aa", "s", 0), (302, "", None, "s", 0), (303, "12 ... 7", "bb", "s", 0)]
    rows += [(304, rows[5][1], "bb", "s", 0), (304, rows[5][1], "bb", "s", 0), (None, "the green house was with and the green", "aa", "s", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_pipeline_stages_are_those_of_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    step = [f for _, f in corpus_pipeline.STAGES]

    own = language_id.train(docs.select(*corpus_pipeline.COLUMNS))
    got = step[0](spark, docs, corpus)
    want = []
    for r in rows_of(docs):
        p, positions = language_id.document_probabilities(own, [r[1] or ""])
        if positions[0] and p.max() >= 0.5 + language_id.LEAST_LEAD * 0.5:
            want.append(r)
    assert rows_of(got) == want and {301, 302, 303}.isdisjoint(r[0] for r in want) and len(want) > 150

    cleaned = step[1](spark, got, corpus)
    texts = plain_lines([(r[0], r[1]) for r in want])
    expected = [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in want if texts[r[0]].strip(" ")]
    assert rows_of(cleaned) == sorted(expected, key=repr)

    unique = step[2](spark, cleaned, corpus)
    sets = {}
    for r in expected:
        w = words(r[1].lower())
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    component = {i: i for i in sets if i is not None}
    for _ in range(5):
        for a in component:
            for b in component:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    component[a] = min(component[a], component[b])
    alone = [r for r in expected if r[0] is None or component[r[0]] == r[0]]
    assert rows_of(unique) == sorted(alone, key=repr)

    masked = step[3](spark, unique, corpus)
    hidden = [(r[0], pii.masked(r[1]), r[2], r[3], len(pii.masked(r[1]))) for r in alone]
    assert rows_of(masked) == sorted(hidden, key=repr) and any("[EMAIL]" in r[1] for r in hidden)

    packed = step[4](spark, masked, corpus).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=repr) == sorted((r[0] for r in hidden), key=repr)
    result = corpus_pipeline.run(spark, corpus).collect()
    key = lambda r: repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(map(key, result)) == sorted(map(key, packed))


def test_pipeline_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
