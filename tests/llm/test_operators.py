"""The operators against plain versions, and on awkward tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pricewright.llm import (
    bpe_codec, gif_media, jaccard_join, language_id, line_templates, packing, pii, pretokens, quality_classifier, quality_rules, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own string, length long"
AWKWARD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, 2), (3, " \n\t ", None, "s", 4, "x", 3), (4, "a b c d e f", "en", None, 11, "x", 4),
    (4, "a b c d e f", "en", None, 11, "x", 4), (None, "a b c d e f", "fr", "s", 11, "x", 5), (6, "Wörter " * 3000, "de", "s", 21000, "x", 6),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pretokens_are_the_patterns_matches():
    import public_tokenizers
    import tiktoken

    with open(bpe_codec.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    letters = list("ab'sStTrevmld  \n\t\r0129é٣日!?., 　​\U0001f600\x1c\x85'<|endoftext|>")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    own = bpe_codec.codec(bpe_codec.vocabulary_path())
    other = packing._encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    for encode in (own.encode, other):
        ids, first = encode(texts)
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert ids[a:b].tolist() == plain.encode_ordinary(text)
    ids, _ = own.encode(texts)
    assert own.decode(ids) == "".join(texts).encode()


def test_packing_is_whole_and_near_the_bound(spark, awkward, empty):
    rows = packing.best_fit_packing(awkward, capacity=64, groups=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r["piece"] == 0 for r in rows) == len(AWKWARD)
    assert packing.best_fit_packing(empty).count() == 0
    random.seed(1)
    for _ in range(5):
        histogram = {random.randint(1, 2048): random.randint(1, 500) for _ in range(300)}
        plan = packing.make_plan(histogram, groups=64)
        filled = {}
        for length, _, end, *_ in plan.runs():
            filled[length] = max(filled.get(length, 0), end)
        assert filled == histogram
        best = packing.Plan(2048)
        for length in sorted(histogram, reverse=True):
            best.best_fit(length, histogram[length])
        best.runs()
        assert plan.sequences <= 1.03 * best.sequences


def plain_pii(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([ -]?[0-9])+")
    phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
    spans = [(m.start(), 0, m.end()) for m in email.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, card, 14, 19), (3, phone, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def test_pii(awkward, empty):
    random.seed(1)
    parts = ["a", "b", "@", ".", "-", "1", "2", "0", " ", "+", "(", ")", "4111111111111111", "a@b.c", "1.2.3.4", "%"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert pii.base_spans(text) == plain_pii(text)
    _, spans, _ = pii.find("IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, DE88 3704 0044 0532 0130 00")
    assert [pii.KINDS[k] for _, k, _ in spans] == ["iban", "ssn"]
    assert pii.masked("mail a@b.cd or +1 (968) 555-9369") == "mail [EMAIL] or [PHONE]"
    assert pii.find_personal_data(awkward).count() == len(AWKWARD) and pii.find_personal_data(empty).count() == 0
    assert pii.mask_personal_data(awkward).columns == awkward.columns


def test_account_numbers_end_before_the_next_word():
    for number, after in (("ES91 2100 0418 4502 0005 1332", "BIC"), ("SE45 5000 0000 0583 9825 7466", "EUR"), ("ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00")):
        _, spans, _ = pii.find(f"{number} {after}")
        assert (0, pii.KINDS.index("iban"), len(number)) in spans and len(spans) == 1 + (after[:2] == "DE")
    assert pii.masked("AB12 3456 7890 DE89 3704 0044 0532 0130 00 now") == "AB12 3456 7890 [IBAN] now"
    assert not pii.find("DE88 3704 0044 0532 0130 00 BIC")[1]


def test_jaccard_components_are_those_of_brute_force(spark, empty):
    random.seed(2)
    words = [f"W{i}" for i in range(60)]
    base = [[random.choice(words) for _ in range(random.choice([2, 5, 40, 60]))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            text[random.randrange(len(text))] = random.choice(words)
        rows.append((i, random.choice([" ", "\n", "  "]).join(text)))
    rows += [(200, None), (201, ""), (202, " "), (3, rows[3][1]), (None, "a b c d e")]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    component = {i: i for i in ids}
    for _ in ids:
        before = dict(component)
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    component[a] = min(component[a], component[b])
        if before == component:
            break
    assert {i: got[i] for i in ids} == {i: (len(sets[i]), component[i]) for i in ids}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_lines(spark, awkward, empty):
    own = lambda n: " ".join(chr(97 + n) * k for k in range(1, 8))
    rows = [(n, f"{own(n)}\nPage {n} of 9 is shown here\nPosted today by {'abcdefgh'[n] * 4} on a day") for n in range(6)]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] == rows[0][1]
    assert all(texts[n] == own(n) for n in range(1, 6))
    assert line_templates.line_report(awkward).count() == len(AWKWARD) and line_templates.line_report(empty).count() == 0


def test_line_in_two_documents_is_kept_once(spark):
    passage = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(1, f"{passage}\nfirst text alone"), (2, f"second text alone\n{passage}"), (3, "third text alone"), (4, "said twice here"), (4, "said twice here")]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = sorted((r["doc_id"], r["text"]) for r in got.collect())
    assert texts == [(1, rows[0][1]), (2, "second text alone"), (3, "third text alone"), (4, "said twice here"), (4, "said twice here")]


def test_lines_that_only_share_their_opening_stay(spark):
    endings = ["came home", "went away", "stood still", "ran off", "fell down"]
    clean = [f"In the end {e}\nIn the end she\n{n} {n + 7} {n * 3}\nTotal {n} {n + 1} {n + 2}" for n, e in enumerate(endings)]
    clean = [text.replace(" she\n", f" {'abcde'[n]}\n") for n, text in enumerate(clean)]
    # Two documents with two variants each of one template; with a third it recurs.
    notice = lambda who: f"Posted today by {who} on a day"
    rows = list(enumerate(clean)) + [(10, f"{notice('al')}\n{notice('bo')}"), (11, f"{notice('cy')}\n{notice('di')}\nlast"), (12, "7 8 9\n7 8 9"), (13, "7 8 9\nnot 8")]
    make = lambda rows: {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert make(rows) == {**dict(rows), 13: "not 8"}
    assert make([*rows, (14, f"{notice('ed')}\nend")]) == {**dict(rows), 13: "not 8", 11: "last", 14: "end"}


def test_quality_rules_are_those_of_brute_force(awkward, empty):
    random.seed(5)
    parts = ["a ", "b ", "cc ", "\n", "é ", "| "]
    texts = ["".join(random.choice(parts) for _ in range(random.choice([0, 3, 30, 80]))) for _ in range(60)] + ["a b c d " * 20, "", " \n", "x"]
    measured = quality_rules.measure(texts)
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        longest = [0] * len(w)
        for a in range(len(w)):
            for b in range(len(w)):
                k = 0
                while a != b and max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                    k += 1
                longest[a] = max(longest[a], k)
        windows = {k for a, n in enumerate(longest) if n >= 8 for k in range(a, a + 8)}
        union = {k for a, n in enumerate(longest) if n >= 4 for k in range(a, a + n)}
        lines = [line for line in text.split("\n") if line.strip(" \t\r\v\f")]
        want = (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(windows), len(union), max(longest, default=0))
        names = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
        assert tuple(measured[c][i] for c in names) == want
    rows = quality_rules.repetition_rules(awkward).collect()
    assert len(rows) == len(AWKWARD) and not any(r["kept"] for r in rows if r["n_words"] < 20)
    assert quality_rules.repetition_rules(empty).count() == 0


def test_gradients_by_differences():
    model = language_id.ByteTagger(["a", "b"], hidden=3)
    for way in model.ways:
        way.table, way.turn = way.table.astype(float), way.turn.astype(float)
    ids, mask = language_id.padded([b"abc", b"ba", b"c"])
    labels, weights = np.array([0, 1, 0]), np.array([1.0, 2.0, 1.0])
    _, gradients = model.loss_gradients(ids, mask, labels, weights)
    for x, g, at in ((model.ways[0].turn, gradients[1], (0, 1, 2)), (model.ways[1].turn, gradients[3], (2, 0, 1)), (model.ways[0].table, gradients[0], (1, 98, 1))):
        held, step = x[at], 1e-2
        x[at] = held + step
        up, _ = model.loss_gradients(ids, mask, labels, weights)
        x[at] = held - step
        down, _ = model.loss_gradients(ids, mask, labels, weights)
        x[at] = held
        assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_language(spark, awkward, empty):
    random.seed(4)
    kinds = {"aa": ["the", "and", "with", "was"], "bb": ["der", "und", "für", "nicht"]}
    rows = [(i, " ".join(random.choice(kinds[lang]) for _ in range(20)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert sum(r["lang_pred"] == ("aa", "bb")[r["doc_id"] % 2] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(awkward).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and language_id.identify_languages(empty).count() == 0


def test_toxicity(spark, awkward, empty):
    random.seed(6)
    words = [a + b for a in "bdfgk" for b in ("an", "er", "il", "os")]
    rows, labels = [], []
    for i in range(400):
        w = [random.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[random.randrange(30)] = random.choice(["nastyword", "vileword"])
        rows.append((i, " ".join(w[:15]) + ". " + " ".join(w[15:]) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in got)
    found = [r for r in toxicity.offending_sentences(docs, toxicity.train(docs, known)).collect()]
    assert found and all("nastyword" in r["sentence"] or "vileword" in r["sentence"] for r in found[:20])
    assert toxicity.toxicity(awkward, known).count() == len(AWKWARD) and toxicity.toxicity(empty, known).count() == 0


def test_quality_classifier(spark, awkward, empty):
    docs = awkward.selectExpr("doc_id", "text", "source as host", "lang as path", "own")
    labels = spark.createDataFrame([(2, 0), (4, 1), (6, 1), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.hierarchical_quality(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    none = empty.selectExpr("doc_id", "text", "source as host", "lang as path")
    assert quality_classifier.hierarchical_quality(none, labels).count() == 0


def test_gif(awkward, empty):
    random.seed(2)
    for n in (0, 1, 2, 5, 300, 5000, 70000):
        for data in (bytes(random.randrange(256) for _ in range(n)), bytes(random.choice(b"ab") for _ in range(n)), b"\0" * n):
            assert gif_media.lzw_expand(gif_media.lzw_compress(data), 8, n) == data
    # The public three-colour sample of the format: a code size of 2 and entries of several samples.
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    want = "1111122222" * 3 + "1110000222" * 2 + "2220000111" * 2 + "2222211111" * 3
    assert gif_media.lzw_expand(stream, 2, 100) == bytes(map(int, want))
    rows = gif_media.media_features(awkward).collect()
    for r, source in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(AWKWARD, key=lambda r: str(r[0])), strict=True):
        payload = gif_media.padded(source[1] or "")[1]
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert gif_media.media_features(empty).count() == 0


def test_gif_disposal_and_transparency():
    red, green = np.array([255, 0, 0], np.uint8), np.array([0, 255, 0], np.uint8)
    palette = np.stack([red, green])
    frames = [
        gif_media.Frame(0, 0, 2, 1, b"\0\0", palette, disposal=1), gif_media.Frame(0, 0, 2, 1, b"\0\1", palette, disposal=3, transparent=0),
        gif_media.Frame(1, 0, 1, 1, b"\1", palette, disposal=2), gif_media.Frame(0, 0, 1, 1, b"\1", palette),
    ]
    shown = [[tuple(p[:3].tolist()) if p[3] else None for p in canvas[0]] for canvas in gif_media.shown((2, 1), frames)]
    r, g = (255, 0, 0), (0, 255, 0)
    assert shown == [[r, r], [r, g], [r, g], [g, None]]
