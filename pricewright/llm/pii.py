"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts.

Each candidate starts with its kind's score.  A passed checksum (Luhn for cards, mod-97 for
account numbers) raises it and a failed one ends it; context words of the kind within
``CONTEXT_CHARS`` code points raise it, and words that speak against it lower it.  Spans of the
base kinds (email, ip, card, phone) need only their validators; their score is information.
Spans of the other kinds stay when they reach the threshold and overlap no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import arrow_map, chunks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_iban long, n_ssn long, n_local_phone long, scores array<double>"
)
CONTEXT_CHARS = 50
THRESHOLD = 0.6

START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.5, "ssn": 0.4, "local_phone": 0.4}

#: Words near a span that speak for its kind.
FOR = {
    "email": r"e-?mail|mail|contact|contacto|kontakt|courriel|correo",
    "ip": r"ip|address|adresse|server|host|client|dirección",
    "card": r"card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|telefon|téléphone|teléfono|handy",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
    "local_phone": r"phone|tel|call|fax|mobile|telefon|téléphone|teléfono|handy",
}
AGAINST = r"version|release|order|isbn|issn|example|invoice|serial|part"

_FOR = {kind: re.compile(rf"(?i)\b(?:{words})\b") for kind, words in FOR.items()}
_AGAINST = re.compile(rf"(?i)\b(?:{AGAINST})\b")

# Linear forms of the base patterns.  A local part is the run of its characters before an "@";
# a number can only begin where its run of digits does, since a later start would fail alike.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SHORTEST_ACCOUNT = 15
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of account numbers: the first four characters go last, letters count from 10."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for match in _DOMAIN.finditer(text):
        at = match.start()
        # No local part holds an "@", so it begins after the one before, if not after a match.
        low = max(end, text.rfind("@", end, at) + 1)
        before = text[low:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            end = match.end()
            out.append((at - local, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) of the base kinds, in order."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in emails(text)]
    for match in _IP.finditer(text):
        # Parts may be long runs of digits: leading zeros aside, three digits tell.
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            spans.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                spans.append((match.start(), 3, match.end()))
    spans.sort()
    return spans


def account_spans(text: str):
    """Account numbers that pass mod-97 as (start, end): the longest at a group's end, since the
    pattern also takes in words that follow.  After a failure the later groups are tried."""
    at = 0
    while match := _IBAN.search(text, at):
        start, ends = match.start(), [match.end()]
        ends += [start + n for n in range(len(match[0]) - 1, 0, -1) if match[0][n] == " "]
        passed = (end for end in ends if len(account := text[start:end].replace(" ", "")) >= SHORTEST_ACCOUNT and mod97(account))
        at = next(passed, start + 1)
        if at > start + 1:
            yield start, at


def score(text: str, kind: str, start: int, end: int, checked: bool | None) -> float:
    """The kind's score, by checksum (``None``: it has none) and context."""
    if checked is False:
        return 0.0
    value = START_SCORE[kind] + (0.4 if checked else 0.0)
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    value += 0.3 * bool(_FOR[kind].search(near)) - 0.2 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """The base spans, all spans, and the scores of all."""
    base = base_spans(text)
    spans = [(span, score(text, KINDS[span[1]], span[0], span[2], True if span[1] == 2 else None)) for span in base]
    more = []
    for kind, pattern in ((4, _IBAN), (5, _SSN), (6, _LOCAL_PHONE)):
        for start, end in account_spans(text) if kind == 4 else (match.span() for match in pattern.finditer(text)):
            value = score(text, KINDS[kind], start, end, True if kind == 4 else None)
            if value >= threshold:
                more.append(((start, kind, end), value))
    if more:
        # Base spans go first, then earlier ones; both lists are in order of their starts.
        starts, reach, last = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)], 0
        for span, value in sorted(more):
            if max(last, reach[bisect_left(starts, span[2])]) <= span[0]:
                last = span[2]
                spans.append((span, value))
        spans.sort()
    return base, [span for span, _ in spans], [value for _, value in spans]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Personal data of each row's whole text in ``docs`` (doc_id, text): one row a document.

    Offsets count code points.  A null or empty text has no spans (``base_sha256`` is that of an
    empty string).  Repeated rows are repeated, a null doc_id stays null, other columns are left
    aside and an empty table gives no rows.
    """

    def found(batches):
        for rows, texts in chunks(batches, "text"):
            out = []
            for text in texts:
                base, spans, scores = find(text, threshold)
                count = [0] * len(KINDS)
                for _, kind, _ in spans:
                    count[kind] += 1
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                out.append((*count[:4], digest, listed(spans), *count[4:], scores))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.float64())]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], [p.split()[0] for p in FOUND.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), found, FOUND)


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each span, or union of overlapping ones, replaced by its kind in brackets."""
    _, spans, _ = find(text, threshold)
    if not spans:
        return text
    out, at, last = [], 0, -1
    for start, kind, end in spans:
        if start >= last:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = last = max(last, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data masked in ``text``; every other column stays as it is.

    A null text stays null.  Clashing names are no matter: no column is added.
    """
    schema = docs.schema

    def mask(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, threshold) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string()))

    return arrow_map(docs, mask, schema)
