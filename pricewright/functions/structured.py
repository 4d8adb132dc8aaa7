"""Structured values freed of secrets: JSON trees cut at a depth and a number of items."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import text
from .workers import arrow_rows

# Members whose values go, and how much of a tree stays.
SENSITIVE = re.compile(
    r"^(?:authorization|cookie|set-cookie|password|passwd|secret|client_secret|api_?key|access_?token|refresh_?token|session|sessionid|csrf|private_?key)$", re.IGNORECASE
)
DEEPEST, MOST_ITEMS, MOST_CHARS = 6, 100, 2_000
GONE, CUT = "[REDACTED]", "[TRUNCATED]"
REDACTIONS = [(re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", by)) for pattern, by in text.REDACTIONS]


def plain_text(value: str) -> str:
    for pattern, by in REDACTIONS:
        value = pattern.sub(by, value)
    return value[:MOST_CHARS]


def sanitized(value, depth: int = 0):
    """The tree without secrets: members of sensitive names and secrets inside texts; what lies deeper than
    ``DEEPEST`` is one word, and of a list or object the first ``MOST_ITEMS`` stay."""
    if depth > DEEPEST:
        return CUT
    if isinstance(value, str):
        return plain_text(value)
    if isinstance(value, list):
        return [sanitized(item, depth + 1) for item in value[:MOST_ITEMS]]
    if isinstance(value, dict):
        return {k: GONE if SENSITIVE.match(k) else sanitized(v, depth + 1) for k, v in list(value.items())[:MOST_ITEMS]}
    return value


def sanitized_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the JSON texts of a column sanitized and written compactly; null where it isn't JSON."""
    names = rows.columns

    def cleaned(batches):
        for batch in batches:
            out = []
            for one in batch.column(column).to_pylist():
                try:
                    out.append(None if one is None else json.dumps(sanitized(json.loads(one)), separators=(",", ":"), ensure_ascii=False))
                except (ValueError, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == column else batch.column(n) for n in names], names)

    return arrow_rows(rows, cleaned, rows.schema)
