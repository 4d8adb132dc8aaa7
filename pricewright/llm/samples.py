"""Bounded, deterministic samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, key: str, limit: int, total: int | None = None) -> DataFrame:
    """At most ``limit`` rows, those whose key hashes lowest; about ``limit`` hashes pass the filter."""
    total = rows.count() if total is None else total
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(_SPACE))
    share = min(1.0, (1.1 * limit + 50) / max(1, total))
    return rows.filter(place < int(share * _SPACE)).orderBy(place, key).limit(limit)
