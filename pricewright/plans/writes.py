"""Write rules as plans: each takes the stored rows and the new ones and returns the rows to store.

No table format with MERGE is bundled, so a write is a join or an aggregate over both sides, to be
written beside the old rows and swapped in.  A row with a null key matches
nothing: it is kept or appended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = (), never: Sequence[str] = ()) -> DataFrame:
    """New rows replace stored ones of the same key; others are kept or appended.

    Columns ``keep_if_null`` keep the stored value where the new one is null, columns ``never``
    always do.  ``new`` has one row for each key.
    """

    def value(c: str) -> Column:
        old, latest = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c in keys or c in keep_if_null:
            return F.coalesce(latest, old).alias(c)
        if c in never:
            return F.when(F.col("s._there").isNotNull(), old).otherwise(latest).alias(c)
        return F.when(F.col("n._there").isNotNull(), latest).otherwise(old).alias(c)

    marked = lambda df, name: df.withColumn("_there", F.lit(True)).alias(name)
    same = [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys]
    joined = marked(stored, "s").join(marked(new, "n"), same, "full_outer")
    return joined.select(*(value(c) for c in stored.columns))


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that aren't stored are appended, one for each key; stored rows stay."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def count_up(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, occurrences, first_at, last_at) with the sightings (key, at) added."""
    sightings = seen.groupBy(key).agg(F.count("*").alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return stored.unionByName(sightings).groupBy(key).agg(F.sum("occurrences").alias("occurrences"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def update(stored: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that meet the condition take the values; a null condition is not met."""
    for name, new in values.items():
        if name not in stored.columns:
            raise ValueError(f"no column {name}")
    met = F.coalesce(where, F.lit(False))
    return stored.select(*(F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns))


def delete(stored: DataFrame, where: Column) -> DataFrame:
    """The rows that don't meet the condition; a null condition is not met."""
    return stored.filter(~F.coalesce(where, F.lit(False)))


def delete_using(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def repointed(stored: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """``key`` of each row replaced along ``moves`` (old_id, new_id), where it has a row."""
    joined = stored.join(moves.select(F.col("old_id"), F.col("new_id")), stored[key] == F.col("old_id"), "left")
    return joined.select(*(F.coalesce("new_id", stored[key]).alias(key) if c == key else stored[c] for c in stored.columns))
