"""Streaming forms: price changes with a listing's state, events once, hits in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "product_id long, competitor_id long, recorded_at timestamp, previous_price double, new_price double, change_type string"


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["recorded_at", "price"], kind="stable")
    out = []
    for at, price in zip(rows["recorded_at"], rows["price"], strict=True):
        if pd.isna(price):
            continue
        if previous is not None and price != previous:
            out.append((*key, at, previous, price, "price_decrease" if price < previous else "price_increase"))
        previous = price
    if previous is not None:
        state.update((float(previous),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])


def price_changes(stream: DataFrame) -> DataFrame:
    """Changes in a stream of (product_id, competitor_id, recorded_at, price).

    A listing's state is its last price.  Prices that arrive together are taken by time; one that
    arrives later is compared with the last that came.  A null price is passed over.
    """
    rows = stream.select("product_id", "competitor_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), "price")
    return rows.groupBy("product_id", "competitor_id").applyInPandasWithState(_steps, CHANGE, "price double", "append", GroupStateTimeout.NoTimeout)


def alerts(changes: DataFrame, least: float = 2.0, high: float = 10.0) -> DataFrame:
    """Changes of ``least`` percent or more, with their severity."""
    percent = F.when(F.col("previous_price") != 0, (F.col("new_price") - F.col("previous_price")) / F.col("previous_price") * 100).otherwise(0.0)
    severity = F.when(F.abs("percent") >= high, "high").otherwise("medium")
    return changes.withColumn("percent", percent).filter(F.abs("percent") >= least).withColumn("severity", severity)


def events_once(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; ``ts`` may be without a zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def hits_in_windows(stream: DataFrame, width: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Events of each user in windows aligned to the clock."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("hits"))


def _anchored(width_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, hits = state.get if state.exists else (None, 0)
        out = []
        for rows in [pd.concat(list(batches)).sort_values("ts", kind="stable")]:
            for event, ts in zip(rows["event_id"], rows["ts"], strict=True):
                at = ts.value // 1_000_000
                if first is None or at >= first + width_ms:
                    first, hits = at, 0
                hits += 1
                out.append((*key, event, ts, hits))
        state.update((int(first), int(hits)))
        if first + width_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(first + width_ms))
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "hit"])

    return step


def anchored_hits(stream: DataFrame, key: str, width_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, ts, hit) of each event: its number in a window that opens with the key's first event after the last window.

    Hit 1 opens a window of ``width_ms``: it misses a cache of that time to live, and later hits are
    answered from it; hits above a limit are refused by a rate limit.  Events that come together are
    taken by time; one that comes after a later one of its key counts in the open window.  Rows
    without key or time are left out.  A key's state is dropped when the watermark passes its window.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).dropna(subset=["key", "ts"])
    rows = rows.withWatermark("ts", late)
    out = "key string, event_id long, ts timestamp, hit long"
    return rows.groupBy("key").applyInPandasWithState(_anchored(width_ms), out, "first_ms long, hits long", "append", GroupStateTimeout.EventTimeTimeout)


def _cooling(width_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else 0
        out = []
        for rows in [pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")]:
            for event, ts, failure in zip(rows["event_id"], rows["ts"], rows["failure"], strict=True):
                at = ts.value // 1_000_000
                if at < until:
                    out.append((*key, event, ts, "refused"))
                    continue
                if failure == "quota_exhausted":
                    until = at + width_ms
                out.append((*key, event, ts, "sent"))
        if until:
            state.update((int(until),))
            if until > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(int(until))
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "outcome"])

    return step


def cooldowns(stream: DataFrame, key: str, width_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, ts, outcome) of each request (key, event_id, ts, failure) to a service with a quota.

    A sent request that finds the quota exhausted closes the service to its key for ``width_ms``; what
    is asked until then is refused and opens nothing anew.  Requests that come together are taken by
    time; a late one is refused if it falls before the end of the last known cooldown.  Rows without
    key or time are left out.  A key's state is dropped when the watermark passes its cooldown.
    """
    columns = (F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("failure").cast("string"))
    rows = stream.select(F.col(key).cast("string").alias("key"), *columns).dropna(subset=["key", "ts"]).withWatermark("ts", late)
    out = "key string, event_id long, ts timestamp, outcome string"
    return rows.groupBy("key").applyInPandasWithState(_cooling(width_ms), out, "until_ms long", "append", GroupStateTimeout.EventTimeTimeout)
