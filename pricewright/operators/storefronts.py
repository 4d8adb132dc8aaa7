"""Queries over shops: the software behind pages and the times of daily jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schedule, storefront
from .catalog import query
from .domain import Domain
from .listings import sql_found

_NAMED = ", ".join(f"CASE WHEN {sql_found('html', pattern)} THEN '{name}' END" for name, pattern in storefront.MARKERS)
_KINDS = " ".join(f"WHEN len(list_filter(names, lambda n: starts_with(n, '{start}'))) > 0 THEN '{kind}'" for start, kind in storefront.PLATFORMS)


@query(f"""SELECT page_id, CASE {_KINDS} ELSE 'unknown' END AS platform, coalesce(array_to_string(names, '|'), '') AS markers, sha256(coalesce(array_to_string(names, '|'), '')) AS fingerprint
  FROM (SELECT page_id, list_sort(list_filter([{_NAMED}], lambda n: n IS NOT NULL)) AS names FROM pages)""", domain=False)
def fn_fingerprint(d: Domain) -> DataFrame:
    """Each page's markers of shop software, what they tell, and their hash."""
    rows = d.table("pages").select("page_id", storefront.markers(F.col("html")).alias("names"))
    return rows.select("page_id", storefront.platform(F.col("names")).alias("platform"), F.array_join("names", "|").alias("markers"), storefront.fingerprint(F.col("names")).alias("fingerprint"))


_ZONE = "CASE event_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata' ELSE 'Europe/Paris' END"


def _sql_ahead(micros: str) -> str:
    return f"(epoch_us(timezone(zone, make_timestamptz({micros}))) - {micros})"


def _sql_wall(wall: str) -> str:
    return f"({wall} - {_sql_ahead(f'({wall} - {_sql_ahead(wall)})')})"


@query(f"""SELECT event_id, CASE WHEN due > now THEN due ELSE {_sql_wall('(today + 86400000000 + clock)')} END AS due_us FROM (SELECT *, {_sql_wall('(today + clock)')} AS due FROM (SELECT *, (now + {_sql_ahead('now')}) // 86400000000 * 86400000000 AS today FROM (
  SELECT event_id, {_ZONE} AS zone, epoch_us(ts) + event_id % 365 * 86400000000 AS now, (event_id % 24 * 3600 + event_id % 60 * 60) * 1000000 AS clock FROM events)))""", domain=False)
def fn_next_daily(d: Domain) -> DataFrame:
    """When a daily job of an account runs next, by its zone's clock, summer time included; events' times are moved over a year."""
    key = F.col("event_id")
    zone = F.when(key % 4 == 0, "UTC").when(key % 4 == 1, "America/New_York").when(key % 4 == 2, "Asia/Kolkata").otherwise("Europe/Paris")
    now = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) + key % 365 * schedule.DAY
    rows = d.table("events").select("event_id", zone.alias("zone"), now.alias("now"))
    return rows.select("event_id", schedule.next_daily(F.col("now"), key % 24, key % 60, F.col("zone")).alias("due_us"))
