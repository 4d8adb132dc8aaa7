"""Joins, writes, time and collection queries over the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import writes
from .catalog import ACCOUNTS, _changes, query
from .domain import Domain

AVERAGE = "floor(sum(floor(price * 100 + 0.5::DOUBLE)) / count(*) + 0.5::DOUBLE) / 100"


@query("SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'", domain=False)
def join_inner_2(d: Domain) -> DataFrame:
    orders = d.table("orders").filter("o_orderstatus = 'F'").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "o_custkey", "c_name", "o_totalprice")


@query("""SELECT o.product_id, o.competitor_id, c.name, p.title, n_name AS nation, o.price, o.recorded_at FROM observations o JOIN products p ON p.product_id = o.product_id
  JOIN competitors c ON c.competitor_id = o.competitor_id JOIN supplier ON s_suppkey = o.competitor_id JOIN nation ON n_nationkey = s_nationkey""")
def join_inner_4(d: Domain) -> DataFrame:
    places = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("competitor_id"), F.col("n_name").alias("nation"))
    rows = d.observations.join(d.competitors, "competitor_id").join(places, "competitor_id")
    return rows.join(d.products.select("product_id", "title"), "product_id").select("product_id", "competitor_id", "name", "title", "nation", "price", "recorded_at")


@query("SELECT count(*) AS n FROM links WHERE product_id IN (SELECT product_id FROM products WHERE user_id = 2)")
def semi_count(d: Domain) -> DataFrame:
    return d.links.join(d.products.filter("user_id = 2"), "product_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", domain=False)
def semi_in_subquery(d: Domain) -> DataFrame:
    urgent = d.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return d.table("customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(last_order, TIMESTAMP '1970-01-01') AS last_order FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""", domain=False)
def lookup_map(d: Domain) -> DataFrame:
    counted = d.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("at"))
    rows = d.table("customer").join(counted, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("at", F.expr("timestamp_ntz'1970-01-01'")).alias("last_order"))


@query(f"""SELECT p.product_id, title, coalesce(n, 0) AS prices, avg_price FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, {AVERAGE} AS avg_price FROM links WHERE is_active GROUP BY 1) s
  ON s.product_id = p.product_id""")
def nl_eval(d: Domain) -> DataFrame:
    """One grouped join instead of a query for each product."""
    average = F.floor(F.sum(F.floor(F.col("price") * 100 + 0.5)) / F.count("*") + 0.5).cast("double") / 100
    prices = d.links.filter("is_active").groupBy("product_id").agg(F.count("*").alias("n"), average.alias("avg_price"))
    return d.products.join(prices, "product_id", "left").select("product_id", "title", F.coalesce("n", F.lit(0)).alias("prices"), "avg_price")


STORE = """, stored AS (SELECT product_id, title, price, cost_price FROM products WHERE product_id % 3 <> 0),
  incoming AS (SELECT product_id, upper(title) AS title, price + 1 AS price, CASE WHEN product_id % 4 <> 0 THEN cost_price END AS cost_price FROM products WHERE product_id % 2 = 0)
"""


def _store(d: Domain) -> tuple[DataFrame, DataFrame]:
    stored = d.products.filter("product_id % 3 <> 0").select("product_id", "title", "price", "cost_price")
    cost = F.when(F.col("product_id") % 4 != 0, F.col("cost_price")).alias("cost_price")
    return stored, d.products.filter("product_id % 2 = 0").select("product_id", F.upper("title").alias("title"), (F.col("price") + 1).alias("price"), cost)


@query(STORE + """SELECT coalesce(i.product_id, s.product_id) AS product_id, CASE WHEN s.product_id IS NOT NULL THEN s.title ELSE i.title END AS title,
  CASE WHEN i.product_id IS NOT NULL THEN i.price ELSE s.price END AS price, coalesce(i.cost_price, s.cost_price) AS cost_price FROM stored s FULL JOIN incoming i ON i.product_id = s.product_id""")
def sink_upsert_product(d: Domain) -> DataFrame:
    """Price overwritten, cost kept where the new one is null, title never updated."""
    return writes.upsert(*_store(d), ["product_id"], keep_if_null=["cost_price"], never=["title"])


@query(STORE + "SELECT * FROM stored UNION ALL SELECT * FROM incoming WHERE product_id NOT IN (SELECT product_id FROM stored)")
def sink_insert_ignore(d: Domain) -> DataFrame:
    return writes.insert_ignore(*_store(d), ["product_id"])


@query("SELECT event_type, count(*) AS occurrences, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1", domain=False)
def sink_upsert_counter(d: Domain) -> DataFrame:
    """The later events counted onto the earlier ones' counters."""
    seen = d.table("events").select("event_type", F.col("ts").alias("at"), "event_id")
    empty = seen.limit(0).select("event_type", F.lit(0).cast("long").alias("occurrences"), F.col("at").alias("first_at"), F.col("at").alias("last_at"))
    stored = writes.count_up(empty, seen.filter("event_id % 2 = 0"), "event_type")
    return writes.count_up(stored, seen.filter("event_id % 2 = 1"), "event_type")


@query("SELECT competitor_id, name, CASE WHEN status = 'error' THEN 'inactive' ELSE status END AS status FROM competitors")
def sink_update(d: Domain) -> DataFrame:
    return writes.update(d.competitors, F.col("status") == "error", status=F.lit("inactive"))


@query("SELECT product_id, competitor_id, is_active AND coalesce(match_method, '') <> 'manual' AS is_active FROM links")
def sink_soft_delete(d: Domain) -> DataFrame:
    links = d.links.select("product_id", "competitor_id", "is_active", "match_method")
    return writes.update(links, F.col("match_method") == "manual", is_active=F.lit(False)).drop("match_method")


@query("SELECT product_id, competitor_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM competitors c WHERE c.competitor_id = l.competitor_id AND status = 'error')")
def delete_using(d: Domain) -> DataFrame:
    return writes.delete_using(d.links.select("product_id", "competitor_id"), d.competitors.filter("status = 'error'"), ["competitor_id"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IS DISTINCT FROM 'error'", domain=False)
def sink_hard_delete(d: Domain) -> DataFrame:
    return writes.delete(d.table("events").select("event_id", "user_id", "event_type"), F.col("event_type") == "error")


@query("""SELECT product_id, list_sort(list(price)) AS prices, count(*)::INT AS n, min(price) AS lowest, max(price) AS highest FROM links WHERE price > 0 GROUP BY 1""")
def fn_valid_prices(d: Domain) -> DataFrame:
    """A product's links are as many as its sellers, so its array is small."""
    prices = d.links.groupBy("product_id").agg(F.array_sort(F.collect_list("price")).alias("prices"))
    prices = prices.withColumn("prices", F.filter("prices", lambda p: (p > 0) & ~F.isnan(p))).filter(F.size("prices") > 0)
    return prices.select("product_id", "prices", F.size("prices").alias("n"), F.array_min("prices").alias("lowest"), F.array_max("prices").alias("highest"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events", domain=False)
def fn_json_get(d: Domain) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k")
    return d.table("events").select("event_id", k, F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("""SELECT event_id, datediff('day', DATE '1970-01-01', ts::DATE) AS day_bucket, datediff('day', DATE '1970-01-01', ts::DATE) * 288 + hour(ts) * 12 + minute(ts) // 5 AS job_bucket FROM events""", domain=False)
def fn_bucket(d: Domain) -> DataFrame:
    """Keys of the day and of five minutes, by wall clock and so in any session zone."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    return d.table("events").select("event_id", day.alias("day_bucket"), (day * 288 + F.hour("ts") * 12 + F.floor(F.minute("ts") / 5)).alias("job_bucket"))


@query("""SELECT DISTINCT recorded_at, (date_trunc('month', recorded_at) - INTERVAL 1 MONTH + to_days(day(recorded_at)::INT - 1))::DATE AS month_before, (recorded_at - INTERVAL 30 DAY)::DATE AS days_before FROM observations""")
def fn_minus_months(d: Domain) -> DataFrame:
    """A month earlier with a day beyond the month's end running over into the next."""
    at = F.col("recorded_at")
    month = F.date_add(F.add_months(F.trunc(at, "month"), -1), F.dayofmonth(at) - 1)
    return d.observations.select("recorded_at").distinct().select("recorded_at", month.alias("month_before"), F.date_sub(at, 30).alias("days_before"))


@query("SELECT user_id, max(ts) AS last_at, max(ts) < TIMESTAMP '2024-01-02' - INTERVAL 10 MINUTE AS stale FROM events GROUP BY 1", domain=False)
def fn_stale(d: Domain) -> DataFrame:
    last = d.table("events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return last.select("user_id", "last_at", (F.col("last_at") < F.expr("timestamp_ntz'2024-01-02' - interval 10 minutes")).alias("stale"))


@query("""SELECT user_id, event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events)""", domain=False)
def st_run_session(d: Domain) -> DataFrame:
    """Runs of a user's events that are at most ten minutes apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(order) <= F.expr("interval 10 minutes")
    rows = d.table("events").withColumn("new", F.when(near, 0).otherwise(1))
    return rows.select("user_id", "event_id", F.sum("new").over(order).alias("run"))


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS hits, count(*) > 3 AS limited FROM events GROUP BY 1, 2", domain=False)
def st_rate_window(d: Domain) -> DataFrame:
    """Hits in windows of 15 minutes aligned to the clock."""
    counted = d.table("events").groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("hits"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "hits", (F.col("hits") > 3).alias("limited"))


@query(ACCOUNTS + """, mine AS (SELECT o.* FROM owned o JOIN followed f ON f.user_id = o.user_id AND f.competitor_id = o.competitor_id),
  steps AS (SELECT product_id, competitor_id, recorded_at, price, lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY turn) AS before FROM observations),
  changed AS (SELECT s.* FROM steps s WHERE price <> before AND recorded_at >= (SELECT max(recorded_at) FROM observations) - INTERVAL 30 DAY)
  SELECT a.user_id, (SELECT count(*) FROM products p WHERE p.user_id = a.user_id) AS products, (SELECT count(*) FROM followed f WHERE f.user_id = a.user_id AND status = 'active') AS competitors,
    (SELECT count(*) FROM mine m WHERE m.user_id = a.user_id AND is_active) AS competitor_matches,
    (SELECT count(*) FROM changed c JOIN mine m ON m.product_id = c.product_id AND m.competitor_id = c.competitor_id WHERE m.user_id = a.user_id) AS monthly_changes,
    (SELECT count(*) FROM events e WHERE e.user_id = a.user_id AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY) AS alerts_monthly,
    (SELECT count(*) FROM orders WHERE o_custkey % 15 = a.user_id AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS ai_runs_monthly
  FROM (SELECT DISTINCT user_id FROM products) a""")
def agg_usage_6(d: Domain) -> DataFrame:
    """Each account's six counts; events stand for alerts and orders for recommendations."""

    def recent(rows: DataFrame, every: DataFrame, at: str) -> DataFrame:
        now = every.agg(F.max(at).alias("now"))
        return rows.crossJoin(F.broadcast(now)).filter(F.col(at) >= F.col("now") - F.expr("interval 30 days"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("user_id").agg(F.count("*").alias(name))

    mine = d.owned_links.join(d.followed.select("user_id", "competitor_id"), ["user_id", "competitor_id"], "left_semi")
    changed = recent(_changes(d).filter("new_price <> previous_price"), d.observations, "recorded_at")
    changed = changed.join(mine.select("user_id", "product_id", "competitor_id"), ["product_id", "competitor_id"])
    events, orders = d.table("events"), d.table("orders").select((F.col("o_custkey") % 15).alias("user_id"), "o_orderdate")
    counts = {
        "products": d.products, "competitors": d.followed.filter("status = 'active'"), "competitor_matches": mine.filter("is_active"), "monthly_changes": changed,
        "alerts_monthly": recent(events, events, "ts"), "ai_runs_monthly": recent(orders, orders, "o_orderdate"),
    }
    out = d.products.select("user_id").distinct()
    for name, rows in counts.items():
        out = out.join(counted(rows, name), "user_id", "left")
    return out.select("user_id", *(F.coalesce(name, F.lit(0)).alias(name) for name in counts))


@query("SELECT user_id, used, lim, CASE WHEN lim > 0 THEN used::DOUBLE / lim ELSE 0 END AS utilization, lim IS NOT NULL AND used + 1 > lim AS violates FROM (SELECT user_id, count(*) AS used, CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 1000 END::BIGINT AS lim FROM products GROUP BY 1)")
def prj_utilization(d: Domain) -> DataFrame:
    limit = F.when(F.col("user_id") % 3 == 0, 10).when(F.col("user_id") % 3 == 1, 1000).cast("long")
    used = d.products.groupBy("user_id").agg(F.count("*").alias("used")).withColumn("lim", limit)
    share = F.when(F.col("lim") > 0, F.col("used") / F.col("lim")).otherwise(F.lit(0.0)).alias("utilization")
    return used.select("user_id", "used", "lim", share, F.coalesce(F.col("used") + 1 > F.col("lim"), F.lit(False)).alias("violates"))
