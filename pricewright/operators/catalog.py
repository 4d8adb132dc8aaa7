"""The query catalogue: pricing, time series, changes, statistics, dedupe and text over the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from .domain import SQL, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, domain: bool = True):
    """Register a function of the domain under its name, with its oracle."""

    def register(function):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Domain(spark, sf_dir))
        if sql:
            ORACLE[name] = (SQL + sql) if domain else sql
        return function

    return register


URL_PARTS = r"""WITH split AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
  parts AS (SELECT *, contains(authority, '@') AS has_user, regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '\.$', '') AS host,
    CASE WHEN regexp_extract(authority, '(:[0-9]+)$', 1) IN (CASE scheme WHEN 'http' THEN ':80' ELSE ':443' END) THEN '' ELSE regexp_extract(authority, '(:[0-9]+)$', 1) END AS port FROM split)
"""
SNAPSHOTS = """, real_links AS (SELECT * FROM links WHERE (match_method IS NULL OR match_method <> 'auto-generated')
  AND (competitor_id + product_id % 15) % 3 <> 0),
snapshots AS (SELECT product_id, count(*) AS competitor_count, min(price) AS min_price, max(price) AS max_price,
  floor(sum(floor(price * 100 + 0.5::DOUBLE)) / count(*) + 0.5::DOUBLE) / 100 AS avg_price FROM real_links WHERE price > 0 GROUP BY 1)
"""
POSITION = """CASE WHEN avg_price IS NULL OR avg_price <= 0 THEN 'INSUFFICIENT_DATA'
  WHEN abs(floor(price * 100 + 0.5::DOUBLE) - floor(avg_price * 100 + 0.5::DOUBLE)) <= floor(floor(avg_price * 100 + 0.5::DOUBLE) * 0.03::DOUBLE + 0.5::DOUBLE) THEN 'COMPETITIVE'
  WHEN floor(price * 100 + 0.5::DOUBLE) < floor(avg_price * 100 + 0.5::DOUBLE) THEN 'LEADING' ELSE 'OVERPRICED' END"""


@query(SNAPSHOTS + f"""SELECT p.product_id, user_id, category, price, coalesce(competitor_count, 0) AS competitor_count, min_price, max_price, avg_price,
  CASE WHEN avg_price > 0 THEN greatest(floor(avg_price * 0.95::DOUBLE * 100 + 0.5::DOUBLE) / 100,
    CASE WHEN cost_price > 0 THEN floor(cost_price * 1.1::DOUBLE * 100 + 0.5::DOUBLE) / 100 ELSE 0 END) END AS recommended_price,
  {POSITION} AS market_position FROM products p LEFT JOIN snapshots s ON p.product_id = s.product_id""")
def market_position(d: Domain) -> DataFrame:
    """Every product against its market: one latest-link aggregate, one grouped join, expressions."""
    joined = d.products.join(d.snapshots, "product_id", "left")
    return joined.select(
        "product_id", "user_id", "category", "price", F.coalesce("competitor_count", F.lit(0)).alias("competitor_count"), "min_price", "max_price", "avg_price",
        money.recommended(F.col("avg_price"), F.col("cost_price")).alias("recommended_price"),
        money.position(F.col("price"), F.col("avg_price")).alias("market_position"),
    )


@query(SNAPSHOTS + f""", analysed AS (SELECT user_id, {POSITION} AS pos, avg_price > 0 AND cost_price > 0 AND
    floor(avg_price * CASE WHEN user_id * 10 - 5 >= 0 AND user_id * 10 - 5 < 100 THEN 1 - (user_id * 10 - 5)::DOUBLE / 100 ELSE 0.95::DOUBLE END * 100 + 0.5::DOUBLE) / 100
    < floor(cost_price * CASE WHEN user_id * 8 < 100 THEN 1 / (1 - (user_id * 8)::DOUBLE / 100) ELSE 1.1::DOUBLE END * 100 + 0.5::DOUBLE) / 100 AS margin_protected
    FROM products p LEFT JOIN snapshots s ON p.product_id = s.product_id WHERE is_tracked)
  SELECT user_id, count(*) AS products, count(*) FILTER (WHERE pos = 'LEADING') AS leading_products, count(*) FILTER (WHERE pos = 'COMPETITIVE') AS competitive_products,
  count(*) FILTER (WHERE pos = 'OVERPRICED') AS overpriced_products, count(*) FILTER (WHERE pos = 'INSUFFICIENT_DATA') AS unknown_products,
  count(*) FILTER (WHERE margin_protected) AS margin_protected_products FROM analysed GROUP BY 1""")
def agg_dashboard_stats(d: Domain) -> DataFrame:
    """Tracked products by position, and those whose recommendation is held up by the account's margin."""
    pos, average = money.position(F.col("price"), F.col("avg_price")), F.col("avg_price")
    floor = money.floor_price(F.col("cost_price"), money.margin_factor(F.col("user_id") * 8))
    held = (average > 0) & (money.round2(average * money.undercut_factor(F.col("user_id") * 10 - 5)) < floor)
    rows = d.products.filter("is_tracked").join(d.snapshots, "product_id", "left").select("user_id", pos.alias("pos"), held.alias("held"))
    kinds = {"leading": "LEADING", "competitive": "COMPETITIVE", "overpriced": "OVERPRICED", "unknown": "INSUFFICIENT_DATA"}
    counts = (F.count_if(F.col("pos") == v).alias(f"{k}_products") for k, v in kinds.items())
    return rows.groupBy("user_id").agg(F.count("*").alias("products"), *counts, F.count_if("held").alias("margin_protected_products"))


@query("""SELECT product_id, competitor_id, price, updated_at FROM links WHERE match_method IS NULL OR match_method <> 'auto-generated'""")
def flt_null_safe_ne(d: Domain) -> DataFrame:
    return d.links.filter(~F.col("match_method").eqNullSafe("auto-generated")).select("product_id", "competitor_id", "price", "updated_at")


@query("""SELECT product_id, title, price FROM products WHERE user_id = 3 AND is_tracked""")
def flt_tenant(d: Domain) -> DataFrame:
    return d.products.filter("user_id = 3 and is_tracked").select("product_id", "title", "price")


@query("""SELECT product_id, competitor_id, price, recorded_at FROM observations WHERE recorded_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31'""")
def flt_range(d: Domain) -> DataFrame:
    return d.observations.filter("recorded_at between timestamp_ntz'1998-01-01' and timestamp_ntz'1998-03-31'").select("product_id", "competitor_id", "price", "recorded_at")


@query("""SELECT product_id, title, vendor FROM products WHERE title ILIKE '%red%' OR vendor ILIKE '%#2_%'""")
def flt_ilike(d: Domain) -> DataFrame:
    return d.products.filter(F.col("title").ilike("%red%") | F.col("vendor").ilike("%#2_%")).select("product_id", "title", "vendor")


@query("""SELECT product_id, title, CASE WHEN title = 'red' THEN 0 WHEN title LIKE 'red%' THEN 1 ELSE 2 END AS search_rank FROM products
  WHERE title ILIKE '%red%' ORDER BY search_rank, price DESC NULLS LAST, product_id LIMIT 10""")
def prj_case_rank(d: Domain) -> DataFrame:
    rank = F.when(F.col("title") == "red", 0).when(F.col("title").startswith("red"), 1).otherwise(2).alias("search_rank")
    rows = d.products.filter(F.col("title").ilike("%red%")).select("product_id", "title", rank, "price")
    return rows.orderBy("search_rank", F.desc_nulls_last("price"), "product_id").limit(10).drop("price")


@query("""SELECT l.product_id, l.competitor_id, c.name, p.title, l.price AS competitor_price, p.price AS own_price FROM links l
  JOIN competitors c ON c.competitor_id = l.competitor_id JOIN products p ON p.product_id = l.product_id WHERE l.is_active AND c.status = 'active'""")
def join_inner_3(d: Domain) -> DataFrame:
    links = d.links.filter("is_active").withColumnRenamed("price", "competitor_price")
    rows = links.join(d.competitors.filter("status = 'active'"), "competitor_id").join(d.products.select("product_id", "title", F.col("price").alias("own_price")), "product_id")
    return rows.select("product_id", "competitor_id", "name", "title", "competitor_price", "own_price")


@query("""SELECT competitor_id, name FROM competitors WHERE competitor_id IN (SELECT competitor_id FROM links l JOIN products p ON p.product_id = l.product_id WHERE p.user_id = 4 AND l.is_active)""")
def semi_nested_join(d: Domain) -> DataFrame:
    mine = d.links.filter("is_active").join(d.products.filter("user_id = 4"), "product_id", "left_semi")
    return d.competitors.join(mine, "competitor_id", "left_semi").select("competitor_id", "name")


@query("""SELECT competitor_id, name FROM competitors c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.competitor_id = c.competitor_id AND l.is_active AND match_method = 'auto-generated')
  OR EXISTS (SELECT 1 FROM links l WHERE l.competitor_id = c.competitor_id AND l.is_active AND (match_method IS NULL OR match_method <> 'auto-generated'))""")
def anti_synthetic(d: Domain) -> DataFrame:
    synthetic = F.col("match_method").eqNullSafe("auto-generated")
    only = d.links.filter("is_active").groupBy("competitor_id").agg(F.bool_and(synthetic).alias("only")).filter("only")
    return d.competitors.join(only, "competitor_id", "left_anti").select("competitor_id", "name")


@query("""SELECT c.competitor_id, coalesce(n, 0) AS tracked FROM competitors c LEFT JOIN (SELECT competitor_id, count(*) AS n FROM links GROUP BY 1) l ON l.competitor_id = c.competitor_id""")
def agg_tracked_count(d: Domain) -> DataFrame:
    counted = d.links.groupBy("competitor_id").agg(F.count("*").alias("n"))
    return d.competitors.join(counted, "competitor_id", "left").select("competitor_id", F.coalesce("n", F.lit(0)).alias("tracked"))


@query("""SELECT p.product_id, p.price AS current_price, coalesce(n, 0) AS observations, coalesce(lowest, 0) AS min_price, coalesce(highest, 0) AS max_price, coalesce(average, 0) AS avg_price, latest_recorded_at
  FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, min(price) AS lowest, max(price) AS highest, floor(sum(floor(price * 100 + 0.5::DOUBLE)) / count(*) + 0.5::DOUBLE) / 100 AS average
    FROM observations WHERE recorded_at >= (SELECT max(recorded_at) FROM observations) - INTERVAL 30 DAY GROUP BY 1) s ON s.product_id = p.product_id
  LEFT JOIN (SELECT product_id, max(recorded_at) AS latest_recorded_at FROM observations GROUP BY 1) l ON l.product_id = p.product_id""")
def agg_price_summary(d: Domain) -> DataFrame:
    """Each product's prices in the 30 days up to the last observation of all, none as 0, and its own latest time."""
    now = d.observations.agg(F.max("recorded_at").alias("now"))
    recent = F.col("recorded_at") >= F.col("now") - F.expr("interval 30 days")
    rows = d.observations.crossJoin(F.broadcast(now)).select("product_id", "recorded_at", F.when(recent, F.col("price")).alias("recent"))
    average = F.floor(F.sum(F.floor(F.col("recent") * 100 + 0.5)) / F.count("recent") + 0.5).cast("double") / 100
    summary = rows.groupBy("product_id").agg(
        F.count("recent").alias("n"), F.min("recent").alias("lowest"), F.max("recent").alias("highest"),
        F.when(F.count("recent") > 0, average).alias("average"), F.max("recorded_at").alias("latest_recorded_at"),
    )
    shown = {"n": "observations", "lowest": "min_price", "highest": "max_price", "average": "avg_price"}
    zeros = (F.coalesce(c, F.lit(0)).alias(name) for c, name in shown.items())
    return d.products.join(summary, "product_id", "left").select("product_id", F.col("price").alias("current_price"), *zeros, "latest_recorded_at")


@query("""SELECT product_id, date_trunc('month', recorded_at)::TIMESTAMP AS month, count(*) AS n, floor(sum(floor(price * 100 + 0.5::DOUBLE)) / count(*) + 0.5::DOUBLE) / 100 AS avg_price,
  min(price) AS min_price, max(price) AS max_price FROM observations GROUP BY 1, 2 ORDER BY 1, 2""")
def agg_monthly_trend(d: Domain, months: int | None = None) -> DataFrame:
    """Each product's months in order: all of them, or with `months` those of observations so far back from the last of all."""
    rows = d.observations
    if months is not None:
        now = rows.agg(F.max("recorded_at").alias("now"))
        rows = rows.crossJoin(F.broadcast(now)).filter(F.col("recorded_at") >= F.col("now") - F.make_ym_interval(F.lit(0), F.lit(months)))
    month = F.date_trunc("month", "recorded_at").cast("timestamp_ntz").alias("month")
    average = F.floor(F.sum(F.floor(F.col("price") * 100 + 0.5)) / F.count("*") + 0.5).cast("double") / 100
    trend = rows.groupBy("product_id", month).agg(F.count("*").alias("n"), average.alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return trend.orderBy(F.asc_nulls_last("product_id"), F.asc_nulls_last("month"))


#: A product's state by its market position.
STATES = {"COMPETITIVE": "optimal", "LEADING": "underpriced", "OVERPRICED": "overpriced", "INSUFFICIENT_DATA": "alert"}


@query(SNAPSHOTS + f"""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE pos = 'COMPETITIVE') AS optimal, count(*) FILTER (WHERE pos = 'LEADING') AS underpriced, count(*) FILTER (WHERE pos = 'OVERPRICED') AS overpriced,
  count(*) FILTER (WHERE pos = 'INSUFFICIENT_DATA') AS alert, floor(sum(floor(price * 100 + 0.5::DOUBLE)) / count(*) + 0.5::DOUBLE) / 100 AS avg_price
  FROM (SELECT user_id, price, {POSITION} AS pos FROM products p LEFT JOIN snapshots s ON p.product_id = s.product_id WHERE is_tracked) GROUP BY 1""")
def agg_product_stats(d: Domain) -> DataFrame:
    """Each account's tracked products by state: counts of states, and their averages weighted by these."""
    joined = d.products.filter("is_tracked").join(d.snapshots, "product_id", "left")
    state = F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), money.position(F.col("price"), F.col("avg_price")))
    states = joined.groupBy("user_id", state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("price") * 100 + 0.5)).alias("cents"))
    counts = (F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATES.values())
    average = F.floor(F.sum("cents") / F.sum("n") + 0.5).cast("double") / 100
    return states.groupBy("user_id").agg(F.sum("n").alias("total"), *counts, average.alias("avg_price"))


ACCOUNTS = """, followed AS (SELECT user_id, competitor_id, status FROM (SELECT DISTINCT user_id FROM products) CROSS JOIN competitors WHERE (competitor_id + user_id) % 3 <> 0),
owned AS (SELECT p.user_id, l.* FROM links l JOIN products p ON p.product_id = l.product_id)
"""


@query(ACCOUNTS + """, visible AS (SELECT * FROM followed f WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = f.user_id AND o.competitor_id = f.competitor_id AND is_active AND match_method = 'auto-generated')
    OR EXISTS (SELECT 1 FROM owned o WHERE o.user_id = f.user_id AND o.competitor_id = f.competitor_id AND is_active AND (match_method IS NULL OR match_method <> 'auto-generated')))
  SELECT v.user_id, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'inactive') AS inactive, count(*) FILTER (WHERE status = 'error') AS error,
    coalesce(sum(n), 0)::BIGINT AS products_tracked FROM visible v LEFT JOIN (SELECT user_id, competitor_id, count(*) AS n FROM owned WHERE match_method IS NULL OR match_method <> 'auto-generated' GROUP BY 1, 2) t
    ON t.user_id = v.user_id AND t.competitor_id = v.competitor_id GROUP BY 1""")
def agg_competitor_stats(d: Domain) -> DataFrame:
    """Each account's competitors by state, without those it has only generated links to, and their real links."""
    synthetic = F.col("match_method").eqNullSafe("auto-generated")
    links = d.owned_links.groupBy("user_id", "competitor_id").agg(
        F.count_if(~synthetic).alias("real"), F.coalesce(F.bool_and(F.when(F.col("is_active"), synthetic)), F.lit(False)).alias("only_synthetic")
    )
    rows = d.followed.join(links, ["user_id", "competitor_id"], "left").filter(~F.coalesce("only_synthetic", F.lit(False)))
    states = (F.count_if(F.col("status") == s).alias(s) for s in ("active", "inactive", "error"))
    return rows.groupBy("user_id").agg(F.count("*").alias("total"), *states, F.coalesce(F.sum("real"), F.lit(0)).alias("products_tracked"))


def _hundredths(n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN '-' ELSE '' END || (abs({n}) // 100)::VARCHAR || '.' || lpad((abs({n}) % 100)::VARCHAR, 2, '0')"


@query(ACCOUNTS + f"""SELECT user_id, competitor_id, {_hundredths("h")} AS price_index, {_hundredths("(h - 10000)")} AS avg_price_diff, last_seen FROM (
  SELECT o.user_id, competitor_id, floor(sum(floor(o.price / p.price * 1000000000 + 0.5::DOUBLE)::BIGINT) FILTER (WHERE o.price > 0 AND p.price > 0) / (count(*) FILTER (WHERE o.price > 0 AND p.price > 0) * 100000) + 0.5::DOUBLE)::BIGINT AS h,
    max(updated_at) AS last_seen FROM owned o JOIN products p ON p.product_id = o.product_id WHERE is_active GROUP BY 1, 2) WHERE h IS NOT NULL""")
def agg_price_index(d: Domain) -> DataFrame:
    """How dear each competitor is for an account, in percent with two decimals as text, from ratios of nine
    decimals; last seen by all active links, priced or not."""
    pairs = d.links.filter("is_active").join(d.products.select("product_id", "user_id", F.col("price").alias("own")), "product_id")
    ratio = F.when((F.col("price") > 0) & (F.col("own") > 0), F.floor(F.col("price") / F.col("own") * 1_000_000_000 + 0.5).cast("long"))
    rows = pairs.groupBy("user_id", "competitor_id").agg(F.floor(F.sum(ratio) / (F.count(ratio) * 100_000) + 0.5).cast("long").alias("h"), F.max("updated_at").alias("last_seen"))
    shown = lambda n: F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 100).cast("string"), F.lit("."), F.lpad((F.abs(n) % 100).cast("string"), 2, "0"))
    return rows.filter("h is not null").select("user_id", "competitor_id", shown(F.col("h")).alias("price_index"), shown(F.col("h") - 10_000).alias("avg_price_diff"), "last_seen")


@query("""SELECT competitor_id, bool_or(is_active) AS any_active, bool_and(is_active) AS all_active FROM links GROUP BY 1""")
def agg_bool_or(d: Domain) -> DataFrame:
    return d.links.groupBy("competitor_id").agg(F.bool_or("is_active").alias("any_active"), F.bool_and("is_active").alias("all_active"))


@query("""SELECT DISTINCT category, vendor FROM products""")
def agg_distinct(d: Domain) -> DataFrame:
    return d.products.select("category", "vendor").distinct()


CHANGES = """, steps AS (SELECT product_id, competitor_id, recorded_at, price AS new_price, lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY turn) AS previous_price FROM observations),
changes AS (SELECT *, CASE WHEN new_price < previous_price THEN 'price_decrease' WHEN new_price > previous_price THEN 'price_increase' END AS change_type,
  CASE WHEN previous_price = 0 THEN 0 ELSE (new_price - previous_price) / previous_price * 100 END AS pct FROM steps)
"""


def _changes(d: Domain) -> DataFrame:
    steps = d.observations.select("product_id", "competitor_id", "recorded_at", F.col("price").alias("new_price"), F.lag("price").over(d.turns).alias("previous_price"))
    shown = F.lit("in_stock")
    kind = money.change_kind(F.col("previous_price"), F.col("new_price"), shown, shown)
    return steps.withColumn("change_type", kind).withColumn("pct", money.change_percent(F.col("previous_price"), F.col("new_price")))


@query(CHANGES + "SELECT product_id, competitor_id, recorded_at, previous_price, new_price, change_type FROM changes WHERE change_type IS NOT NULL")
def win_prev_price(d: Domain) -> DataFrame:
    return _changes(d).filter("change_type is not null").drop("pct")


@query(CHANGES + """, moved AS (SELECT c.*, user_id, CASE WHEN abs(pct) >= 10 THEN 'high' ELSE 'medium' END AS severity, CASE change_type WHEN 'price_decrease' THEN user_id % 4 * 5 ELSE user_id % 3 * 8 END AS threshold,
    CASE change_type WHEN 'price_decrease' THEN 'below' ELSE 'above' END AS condition FROM changes c JOIN products p ON p.product_id = c.product_id WHERE change_type IS NOT NULL AND abs(pct) >= 2)
  SELECT user_id, product_id, competitor_id, recorded_at, CASE change_type WHEN 'price_decrease' THEN 'price_drop' ELSE 'price_increase' END AS alert_type, severity, condition, floor(pct * 100 + 0.5::DOUBLE) / 100 AS pct FROM moved
  UNION ALL SELECT user_id, product_id, competitor_id, recorded_at, 'threshold', severity, condition, floor(pct * 100 + 0.5::DOUBLE) / 100 FROM moved WHERE threshold > 0 AND abs(pct) >= threshold""")
def fn_alert_rule(d: Domain) -> DataFrame:
    """An alert for each change of 2 percent or more, and another where it reaches what its account has set
    for drops or rises; accounts set these by their number, 0 for none."""
    rows = _changes(d).filter(F.col("change_type").isNotNull() & (F.abs("pct") >= 2)).join(d.products.select("product_id", "user_id"), "product_id")
    drop = F.col("change_type") == "price_decrease"
    threshold = F.when(drop, F.col("user_id") % 4 * 5).otherwise(F.col("user_id") % 3 * 8)
    kinds = F.array(F.when(drop, "price_drop").otherwise("price_increase"), F.when((threshold > 0) & (F.abs("pct") >= threshold), "threshold"))
    return rows.select(
        "user_id", "product_id", "competitor_id", "recorded_at", F.explode(F.array_compact(kinds)).alias("alert_type"), F.when(F.abs("pct") >= 10, "high").otherwise("medium").alias("severity"),
        F.when(drop, "below").otherwise("above").alias("condition"), money.round2(F.col("pct")).alias("pct"),
    )


@query("""SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""", domain=False)
def win_latest_per_key(d: Domain) -> DataFrame:
    latest = d.table("events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return latest.select("user_id", "event_type", "last.ts", "last.event_id")


@query("""SELECT product_id, competitor_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, competitor_id) AS r FROM links WHERE is_active) WHERE r <= 3""")
def win_top_n_group(d: Domain) -> DataFrame:
    cheapest = Window.partitionBy("product_id").orderBy("price", "competitor_id")
    return d.links.filter("is_active").withColumn("r", F.row_number().over(cheapest)).filter("r <= 3").select("product_id", "competitor_id", "price")


@query("""SELECT product_id, title, price FROM products ORDER BY price DESC NULLS LAST, product_id LIMIT 50 OFFSET 20""")
def sort_page(d: Domain) -> DataFrame:
    return d.products.select("product_id", "title", "price").orderBy(F.desc_nulls_last("price"), "product_id").offset(20).limit(50)


@query("""SELECT 'history' AS kind, product_id AS entity_id, recorded_at AS happened_at FROM observations
  UNION ALL SELECT event_type, user_id, ts FROM events ORDER BY happened_at DESC NULLS LAST, kind, entity_id""")
def set_timeline(d: Domain) -> DataFrame:
    """All price history and events, latest first."""
    history = d.observations.select(F.lit("history").alias("kind"), F.col("product_id").alias("entity_id"), F.col("recorded_at").alias("happened_at"))
    events = d.table("events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("entity_id"), F.col("ts").alias("happened_at"))
    return history.unionByName(events).orderBy(F.desc_nulls_last("happened_at"), "kind", "entity_id")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS content_hash FROM documents""", domain=False)
def fn_content_hash(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


SANITIZED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)(^|[^a-z0-9_])((?:authorization|cookie|set-cookie)[ \t\r\n]*:)[ \t\r\n]*[^\r\n]+', '\1\2 [REDACTED]', 'g'), '(?i)bearer[ \t\r\n]+[a-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'),
  '(?i)((?:api[_-]?key|passwd|password|secret|token|session|csrf)["'']?[ \t\r\n]*[:=][ \t\r\n]*)["''][^"'']*["'']', '\1"[REDACTED]"', 'g'),
  '(?i)((?:api[_-]?key|passwd|password|secret|token|session|csrf)["'']? *[:=] *)["'']?(?:[^ \n,;&"''\[]|\[[^R \n]|\[R[^E \n])[^ \n,;&]*', '\1[REDACTED]', 'g'),
  '(?i)([?&](?:token|key|secret|password|session|auth|code)=)[^&# \t\r\n"'']+', '\1[REDACTED]', 'g'),
  '(?i)(<input[^a-z0-9_>](?:[^>]*[^a-z0-9_>])?(?:type=["'']password["'']|name=["''][^"'']*(?:token|secret|password|session)[^"'']*["''])(?:[^>]*[^a-z0-9_>])?value=["''])[^"'']*(["''])', '\1[REDACTED]\2', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g')"""


@query(f"SELECT doc_id, sha256({SANITIZED}) AS redacted_hash FROM documents", domain=False)
def fn_sanitize(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.sha2(text.redacted(F.col("text")), 256).alias("redacted_hash"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM pages""", domain=False)
def fn_host_of(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.host_of(F.col("url")).alias("host"))


@query(URL_PARTS + r"""SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT has_user THEN scheme || '://' || regexp_replace(host, '^www\.', '') || port || coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform(kept, lambda p: {'n': split_part(p, '=', 1), 'p': p})), lambda x: x.p), '&') ELSE '' END END AS listing_url FROM (SELECT *, list_filter(string_split(query, '&'),
  lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'ref', 'ref_')) AS kept FROM parts)""", domain=False)
def fn_norm_listing_url(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.listing_url(F.col("url")).alias("listing_url"))
