"""Pricing rules, matching and text queries over the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching, money, text
from .catalog import CHANGES, SNAPSHOTS, URL_PARTS, _changes, query
from .domain import Domain


@query("SELECT product_id, floor(price * 100 + 0.5::DOUBLE)::BIGINT AS price_cents, floor(cost_price * 100 + 0.5::DOUBLE)::BIGINT AS cost_cents FROM products")
def fn_cents(d: Domain) -> DataFrame:
    return d.products.select("product_id", money.cents(F.col("price")).alias("price_cents"), money.cents(F.col("cost_price")).alias("cost_cents"))


FACTORS = """CASE WHEN user_id * 10 - 5 >= 0 AND user_id * 10 - 5 < 100 THEN 1 - (user_id * 10 - 5)::DOUBLE / 100 ELSE 0.95::DOUBLE END AS undercut_factor,
  CASE WHEN user_id * 8 < 100 THEN 1 / (1 - (user_id * 8)::DOUBLE / 100) ELSE 1.1::DOUBLE END AS margin_factor"""


def _factors() -> tuple:
    return money.undercut_factor(F.col("user_id") * 10 - 5), money.margin_factor(F.col("user_id") * 8)


@query(f"SELECT DISTINCT user_id, {FACTORS} FROM products")
def fn_rules_from_percents(d: Domain) -> DataFrame:
    undercut, margin = _factors()
    return d.products.select("user_id").distinct().select("user_id", undercut.alias("undercut_factor"), margin.alias("margin_factor"))


@query(SNAPSHOTS + f""", ruled AS (SELECT p.*, s.avg_price, {FACTORS} FROM products p JOIN snapshots s ON s.product_id = p.product_id),
  priced AS (SELECT *, floor(avg_price * undercut_factor * 100 + 0.5::DOUBLE) / 100 AS undercut_price,
    CASE WHEN cost_price > 0 THEN floor(cost_price * margin_factor * 100 + 0.5::DOUBLE) / 100 ELSE 0::DOUBLE END AS floor_price FROM ruled)
  SELECT product_id, user_id, undercut_price, floor_price, greatest(undercut_price, floor_price) AS recommended_price, undercut_price < floor_price AS margin_protected FROM priced""")
def fn_recommend(d: Domain) -> DataFrame:
    """Each account's own undercut and margin, with the margin floor's flag."""
    undercut, margin = _factors()
    priced = d.products.join(d.snapshots, "product_id").select(
        "product_id", "user_id", money.round2(F.col("avg_price") * undercut).alias("undercut_price"), money.floor_price(F.col("cost_price"), margin).alias("floor_price")
    )
    priced = priced.withColumn("floor_price", F.coalesce("floor_price", F.lit(0.0)))
    return priced.select("*", F.greatest("undercut_price", "floor_price").alias("recommended_price"), (F.col("undercut_price") < F.col("floor_price")).alias("margin_protected"))


@query(SNAPSHOTS + """SELECT product_id, CASE WHEN cost_price > 0 THEN greatest(floor(cost_price * 1.1::DOUBLE * 100 + 0.5::DOUBLE) / 100, floor(price * 1.02::DOUBLE * 100 + 0.5::DOUBLE) / 100)
  ELSE floor(price * 1.05::DOUBLE * 100 + 0.5::DOUBLE) / 100 END AS recommended_price, 0.45::DOUBLE AS confidence
  FROM products p WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.product_id = p.product_id)""")
def fn_rec_fallback(d: Domain) -> DataFrame:
    """Products without a market: from the cost where it is known, else a small rise."""
    price, cost = F.col("price"), F.col("cost_price")
    best = F.when(cost > 0, F.greatest(money.floor_price(cost), money.round2(price * 1.02))).otherwise(money.round2(price * 1.05))
    return d.products.join(d.snapshots, "product_id", "left_anti").select("product_id", best.alias("recommended_price"), F.lit(0.45).alias("confidence"))


@query(SNAPSHOTS + """SELECT product_id, least(0.5::DOUBLE + 0.1::DOUBLE * competitor_count, 0.95::DOUBLE) AS confidence,
  least(1::DOUBLE, 0.5::DOUBLE + 0.15::DOUBLE * competitor_count) AS pipeline_confidence FROM snapshots""")
def fn_rec_confidence(d: Domain) -> DataFrame:
    n = F.col("competitor_count")
    one = F.least(F.lit(0.5) + F.lit(0.1) * n, F.lit(0.95)).alias("confidence")
    return d.snapshots.select("product_id", one, F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.15) * n).alias("pipeline_confidence"))


@query(CHANGES + """SELECT product_id, competitor_id, recorded_at, previous_price, new_price FROM changes
  WHERE previous_price > 0 AND abs(new_price - previous_price) / previous_price >= 0.01::DOUBLE""")
def fn_trivial_change(d: Domain) -> DataFrame:
    """Changes of 1 % or more."""
    kept = (F.col("previous_price") > 0) & (F.abs(F.col("new_price") - F.col("previous_price")) / F.col("previous_price") >= 0.01)
    return _changes(d).filter(kept).select("product_id", "competitor_id", "recorded_at", "previous_price", "new_price")


@query("SELECT product_id, coalesce(cost_price > 0 AND price < cost_price * 1.1::DOUBLE, false) AS refused FROM products")
def fn_push_floor(d: Domain) -> DataFrame:
    refused = (F.col("cost_price") > 0) & (F.col("price") < F.col("cost_price") * 1.1)
    return d.products.select("product_id", F.coalesce(refused, F.lit(False)).alias("refused"))


@query("""SELECT l.product_id, competitor_id, l.price, l.price BETWEEN 0.25::DOUBLE * p.price AND 4 * p.price AS plausible FROM links l JOIN products p ON p.product_id = l.product_id""")
def fn_plausible_band(d: Domain) -> DataFrame:
    own = d.products.select("product_id", F.col("price").alias("own"))
    return d.links.join(own, "product_id").select("product_id", "competitor_id", "price", F.col("price").between(F.col("own") * 0.25, F.col("own") * 4).alias("plausible"))


@query(SNAPSHOTS + """, facts AS (SELECT p.product_id, price, cost_price, competitor_count AS sources,
    greatest(floor(avg_price * 0.95::DOUBLE * 100 + 0.5::DOUBLE) / 100, CASE WHEN cost_price > 0 THEN floor(cost_price * 1.1::DOUBLE * 100 + 0.5::DOUBLE) / 100 ELSE 0 END) AS target
    FROM products p JOIN snapshots s ON s.product_id = p.product_id WHERE avg_price > 0 AND price > 0)
  SELECT product_id, CASE WHEN abs(target - price) < 0.01::DOUBLE THEN 'hold' WHEN target > price THEN 'raise' ELSE 'lower' END AS direction,
    floor((target - price) / price * 100 * 100 + 0.5::DOUBLE) / 100 AS percent, CASE WHEN sources < 2 THEN 'thin' WHEN sources < 3 THEN 'fair' ELSE 'solid' END AS evidence,
    (target - price) / price * 100 >= 25 AND sources < 3 AS needs_look,
    CASE WHEN cost_price > 0 THEN floor((target - cost_price) / target * 100 * 100 + 0.5::DOUBLE) / 100 END AS margin_percent FROM facts""")
def fn_facts(d: Domain) -> DataFrame:
    """What a recommendation says: direction, change, evidence and margin."""
    rows = d.products.filter("price > 0").join(d.snapshots.filter("avg_price > 0"), "product_id")
    rows = rows.withColumn("target", money.recommended(F.col("avg_price"), F.col("cost_price")))
    price, cost, target, sources = F.col("price"), F.col("cost_price"), F.col("target"), F.col("competitor_count")
    percent = (target - price) / price * 100
    return rows.select(
        "product_id", F.when(F.abs(target - price) < 0.01, "hold").when(target > price, "raise").otherwise("lower").alias("direction"),
        money.round2(percent).alias("percent"), F.when(sources < 2, "thin").when(sources < 3, "fair").otherwise("solid").alias("evidence"),
        ((percent >= 25) & (sources < 3)).alias("needs_look"), F.when(cost > 0, money.round2((target - cost) / target * 100)).alias("margin_percent"),
    )


STOCK = """, stocked AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'out_of_stock' ELSE 'in_stock' END AS stock FROM observations),
  moved AS (SELECT product_id, competitor_id, recorded_at, stock, price, lag(price) OVER w AS before, lag(stock) OVER w AS was FROM stocked WINDOW w AS (PARTITION BY product_id, competitor_id ORDER BY turn))
"""


@query(STOCK + """SELECT product_id, competitor_id, recorded_at, CASE WHEN was <> 'out_of_stock' AND stock = 'out_of_stock' THEN 'out_of_stock' WHEN was = 'out_of_stock' AND stock = 'in_stock' THEN 'back_in_stock'
  WHEN price < before THEN 'price_decrease' WHEN price > before THEN 'price_increase' END AS change_type, price - before AS diff, CASE WHEN before = 0 THEN 0 ELSE (price - before) / before * 100 END AS pct FROM moved""")
def fn_change(d: Domain) -> DataFrame:
    """Availability goes before the price; the difference is told all the same."""
    rows = d.observations.withColumn("stock", F.when(F.col("l_returnflag") == "A", "out_of_stock").otherwise("in_stock"))
    rows = rows.withColumn("before", F.lag("price").over(d.turns)).withColumn("was", F.lag("stock").over(d.turns))
    kind = money.change_kind(F.col("before"), F.col("price"), F.col("was"), F.col("stock"))
    percent = money.change_percent(F.col("before"), F.col("price")).alias("pct")
    return rows.select("product_id", "competitor_id", "recorded_at", kind.alias("change_type"), (F.col("price") - F.col("before")).alias("diff"), percent)


@query("SELECT event_id, greatest(0::DOUBLE, least(1::DOUBLE, value / 100)) AS score, least(60000::DOUBLE, 1000 * pow(2, event_id % 10)) AS wait_ms FROM events", domain=False)
def fn_clamp(d: Domain) -> DataFrame:
    wait = F.least(F.lit(60000.0), 1000 * F.pow(F.lit(2.0), F.col("event_id") % 10))
    return d.table("events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("score"), wait.alias("wait_ms"))


@query("""SELECT product_id, CASE product_id % 6 WHEN 0 THEN c / 100.0::DOUBLE WHEN 1 THEN c / 100.0::DOUBLE WHEN 2 THEN (100000 + c % 100000) / 100.0::DOUBLE WHEN 3 THEN (100000 + c % 100000) / 100.0::DOUBLE
  WHEN 4 THEN (1000 + c // 100 % 1000)::DOUBLE END AS amount FROM (SELECT product_id, floor(price * 100 + 0.5::DOUBLE)::BIGINT AS c FROM products)""")
def fn_parse_price(d: Domain) -> DataFrame:
    """Prices written in six ways are read back; the oracle has the amounts that were written."""
    c = money.cents(F.col("price"))
    whole, part = F.floor(c / 100).cast("long").cast("string"), F.lpad((c % 100).cast("string"), 2, "0")
    thousand = F.lpad((F.floor(c / 100).cast("long") % 1000).cast("string"), 3, "0")
    form = F.col("product_id") % 6
    shown = (
        F.when(form == 0, F.concat(F.lit("$"), whole, F.lit("."), part)).when(form == 1, F.concat(whole, F.lit(","), part, F.lit(" EUR")))
        .when(form == 2, F.concat(F.lit("1."), thousand, F.lit(","), part)).when(form == 3, F.concat(F.lit("1,"), thousand, F.lit("."), part))
        .when(form == 4, F.concat(F.lit("1,"), thousand)).otherwise(F.lit("call us"))
    )
    return d.products.select("product_id", matching.parsed_price(shown).alias("amount"))


@query(r"""SELECT product_id, nullif(upper(regexp_replace(vendor, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), '') AS sku, regexp_replace(lower(regexp_replace(title, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g') AS name,
  sha256(concat_ws('|', user_id::VARCHAR, vendor, coalesce(floor(cost_price * 100 + 0.5::DOUBLE)::BIGINT::VARCHAR, 'none'))) AS row_key,
  regexp_replace(lower(vendor), '[^a-z0-9]', '', 'g') = regexp_replace('BRAND-13', '[^A-Z0-9]', '', 'g').lower() AS same_brand FROM products""")
def fn_norm_sku(d: Domain) -> DataFrame:
    cost = F.coalesce(money.cents(F.col("cost_price")).cast("string"), F.lit("none"))
    return d.products.select(
        "product_id", text.normal_sku(F.col("vendor")).alias("sku"), text.normal_name(F.col("title")).alias("name"),
        F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "vendor", cost), 256).alias("row_key"),
        matching.equal_identifier(F.col("vendor"), F.lit("BRAND-13")).alias("same_brand"),
    )


TOKENS = """list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1 AND t NOT IN ('the', 'and', 'with', 'for'))"""


@query(f""", pairs AS (SELECT l.product_id, l.competitor_id, {TOKENS.format('p.title')} AS a, {TOKENS.format("c.name || ' ' || p.title || ' ' || p.category")} AS b
    FROM links l JOIN products p ON p.product_id = l.product_id JOIN competitors c ON c.competitor_id = l.competitor_id WHERE l.is_active)
  SELECT product_id, competitor_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END AS similarity FROM pairs""")
def fuzzy_match(d: Domain) -> DataFrame:
    """Each linked listing's title against its product's: pairs come from links, not from all pairs."""
    rows = d.links.filter("is_active").join(d.products.select("product_id", "title", "category"), "product_id").join(d.competitors.select("competitor_id", "name"), "competitor_id")
    a, b = matching.title_tokens(F.col("title")), matching.title_tokens(F.concat_ws(" ", "name", "title", "category"))
    return rows.select("product_id", "competitor_id", matching.jaccard(a, b).alias("similarity"))


@query("""SELECT product_id, CASE WHEN starts_with(lower(title), lower(vendor)) THEN title ELSE vendor || ' ' || title END || ' buy' AS buy_query,
  CASE WHEN starts_with(lower(title), lower(vendor)) THEN title ELSE vendor || ' ' || title END || ' price' AS price_query, split_part(category || '|' || vendor, '|', 1) AS top_category FROM products""")
def fn_search_queries(d: Domain) -> DataFrame:
    named = F.when(F.lower("title").startswith(F.lower("vendor")), F.col("title")).otherwise(F.concat_ws(" ", "vendor", "title"))
    top = F.split_part(F.concat_ws("|", "category", "vendor"), F.lit("|"), F.lit(1))
    return d.products.select("product_id", F.concat(named, F.lit(" buy")).alias("buy_query"), F.concat(named, F.lit(" price")).alias("price_query"), top.alias("top_category"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '')"


@query(URL_PARTS + r"""SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || port || regexp_replace(path, '/+$', '') END AS site_base,
  CASE WHEN ends_with(host, '.myshopify.com') THEN 'shopify' ELSE 'unknown' END AS platform, coalesce(nullif(regexp_replace(host, '^www\.', ''), ''), 'unknown') AS failure_domain FROM parts""", domain=False)
def fn_site_base(d: Domain) -> DataFrame:
    url, host = F.col("url"), text.host_of(F.col("url"))
    platform = F.when(host.endswith(".myshopify.com"), "shopify").otherwise("unknown")
    return d.table("pages").select("page_id", matching.site_base(url).alias("site_base"), platform.alias("platform"), F.coalesce(host, F.lit("unknown")).alias("failure_domain"))


@query(rf"""SELECT page_id, {HOST} IN ('youtube.com', 'm.youtube.com', 'reddit.com', 'facebook.com', 'instagram.com', 'twitter.com', 'x.com', 'pinterest.com', 'tiktok.com', 'wikipedia.org', 'quora.com', 'medium.com')
  OR regexp_matches({HOST}, '\.(youtube\.com|reddit\.com|facebook\.com|instagram\.com|twitter\.com|x\.com|pinterest\.com|tiktok\.com|wikipedia\.org|quora\.com|medium\.com)$') AS excluded FROM pages""", domain=False)
def fn_excluded_domain(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", matching.excluded_host(text.host_of(F.col("url"))).alias("excluded"))
