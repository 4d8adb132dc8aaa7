"""Queries over pages and listings: addresses, page classes, price kinds and the scored match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching, pages, text
from .catalog import CHANGES, URL_PARTS, _changes, query
from .domain import Domain


def sql_pattern(pattern: str) -> str:
    """A pattern as a quoted string of the oracle's."""
    return "'" + pattern.replace("'", "''") + "'"


def sql_found(c: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {sql_pattern(p)})" for p in patterns) + ")"


@query(URL_PARTS + r"SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT has_user THEN regexp_replace(host, '^www\.', '') END AS domain FROM parts", domain=False)
def fn_norm_domain(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.shop_domain(F.col("url")).alias("domain"))


@query(URL_PARTS + r"SELECT page_id, CASE WHEN host <> '' THEN scheme || '://' || lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')) || port || coalesce(nullif(path, ''), '/') END AS source_url FROM parts", domain=False)
def fn_sanitize_url(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.source_url(F.col("url")).alias("source_url"))


VETO = rf"""coalesce(starts_with(h, 'support.') OR h = 'cnet.com' OR {sql_found('lower(path)', *pages.NOT_PRODUCT_PATHS)} OR contains(regexp_replace(lower(path), '/shop/products?(/|$)', '/', 'g'), '/shop/') OR h = '', true)"""


@query(URL_PARTS + rf"SELECT page_id, {VETO} AS vetoed FROM (SELECT *, regexp_replace(host, '^www\.', '') AS h FROM parts)", domain=False)
def fn_non_product_url(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", pages.not_product_url(F.col("url")).alias("vetoed"))


PRICED = sql_found("html", *pages.PRICE_ON_PAGE)


@query(f"SELECT page_id, {PRICED} AS has_price FROM pages", domain=False)
def fn_page_has_price(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", pages.has_price(F.col("html")).alias("has_price"))


@query(URL_PARTS + rf"""SELECT page_id, CASE WHEN {VETO} THEN 'non_product' WHEN structured AND many <= 1 THEN 'confirmed_product' WHEN many > 1 AND NOT (titled AND acts AND priced AND item) THEN 'non_product'
  WHEN (titled OR item) AND (acts OR priced) THEN 'probable_product' ELSE 'non_product' END AS page_class FROM (SELECT p.*, regexp_replace(host, '^www\.', '') AS h, len(regexp_extract_all(html, '(?i)"@type"[ \t\n\r]*:[ \t\n\r]*"?Product\b')) AS many,
    {sql_found('html', pages.STRUCTURED[0], pages.STRUCTURED[1])} AS structured, {sql_found('html', pages.INTERACTION)} AS acts, {sql_found('html', *pages.TITLED)} AS titled, {sql_found('p.url', pages.ITEM_PATH)} AS item, {PRICED} AS priced
    FROM parts p JOIN pages q ON q.page_id = p.page_id)""", domain=False)
def fn_classify_page(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", pages.page_class(F.col("html"), F.col("url")).alias("page_class"))


@query("SELECT page_id, contains(plain, printf('%.2f', price)) OR contains(plain, floor(price + 0.5::DOUBLE)::BIGINT::VARCHAR || '.') AS shown FROM (SELECT page_id, regexp_replace(html, '[,\\s]', '', 'g') AS plain, (page_id % 400 + 1)::DOUBLE AS price FROM pages)", domain=False)
def fn_price_on_page(d: Domain) -> DataFrame:
    price = (F.col("page_id") % 400 + 1).cast("double")
    return d.table("pages").select("page_id", pages.shows_price(price, F.col("html")).alias("shown"))


DECODED = "regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')"
for _pattern, _by in pages.ENTITIES:
    DECODED = f"regexp_replace({DECODED}, '{_pattern}', '{_by.replace(chr(39), chr(39) * 2)}', 'g')"


@query(f"SELECT page_id, sha256(nullif(trim({DECODED}), '')) AS text_hash FROM pages", domain=False)
def fn_clean_text(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", F.sha2(pages.clean_text(F.col("html")), 256).alias("text_hash"))


SCAN = "CASE WHEN trim(split_part(lower(text), '|', 1)) <> '' THEN trim(split_part(lower(text), '|', 1)) ELSE lower(text) END"
LADDER = " ".join(f"WHEN {sql_found('scan', p)} THEN '{k}'" for k, p in pages.PRICE_KINDS)


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(scan, '\$0(?:\.00)?\b') AND regexp_matches(low, 'subscriber|subscription|renews|membership') THEN 'subscription' {LADDER} ELSE 'current' END AS kind
  FROM (SELECT doc_id, lower(text) AS low, {SCAN} AS scan FROM documents)""", domain=False)
def fn_classify_price(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", pages.price_kind(F.col("text")).alias("kind"))


SHOWN_PRICE = "CASE product_id % 6 WHEN 0 THEN '€ 12' WHEN 1 THEN 'only 5 CHF' WHEN 2 THEN '£3' WHEN 3 THEN 'ABC 9' ELSE '7 now' END"


@query(f"""SELECT product_id, CASE WHEN upper(trim(given)) IN {pages.CURRENCIES} THEN upper(trim(given)) WHEN trim(given) = '¥' THEN 'JPY' WHEN contains(shown, '€') THEN 'EUR' WHEN contains(shown, '£') THEN 'GBP'
  WHEN regexp_extract(upper(shown), '\\b([A-Z]{{3}})\\b', 1) IN {pages.CURRENCIES} THEN regexp_extract(upper(shown), '\\b([A-Z]{{3}})\\b', 1) END AS currency
  FROM (SELECT product_id, CASE product_id % 5 WHEN 0 THEN ' usd ' WHEN 1 THEN '¥' WHEN 2 THEN 'pts' END AS given, {SHOWN_PRICE} AS shown FROM products)""")
def fn_norm_currency(d: Domain) -> DataFrame:
    key = F.col("product_id")
    given = F.when(key % 5 == 0, " usd ").when(key % 5 == 1, "¥").when(key % 5 == 2, "pts")
    shown = F.when(key % 6 == 0, "€ 12").when(key % 6 == 1, "only 5 CHF").when(key % 6 == 2, "£3").when(key % 6 == 3, "ABC 9").otherwise("7 now")
    return d.products.select("product_id", pages.currency(given, shown).alias("currency"))


@query("""SELECT product_id, nullif(amount, 0) AS amount, CASE WHEN amount > 0 THEN CASE product_id % 4 WHEN 1 THEN 'EUR' ELSE 'USD' END END AS currency FROM (
  SELECT product_id, CASE product_id % 4 WHEN 0 THEN c / 100::DOUBLE WHEN 1 THEN (c // 100 % 1000)::DOUBLE WHEN 2 THEN (100 + c // 100 % 1000 // 10) / 100::DOUBLE END AS amount
  FROM (SELECT product_id, floor(price * 100 + 0.5::DOUBLE)::BIGINT AS c FROM products))""")
def fn_parse_price_card(d: Domain) -> DataFrame:
    """Prices written in four ways are read back; of three digits after a dot the first two count, and no amount is 0."""
    rows = d.products.withColumn("c", F.floor(F.col("price") * 100 + 0.5).cast("long"))
    form, whole = F.col("product_id") % 4, F.floor(F.col("c") / 100).cast("long")
    shown = (
        F.when(form == 0, F.concat(F.lit("from $"), whole.cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0")))
        .when(form == 1, F.concat(F.lit("€ "), (whole % 1000).cast("string")))
        .when(form == 2, F.concat(F.lit("1."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(" each"))).otherwise(F.lit("call us"))
    )
    card = pages.card_price(shown)
    return rows.select("product_id", card.amount.alias("amount"), card.currency.alias("currency"))


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1 AND t NOT IN ('the', 'and', 'with', 'for'))"


def sql_models(c: str) -> str:
    return f"list_distinct(list_filter({sql_tokens(c)}, lambda t: t NOT IN {pages.GENERIC_TOKENS} AND ((regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]')) OR (NOT regexp_matches(t, '[a-z]') AND len(t) >= 3))))"


NAMED = "title || ' X' || (product_id % 7)::VARCHAR || 'B ' || (product_id * 37 % 2000)::VARCHAR || ' 4K'"


def _named():
    key = F.col("product_id")
    return F.concat(F.col("title"), F.lit(" X"), (key % 7).cast("string"), F.lit("B "), (key * 37 % 2000).cast("string"), F.lit(" 4K"))


@query(f"SELECT product_id, array_to_string(list_sort({sql_models(NAMED)}), ',') AS models FROM products")
def fn_model_tokens(d: Domain) -> DataFrame:
    return d.products.select("product_id", F.array_join(F.array_sort(pages.model_tokens(_named())), ",").alias("models"))


SEARCHED = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) > 1 AND t NOT IN " + str(matching.SEARCH_STOP_WORDS) + "))"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


SEARCH_HITS = f""", met AS (SELECT page_id, p.title, vendor, url, {TITLE} AS shown FROM pages JOIN products p ON p.product_id = page_id + 1),
  scored AS (SELECT *, lower(concat_ws(' ', shown, url)) AS hay FROM met),
  hits AS (SELECT page_id, url, (least(len(list_filter({SEARCHED.format("concat_ws(' ', vendor, title)")}, lambda t: contains(hay, t))), 5) + least(2 * len(list_filter({sql_models('title')}, lambda t: contains(hay, t))), 6)
    + CASE WHEN regexp_matches(url, '{pages.PRODUCT_PATH}') THEN 2 ELSE 0 END - CASE WHEN {sql_found('shown', pages.JUNK_TITLE)} THEN 5 ELSE 0 END)::INT AS relevance FROM scored)
"""


def search_hits(d: Domain) -> DataFrame:
    """Each page as a search result for the product of the next number: page_id, url, relevance."""
    shown = d.table("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("shown"), (F.col("page_id") + 1).alias("product_id"))
    rows = shown.join(d.products.select("product_id", "title", "vendor"), "product_id")
    return rows.select("page_id", "url", pages.relevance(F.col("title"), F.col("vendor"), F.col("url"), F.col("shown")).cast("int").alias("relevance"))


@query(SEARCH_HITS + "SELECT page_id, relevance FROM hits")
def fn_relevance(d: Domain) -> DataFrame:
    return search_hits(d).drop("url")


PAGE_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\.', '')"


@query(SEARCH_HITS + rf"""SELECT host, page_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY relevance DESC, page_id) AS r FROM (SELECT page_id, relevance, {PAGE_HOST} AS host FROM hits)
  WHERE NOT regexp_matches(host, '(^|\.)({"|".join(h.replace(".", chr(92) + ".") for h in matching.EXCLUDED_HOSTS)})$')) WHERE r = 1""")
def win_best_per_domain(d: Domain) -> DataFrame:
    """Each host's most relevant result, of equal ones the first page, without excluded hosts.  One aggregate, combined before the shuffle."""
    rows = search_hits(d).withColumn("host", text.host_of(F.col("url"))).filter(~matching.excluded_host(F.col("host")))
    best = rows.groupBy("host").agg(F.max(F.struct("relevance", (-F.col("page_id")).alias("order"))).alias("best"))
    return best.select("host", (-F.col("best.order")).alias("page_id"), "best.relevance")


@query(f""", met AS (SELECT product_id, competitor_id, {NAMED} AS title, vendor, CASE competitor_id % 3 WHEN 0 THEN 'Brand#13' WHEN 1 THEN vendor END AS shown_vendor, vendor || product_id::VARCHAR AS sku,
    CASE WHEN competitor_id % 4 = 0 THEN lower(vendor) || '-' || product_id::VARCHAR END AS shown_sku, CASE WHEN competitor_id % 2 = 0 THEN {NAMED} ELSE name || ' ' || title END AS shown,
    'https://shop.example/p/' || product_id::VARCHAR AS url FROM (SELECT l.product_id, l.competitor_id, p.title, p.vendor, c.name FROM links l JOIN products p ON p.product_id = l.product_id JOIN competitors c ON c.competitor_id = l.competitor_id WHERE l.is_active)),
  tokens AS (SELECT *, concat_ws(' ', shown, url, shown_sku) AS ident, {sql_tokens('title')} AS a, {sql_tokens('shown')} AS b, {sql_tokens('vendor')} AS va, coalesce({sql_tokens('shown_vendor')}, []) AS vb FROM met),
  parts AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END AS sim,
    coalesce(nullif(regexp_replace(lower(sku), '[^a-z0-9]', '', 'g'), '') = regexp_replace(lower(shown_sku), '[^a-z0-9]', '', 'g'), false) AS same_sku, {sql_models('title')} AS ma, {sql_models('ident')} AS mb,
    list_filter(a, lambda t: regexp_matches(t, '[0-9]')) AS xa, list_filter({sql_tokens('ident')}, lambda t: regexp_matches(t, '[0-9]')) AS xb, {sql_tokens('url')} AS ub FROM tokens),
  flags AS (SELECT *, len(list_filter(ma, lambda t: len(list_filter(mb, lambda u: u = t OR (len(t) >= 4 AND (contains(u, t) OR contains(t, u))))) > 0)) > 0 AS model,
    CASE WHEN len(xa) = 0 THEN 1::DOUBLE ELSE len(list_filter(xa, lambda t: len(list_filter(xb, lambda u: u = t OR (len(t) >= 3 AND (contains(u, t) OR contains(t, u))))) > 0))::DOUBLE / len(xa) END AS variant,
    len(list_intersect(va, vb)) > 0 AS shared, len(va) > 0 AND len(list_filter(va, lambda t: NOT list_contains(b, t))) = 0 AS in_title, len(va) > 0 AND len(list_filter(va, lambda t: NOT list_contains(ub, t))) = 0 AS in_url FROM parts),
  agreed AS (SELECT *, len(va) = 0 OR len(vb) = 0 OR shared OR in_title AS agrees, len(va) = 0 OR (len(vb) > 0 AND shared) OR in_title OR in_url AS confirmed FROM flags)
  SELECT product_id, competitor_id, sim AS title_similarity, CASE WHEN same_sku THEN 1::DOUBLE ELSE 0 END AS sku_confidence, model AS model_exact, variant AS variant_similarity, agrees AS vendor_matches, confirmed AS vendor_confirmed,
    same_sku OR sim >= 0.82::DOUBLE OR (model AND confirmed) AS identity_strong, greatest(sim, CASE WHEN same_sku THEN 1::DOUBLE ELSE 0 END, CASE WHEN model AND agrees THEN 0.93::DOUBLE ELSE 0 END) AS match_confidence,
    (same_sku OR sim >= 0.82::DOUBLE OR (model AND confirmed)) AND variant = 1 AND agrees AS is_match FROM agreed""")
def er_match(d: Domain) -> DataFrame:
    """Each linked listing against its product, by title, sku, model, variant and vendor."""
    products = d.products.select("product_id", F.col("title").alias("own"), _named().alias("title"), "vendor")
    rows = d.links.filter("is_active").select("product_id", "competitor_id").join(products, "product_id").join(d.competitors.select("competitor_id", "name"), "competitor_id")
    key, shop = F.col("product_id").cast("string"), F.col("competitor_id")
    shown = F.when(shop % 2 == 0, F.col("title")).otherwise(F.concat_ws(" ", "name", "own"))
    shown_vendor = F.when(shop % 3 == 0, "Brand#13").when(shop % 3 == 1, F.col("vendor"))
    shown_sku = F.when(shop % 4 == 0, F.concat(F.lower("vendor"), F.lit("-"), key))
    rows = rows.withColumns({"shown": shown, "shown_vendor": shown_vendor, "shown_sku": shown_sku, "sku": F.concat("vendor", key), "url": F.concat(F.lit("https://shop.example/p/"), key)})
    scored = pages.match_scores(rows, "title", "sku", "vendor", "shown", "shown_sku", "shown_vendor", "url")
    return scored.drop("own", "title", "vendor", "name", "shown", "shown_vendor", "shown_sku", "sku", "url")


MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'Invalid API key' WHEN 1 THEN 'no  searches left' WHEN 2 THEN NULL ELSE 'failed' END"
STATUS = "CASE event_id % 7 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 200 END"


@query(f"""SELECT event_id, CASE WHEN coalesce(status = 401, false) OR regexp_matches(m, 'invalid api key|authentication') THEN 'authentication_error' WHEN regexp_matches(m, '{pages.QUOTA}') THEN 'quota_exhausted' WHEN status = 429 THEN 'rate_limited'
  WHEN status = 403 THEN 'authentication_error' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'other_4xx' ELSE 'provider_error' END AS failure FROM (SELECT event_id, {STATUS} AS status, lower(coalesce({MESSAGE}, '')) AS m FROM events)""", domain=False)
def fn_failure_class(d: Domain) -> DataFrame:
    key = F.col("event_id")
    message = F.when(key % 6 == 0, "Invalid API key").when(key % 6 == 1, "no  searches left").when(key % 6 > 2, "failed")
    status = F.element_at(F.array(*(F.lit(s) for s in (401, 429, 403, 503, 404, 200, None))), (key % 7 + 1).cast("int"))
    return d.table("events").select("event_id", pages.search_failure(status, message).alias("failure"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'DE' ELSE CASE c_custkey % 5 WHEN 0 THEN 'FR' WHEN 1 THEN 'GB' WHEN 2 THEN 'MA' ELSE 'US' END END AS country FROM customer""", domain=False)
def fn_locale(d: Domain) -> DataFrame:
    key = F.col("c_custkey")
    given = F.when(key % 4 == 0, "de").when(key % 4 == 1, "zz")
    money = F.when(key % 5 == 0, "eur").when(key % 5 == 1, "GBP").when(key % 5 == 2, "mad").when(key % 5 == 3, "XXX")
    return d.table("customer").select("c_custkey", pages.country(given, money).alias("country"))


@query(CHANGES + """SELECT c.product_id, c.competitor_id, c.recorded_at, name || CASE change_type WHEN 'price_decrease' THEN ' lowered' ELSE ' raised' END || ' price for "' || title || '" from USD ' || printf('%.2f', previous_price) || ' to USD ' || printf('%.2f', new_price) ||
  ' (' || printf('%.1f', floor(abs(pct) * 10 + 0.5::DOUBLE) / 10) || CASE change_type WHEN 'price_decrease' THEN '% decrease).' ELSE '% increase).' END AS sentence
  FROM changes c JOIN products p ON p.product_id = c.product_id JOIN competitors k ON k.competitor_id = c.competitor_id WHERE change_type IS NOT NULL""")
def fn_event_text(d: Domain) -> DataFrame:
    rows = _changes(d).filter("change_type is not null").join(d.products.select("product_id", "title"), "product_id").join(d.competitors.select("competitor_id", "name"), "competitor_id")
    sentence = pages.change_text(*(F.col(c) for c in ("change_type", "title", "name", "previous_price", "new_price", "pct")))
    return rows.select("product_id", "competitor_id", "recorded_at", sentence.alias("sentence"))
