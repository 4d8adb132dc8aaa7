"""Queries of page extraction: whole ``pages``, and a page written from each product's row, as no given page sells anything.

The eighth part of the products each has JSON-LD with an accessory, a selected variant, variants
without a selection, assigned JSON, visible text, two sources in conflict, meta tags, and item
properties.  The oracle states what each must come to.  It knows no prices in the text of ``pages``
(none of 250 has one at 0.01).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import page_products as plan
from .catalog import query
from .domain import Domain
from .listings import DECODED, NAMED, _named

#: Added to a product's number to tell its page from the given ones.
OWN = 1_000_000_000


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in members.items())))


def _struct(**members: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in members.items()))


def all_pages(d: Domain) -> DataFrame:
    """page_id, url and html."""
    key, title, vendor = F.col("product_id"), _named(), F.col("vendor")
    price, double = F.format_string("%.2f", "price"), F.format_string("%.2f", F.col("price") * 2)
    number, sku = key.cast("string"), F.concat(F.lit("P-"), key.cast("string"))
    wrap = lambda head, body, tail="</script>": F.concat(F.lit(head), body, F.lit(tail))
    ld, app = '<script type="application/ld+json">', '<SCRIPT type="application/json">'
    heading = wrap("<h1>", title, "</h1>\n")
    list_price = _struct(price=double, priceType=F.lit("ListPrice"))
    main = F.to_json(_struct(**{"@type": F.lit("Product"), "name": title, "sku": sku, "productId": number, "brand": _struct(name=vendor), "offers": _struct(price=price, priceCurrency=F.lit("EUR"), priceSpecification=list_price)}))
    clashing = F.to_json(_struct(**{"@type": F.array(F.lit("Thing"), F.lit("Product")), "name": F.lit("Spare part"), "productId": F.concat(F.lit("x"), number), "offers": F.array(_struct(price=F.lit("9.50"), priceCurrency=F.lit("EUR")))}))
    spare = F.to_json(_struct(**{"@type": F.lit("product"), "name": F.lit("Spare part")}))
    first = _struct(id=key * 10 + 1, title=F.lit("Red"), price=price, compare_at_price=double, sku=F.concat(F.lit("V"), number))
    second = _struct(id=key * 10 + 2, title=F.lit("Blue"), price=double, compare_at_price=F.lit(None).cast("string"), sku=F.lit(None).cast("string"))
    selected = _json(product=_struct(id=key, handle=F.concat(F.lit("h"), number), title=title, vendor=vendor, currency=F.lit("USD"), variants=F.array(first, second)))
    sizes = F.array(_struct(id=F.lit(1), title=F.lit("S"), price=price), _struct(id=F.lit(2), title=F.lit("L"), price=double))
    unselected = _json(product=_struct(id=key, title=title, currency=F.lit("USD"), variants=sizes))
    state = _json(product=_struct(name=title, price=F.col("price"), currency=F.lit("GBP")))
    dear = F.to_json(_struct(**{"@type": F.lit("Product"), "name": title, "offers": _struct(price=double, priceCurrency=F.lit("USD"))}))
    cheap = _json(product=_struct(title=title, currency=F.lit("USD"), variants=F.array(_struct(id=F.lit(301), price=price))))
    forms = (
        F.concat(heading, wrap(ld, F.concat(F.lit("["), main, F.lit(","), F.when(key % 16 == 0, clashing).otherwise(spare), F.lit("]")))),
        F.concat(wrap(ld, F.lit("{broken")), wrap(app, selected)), wrap(app, unselected), wrap("<script>var a = 1; window.__STATE__ = ", state, ";\n</script>"),
        F.concat(heading, wrap("<p>SKU: ", sku, "</p>\n"), wrap("<p>Sale price $", price, ""), wrap(" Regular price $", double, "</p>\n<p>Palm rest $9.99</p>")),
        F.concat(heading, wrap(ld, dear), wrap(app, cheap)),
        F.concat(wrap('<meta property="OG:title" content="', title, '">'), wrap("<meta property='product:price:amount' content='", price, "'>"), F.lit('<meta property="product:price:currency" content="EUR">'), wrap('<meta property="product:brand" content="', vendor, '">')),
        F.concat(wrap('<h1 itemprop="name">', title, "</h1>"), wrap('<span itemprop="price" content="', price, '"></span>'), F.lit("<i itemprop='priceCurrency'>GBP</i>"), wrap('<meta itemprop="sku" content="', sku, '">')),
    )
    html = forms[-1]
    for n, form in enumerate(forms[:-1]):
        html = F.when(key % 8 == n, form).otherwise(html)
    url = F.concat(F.lit("https://shop.example/products/"), F.replace(F.lower(title), F.lit(" "), F.lit("-")), F.when(key % 8 == 1, F.concat(F.lit("?variant="), (key * 10 + 1).cast("string"))).otherwise(""))
    own = d.products.select((key + OWN).alias("page_id"), url.alias("url"), html.alias("html"))
    return d.table("pages").select("page_id", "url", "html").unionByName(own)


def permille(c) -> Column:
    """Rounded, so that both sides show the same."""
    return F.floor(F.col(c) * 1000 + 0.5).cast("long") if isinstance(c, str) else F.floor(c * 1000 + 0.5).cast("long")


def _joined(c: str, name: str) -> Column:
    return F.array_join(F.transform(c, lambda p: p[name].cast("string")), ",")


PAGE_TITLE = DECODED.replace("(html,", r"(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1),", 1)
# What each form must come to: f is the form, t the title, p the price.
FORMS = f""", own AS (SELECT product_id + {OWN} AS page_id, product_id, product_id % 8 AS f, product_id % 16 = 0 AS clash, {NAMED} AS t, price AS p, vendor AS v,
    'https://shop.example/products/' || replace(lower({NAMED}), ' ', '-') || CASE WHEN product_id % 8 = 1 THEN '?variant=' || (product_id * 10 + 1)::VARCHAR ELSE '' END AS url FROM products),
  given AS (SELECT * FROM (SELECT page_id, url, nullif(trim({PAGE_TITLE}), '') AS t FROM pages) WHERE t IS NOT NULL),
  facts AS (SELECT * FROM own JOIN (VALUES (0, 'json-ld,page-text', 1220, 1000, 'confident', '', 'EUR', 1), (1, 'shopify-json,embedded-json', 1420, 1000, 'confident', '', 'USD', 2),
    (2, 'shopify-json,embedded-json', 1100, 616, 'unresolved', 'missing_price,variant_ambiguity,low_confidence', NULL, 0), (3, 'embedded-json', 1040, 893, 'confident', '', 'GBP', 1),
    (4, 'page-text', 480, 493, 'ambiguous', 'unsupported_page_structure,low_confidence', 'USD', 1), (5, 'json-ld,shopify-json,embedded-json,page-text', 1480, 1000, 'confident', '', 'USD', 2),
    (6, 'product-meta,page-text', 870, 771, 'ambiguous', 'low_confidence', 'EUR', 1), (7, 'semantic-html,page-text', 980, 850, 'confident', '', 'GBP', 1))
    x(form, sources, score, permille, state, reasons, currency, n_sources) ON f = form)
"""
EMPTY = "NULL::DOUBLE"


@query(FORMS + f"""SELECT page_id, place::INT AS place, source, title, product_id, variant_id, sku, n_prices::INT AS n_prices, ambiguous, score::BIGINT AS score FROM (
  SELECT page_id, 0 AS place, 'json-ld' AS source, t AS title, product_id::VARCHAR AS product_id, NULL AS variant_id, 'P-' || product_id AS sku, 2 AS n_prices, false AS ambiguous, 1140 AS score FROM own WHERE f = 0
  UNION ALL SELECT page_id, 1, 'json-ld', 'Spare part', CASE WHEN clash THEN 'x' || product_id END, NULL, NULL, CASE WHEN clash THEN 1 ELSE 0 END, false, CASE WHEN clash THEN 1140 ELSE 920 END FROM own WHERE f = 0
  UNION ALL SELECT page_id, k, s, t, product_id::VARCHAR, (product_id * 10 + 1)::VARCHAR, 'V' || product_id, 2, false, 1340 - 200 * k FROM own, (VALUES (0, 'shopify-json'), (1, 'embedded-json')) x(k, s) WHERE f = 1
  UNION ALL SELECT page_id, k, s, t, product_id::VARCHAR, NULL, NULL, 0, true, 1020 - 200 * k FROM own, (VALUES (0, 'shopify-json'), (1, 'embedded-json')) x(k, s) WHERE f = 2
  UNION ALL SELECT page_id, 0, 'embedded-json', t, NULL, NULL, NULL, 1, false, 1040 FROM own WHERE f = 3
  UNION ALL SELECT page_id, k, s, t, NULL, CASE WHEN k > 0 THEN '301' END, NULL, 1, false, w FROM own, (VALUES (0, 'json-ld', 1040), (1, 'shopify-json', 1240), (2, 'embedded-json', 1040)) x(k, s, w) WHERE f = 5)""")
def ex_object(d: Domain) -> DataFrame:
    rows = plan.object_candidates(all_pages(d), "page_id", "url", "html")
    return rows.select("page_id", F.col("cand").cast("int").alias("place"), "source", "title", "product_id", "variant_id", "sku", F.size("prices").alias("n_prices"), "ambiguous", permille("score").alias("score"))


@query(FORMS + """SELECT page_id, t AS title, CASE WHEN f = 4 THEN 'sale,original' ELSE '' END AS kinds, CASE WHEN f = 4 THEN floor(p * 100 + 0.5::DOUBLE)::BIGINT + floor(p * 200 + 0.5::DOUBLE)::BIGINT ELSE 0 END AS cents FROM own WHERE f IN (0, 4, 5, 6, 7)
  UNION ALL SELECT page_id, t, '', 0 FROM given""")
def ex_text(d: Domain) -> DataFrame:
    rows = plan.candidates(all_pages(d), "page_id", "url", "html").filter("source = 'page-text'")
    cents = F.aggregate("prices", F.lit(0).cast("long"), lambda total, p: total + F.floor(p["value"] * 100 + 0.5).cast("long"))
    return rows.select("page_id", "title", _joined("prices", "kind").alias("kinds"), cents.alias("cents"))


@query(FORMS + """SELECT page_id, t AS title, sources, score::BIGINT AS score, CASE f WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END::INT AS n_prices FROM facts
  UNION ALL SELECT page_id, 'Spare part', 'json-ld', CASE WHEN clash THEN 1140 ELSE 920 END, CASE WHEN clash THEN 1 ELSE 0 END FROM own WHERE f = 0
  UNION ALL SELECT page_id, t, 'page-text', 480, 0 FROM given""")
def ex_merge(d: Domain) -> DataFrame:
    rows = plan.merged(plan.candidates(all_pages(d), "page_id", "url", "html"), "page_id")
    return rows.select("page_id", "title", F.array_join("sources", ",").alias("sources"), permille("score").alias("score"), F.size("prices").alias("n_prices"))


@query(FORMS + f"""SELECT page_id, t AS title, CASE WHEN f <> 2 THEN p END AS price, CASE WHEN f IN (0, 1, 4) THEN floor(p * 200 + 0.5::DOUBLE) / 100 END AS original, CASE WHEN f = 2 THEN NULL WHEN f = 4 THEN 'sale' ELSE 'current' END AS kind,
    f = 5 AS conflict, true AS settled, n_sources::INT AS n_sources, permille::BIGINT AS evidence FROM facts
  UNION ALL SELECT page_id, 'Spare part', CASE WHEN clash THEN 9.5::DOUBLE END, NULL, CASE WHEN clash THEN 'current' END, false, true, clash::INT, CASE WHEN clash THEN 964 ELSE 687 END FROM own WHERE f = 0
  UNION ALL SELECT page_id, t, {EMPTY}, {EMPTY}, NULL, false, true, 0, 373 FROM given""")
def ex_resolve_price(d: Domain) -> DataFrame:
    rows = plan.priced(plan.merged(plan.candidates(all_pages(d), "page_id", "url", "html"), "page_id"))
    return rows.select(
        "page_id", "title", F.col("current.value").alias("price"), F.col("original.value").alias("original"), F.col("current.kind").alias("kind"),
        "conflict", "settled", "n_sources", permille("evidence_score").alias("evidence"),
    )


@query(FORMS + """SELECT page_id, t AS title, CASE WHEN f IN (0, 1, 2) THEN product_id::VARCHAR END AS product_id, CASE WHEN f = 0 THEN 2 ELSE 1 END::BIGINT AS n_products, f = 0 AND clash AS product_conflict FROM own
  UNION ALL SELECT page_id, t, NULL, 1, false FROM given""")
def ex_resolve_identity(d: Domain) -> DataFrame:
    rows = plan.chosen(plan.priced(plan.merged(plan.candidates(all_pages(d), "page_id", "url", "html"), "page_id")), "page_id")
    return rows.select("page_id", "title", "product_id", "n_products", "product_conflict")


@query(FORMS + """SELECT page_id, CASE WHEN f = 0 AND clash THEN 'ambiguous' ELSE state END AS state, CASE WHEN f = 0 AND clash THEN 'product_conflict' ELSE reasons END AS reasons, permille::BIGINT AS confidence,
    (floor(score / 1.4::DOUBLE * 100 + 0.5::DOUBLE))::BIGINT AS reliability, CASE WHEN f = 2 THEN 0 ELSE 12 END::BIGINT AS price_present, CASE WHEN n_sources > 1 THEN 12 ELSE 0 END::BIGINT AS agreement, 3::BIGINT AS consistency, CASE WHEN f = 2 THEN -20 ELSE 0 END::BIGINT AS variant FROM facts
  UNION ALL SELECT page_id, 'unresolved', 'missing_price,unsupported_page_structure,low_confidence', 373, 34286, 0, 0, 3, 0 FROM given""")
def ex_confidence(d: Domain) -> DataFrame:
    """The decision with its reasons and the parts of its score; reliability is shown in thousandths."""
    rows = plan.judged(plan.chosen(plan.priced(plan.merged(plan.candidates(all_pages(d), "page_id", "url", "html"), "page_id")), "page_id"))
    points = lambda n: F.get("breakdown", F.lit(n))["points"]
    parts = {name: points(n).cast("long").alias(name) for n, name in enumerate(("", "price_present", "agreement", "consistency", "variant")) if name}
    return rows.select("page_id", "state", F.array_join("reasons", ",").alias("reasons"), permille("confidence").alias("confidence"), permille(points(0)).alias("reliability"), *parts.values())


@query(FORMS + """SELECT page_id, n_product::BIGINT AS n_product, n_variant::BIGINT AS n_variant, n_price::BIGINT AS n_price FROM own JOIN (VALUES (0, 6, 0, 4), (1, 13, 6, 8), (2, 5, 4, 0), (3, 2, 0, 2), (4, 2, 0, 4), (5, 5, 2, 6), (6, 5, 0, 2), (7, 4, 0, 2)) x(form, n_product, n_variant, n_price) ON f = form
  UNION ALL SELECT page_id, CASE WHEN url IS NULL THEN 1 ELSE 2 END, 0, 0 FROM given""")
def ex_evidence(d: Domain) -> DataFrame:
    """How many pieces of evidence each page's product has."""
    found = plan.candidates(all_pages(d), "page_id", "url", "html")
    selected = plan.chosen(plan.priced(plan.merged(found, "page_id")), "page_id")
    rows = plan.evidence(found, selected, "page_id").groupBy("page_id")
    return rows.agg(*(F.count_if(F.col("part") == part).alias(f"n_{part}") for part in ("product", "variant", "price")))


@query(FORMS + f"""SELECT page_id, t AS title, CASE WHEN f <> 2 THEN p END AS price, currency, CASE WHEN f IN (0, 1, 4) THEN p END AS sale_price, CASE WHEN f IN (0, 1, 4) THEN floor(p * 200 + 0.5::DOUBLE) / 100 END AS original_price,
    CASE WHEN f IN (0, 7) THEN 'P-' || product_id WHEN f = 1 THEN 'V' || product_id END AS sku, CASE WHEN f IN (0, 1, 6) THEN v END AS vendor, url AS canonical_url, CASE f WHEN 5 THEN 'shopify-json' ELSE split_part(sources, ',', 1) END AS source, f <> 4 AS structured,
    f = 2 AS variant_ambiguous, f = 5 AS price_conflict, CASE WHEN f = 0 AND clash THEN 'ambiguous' ELSE state END AS state FROM facts
  UNION ALL SELECT page_id, t, {EMPTY}, NULL, {EMPTY}, {EMPTY}, NULL, NULL, url, 'page-text', false, false, false, 'unresolved' FROM given""")
def ex_main(d: Domain) -> DataFrame:
    rows = plan.products(all_pages(d), "page_id", "url", "html")
    return rows.select(
        "page_id", "title", "price", "currency", "sale_price", "original_price", "sku", "vendor", "canonical_url", "source", "structured", "variant_ambiguous", "price_conflict", "state",
    )


@query(FORMS + """SELECT page_id, true AS is_match, sure AS high_confidence, f IN (1, 6) OR (f = 0 AND NOT clash) AS deterministic_match,
    CASE WHEN sure THEN 990 WHEN f = 0 THEN 840 WHEN f = 2 THEN 712 WHEN f = 4 THEN 620 ELSE 829 END::BIGINT AS score, CASE WHEN sure THEN 'confident' WHEN f = 2 THEN 'unresolved' ELSE 'ambiguous' END AS state,
    CASE WHEN f = 0 AND clash THEN 'product_conflict,low_confidence' ELSE reasons END AS reasons FROM (SELECT *, f IN (1, 3, 5, 7) OR (f = 0 AND NOT clash) AS sure FROM facts)""")
def er_page_match(d: Domain) -> DataFrame:
    """Each product's page against its product."""
    own = d.products.select((F.col("product_id") + OWN).alias("page_id"), _named().alias("own_title"), F.concat(F.lit("P-"), F.col("product_id").cast("string")).alias("own_sku"), F.lit(None).cast("string").alias("own_barcode"), F.col("vendor").alias("own_vendor"))
    rows = plan.products(all_pages(d), "page_id", "url", "html").join(own, "page_id")
    out = plan.assessed(rows, "own_title", "own_sku", "own_barcode", "own_vendor")
    return out.select("page_id", "is_match", "high_confidence", "deterministic_match", permille("match_score").alias("score"), F.col("match_state").alias("state"), F.array_join("match_reasons", ",").alias("reasons"))
