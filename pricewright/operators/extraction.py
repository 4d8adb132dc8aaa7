"""Queries of page extraction.  No given page has product markup, so each product's page is written from its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extraction, reduction
from .catalog import query
from .domain import Domain


def product_pages(d: Domain) -> DataFrame:
    """product_id and html: a page with meta tags, item properties and JSON-LD of one product."""
    price, sku = F.format_string("%.2f", "price"), F.concat(F.lit("P-"), F.col("product_id").cast("string"))
    item = F.to_json(F.struct(
        F.array(F.struct(F.lit("Organization").alias("@type"), F.lit("Shop").alias("name")).alias("o")).alias("publishers"),
        F.array(F.struct(
            F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("title").alias("name"), sku.alias("sku"), F.struct(F.col("vendor").alias("name")).alias("brand"),
            F.array(F.struct(price.alias("price"), F.lit("EUR").alias("priceCurrency"))).alias("offers"),
        )).alias("@graph"),
    ))
    meta = lambda kind, name, value: F.concat(F.lit(f'<meta {kind}="{name}" content="'), value, F.lit('">'))
    page = F.concat(
        F.lit("<html><head>"), meta("property", "OG:title", F.col("title")), meta("name", "og:title", F.lit("later")), meta("property", "product:price:amount", price),
        meta("property", "og:price:currency", F.lit("EUR")), meta("name", "sku", sku), meta("itemprop", "brand", F.col("vendor")),
        F.lit('<script type="application/ld+json"> {broken </script><SCRIPT type="Application/LD+JSON">'), item, F.lit("</SCRIPT></head><body>"),
        F.lit('<h1 itemprop="name">'), F.col("title"), F.lit('</h1><span itemprop="price" content="'), price, F.lit('">cheap</span>'),
        F.lit("<i itemprop='priceCurrency'>EUR</i></body></html>"),
    )
    return d.products.select("product_id", page.alias("html"))


def _priced(c: str) -> Column:
    return F.col(c).cast("double").alias("price")


FACTS = "product_id, trim(title) AS title, 'P-' || product_id::VARCHAR AS sku, price, 'EUR' AS currency"


@query(f"SELECT {FACTS}, vendor, NULL::VARCHAR AS availability FROM products")
def ex_meta(d: Domain) -> DataFrame:
    found = product_pages(d).select("product_id", extraction.meta_facts(F.col("html")).alias("m"))
    return found.select("product_id", "m.title", "m.sku", _priced("m.price"), "m.currency", "m.vendor", "m.availability")


@query("SELECT product_id, trim(title) AS title, NULL::VARCHAR AS sku, price, 'EUR' AS currency FROM products")
def ex_semantic(d: Domain) -> DataFrame:
    found = product_pages(d).select("product_id", extraction.semantic_facts(F.col("html")).alias("s"))
    return found.select("product_id", "s.title", "s.sku", _priced("s.price"), "s.currency")


@query(f"SELECT {FACTS}, vendor, 0 AS place FROM products")
def ex_jsonld(d: Domain) -> DataFrame:
    found = extraction.jsonld_products(product_pages(d), "product_id", "html")
    return found.select("product_id", "title", "sku", _priced("price"), "currency", "vendor", "place")


@query(r"""SELECT page_id, len(bodies) AS n_scripts, sha256(array_to_string(list_transform(bodies, lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), chr(10))) AS body_hash
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script\b([^>]*)>(.*?)</script>', 2) AS bodies FROM pages)""", domain=False)
def ex_scripts(d: Domain) -> DataFrame:
    found = d.table("pages").select("page_id", extraction.scripts(F.col("html")).alias("scripts"))
    return found.select("page_id", F.size("scripts").cast("long").alias("n_scripts"), F.sha2(F.array_join("scripts.body", "\n"), 256).alias("body_hash"))


_CLEAN = "regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g')"


@query(f"""SELECT page_id, sha256(left(array_to_string(list_distinct_in_order, chr(10)), 2000)) AS short_hash FROM (
  SELECT page_id, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS list_distinct_in_order FROM (
  SELECT page_id, list_concat(CASE WHEN len(meta) > 0 THEN [array_to_string(meta[1:30], chr(10))] ELSE [] END, CASE WHEN len(telling) > 0 THEN telling ELSE plain[1:40] END) AS parts FROM (
  SELECT *, list_filter(plain, lambda s: regexp_matches(s, '{reduction.RELEVANT}')) AS telling FROM (
  SELECT page_id, regexp_extract_all(html, '{reduction.META}') AS meta, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '{reduction.STYLE}', ' ', 'g'), '\\r?\\n'),
    lambda s: trim({_CLEAN.format("s")})), lambda s: s <> '') AS plain FROM pages))))""", domain=False)
def fn_reduce_content(d: Domain) -> DataFrame:
    """Each page in 2000 characters; none of the given ones has structured scripts."""
    rows = reduction.with_reduced(d.table("pages"), "html", "short", 2_000)
    return rows.select("page_id", F.sha2("short", 256).alias("short_hash"))
