"""Product facts that a page states in its own markup: scripts, meta tags, item properties and JSON-LD."""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages

SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
LD_JSON = "application/ld+json"
#: Names of each fact's meta tags, the first that is there.
META_NAMES = {
    "title": ("og:title", "twitter:title"), "sku": ("product:retailer_item_id", "sku"), "barcode": ("gtin13", "gtin"), "vendor": ("product:brand", "brand"),
    "price": ("product:price:amount", "og:price:amount", "price"), "currency": ("product:price:currency", "og:price:currency"),
    "description": ("og:description", "description"), "availability": ("product:availability", "availability"),
}
PRODUCT_FIELDS = "title string, sku string, vendor string, price string, currency string, availability string"


def scripts(content: Column) -> Column:
    """The page's scripts in order: type in lower case, empty if none is given, and trimmed body."""
    whole = F.regexp_extract_all(content, F.lit(SCRIPT), F.lit(0))
    kind = lambda s: F.lower(F.regexp_extract(F.regexp_extract(s, SCRIPT, 1), r"""(?i)type\s*=\s*["']([^"']+)["']""", 1))
    return F.transform(whole, lambda s: F.struct(kind(s).alias("type"), F.regexp_replace(F.regexp_extract(s, SCRIPT, 2), r"^\s+|\s+$", "").alias("body")))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag; null if it is not there or empty."""
    value = F.regexp_extract(tag, rf"""(?is)(?<![\w:-]){name}\s*=\s*(["'])(.*?)\1""", 2)
    return F.when(value != "", value)


def meta_tags(content: Column) -> Column:
    """Name in lower case and content of each meta tag in order."""
    tags = F.regexp_extract_all(content, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    name = lambda t: F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"))).alias("name")
    return F.transform(tags, lambda t: F.struct(name(t), attribute(t, "content").alias("value")))


def meta_fact(tags: Column, fact: str) -> Column:
    """A fact in ``META_NAMES`` by ``meta_tags``: of the tags of one name the first with a content."""
    value = lambda name: F.get(F.filter(tags, lambda m: (m["name"] == name) & m["value"].isNotNull()), F.lit(0))["value"]
    return pages.clean_text(F.coalesce(*(value(n) for n in META_NAMES[fact])))


def meta_facts(content: Column) -> Column:
    """A struct of the facts in ``META_NAMES``."""
    tags = meta_tags(content)
    return F.struct(*(meta_fact(tags, fact).alias(fact) for fact in META_NAMES))


def item_property(content: Column, name: str) -> Column:
    """The first element of an itemprop: its content attribute, else its text; null if neither is there."""
    tag = rf"""(?i)itemprop=["']{name}["'][^>]*"""
    given, shown = F.regexp_extract(content, tag + r"""content=["']([^"']+)""", 1), F.regexp_extract(content, tag + ">([^<]+)", 1)
    return pages.clean_text(F.coalesce(F.when(given != "", given), F.when(shown != "", shown)))


#: Item properties of facts.
ITEM_NAMES = {"title": "name", "sku": "sku", "price": "price", "currency": "priceCurrency"}


def semantic_facts(content: Column) -> Column:
    """A struct of title, sku, price and currency by item properties."""
    return F.struct(*(item_property(content, n).alias(fact) for fact, n in ITEM_NAMES.items()))


def jsonld_products(docs: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each product object of a page's JSON-LD, at any depth: ``key``, ``place`` from 0 and its facts.

    An offer is the first of several, a brand an object's name or a text.  What isn't JSON is
    skipped, and a page without products gives no row.
    """
    bodies = F.transform(F.filter(scripts(F.col(content)), lambda s: s["type"] == LD_JSON), lambda s: s["body"])
    rows = docs.select(key, bodies.alias("bodies")).filter(F.size("bodies") > 0)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, place int, {PRODUCT_FIELDS}"

    def products_of(body):
        try:
            todo = [json.loads(html.unescape(body))]
        except (ValueError, RecursionError):
            return
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                kinds = value.get("@type")
                if any(str(kind).lower() == "product" for kind in (kinds if isinstance(kinds, list) else [kinds])):
                    yield value
                value = list(value.values())
            if isinstance(value, list):
                todo.extend(reversed(value))

    def text_of(value):
        if isinstance(value, dict):
            value = value.get("name")
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            return None
        return " ".join(str(value).split()) or None

    def facts(product):
        offer = product.get("offers")
        offer = next((o for o in offer if isinstance(o, dict)), {}) if isinstance(offer, list) else offer if isinstance(offer, dict) else {}
        first = lambda *values: next((t for t in map(text_of, values) if t is not None), None)
        return (
            first(product.get("name"), product.get("title")), first(product.get("sku")), first(product.get("brand"), product.get("vendor")),
            first(offer.get("price"), offer.get("lowPrice"), product.get("price")), first(offer.get("priceCurrency")), first(offer.get("availability")),
        )

    names = [key, "place", *(field.split()[0] for field in PRODUCT_FIELDS.split(", "))]

    def found(batches):
        for batch in batches:
            at, places, columns = [], [], [[] for _ in names[2:]]
            for n, scripts_of in enumerate(batch.column("bodies").to_pylist()):
                for place, product in enumerate(p for body in scripts_of for p in products_of(body)):
                    at.append(n)
                    places.append(place)
                    for column, value in zip(columns, facts(product), strict=True):
                        column.append(value)
            arrays = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), *(pa.array(c, pa.string()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(found, schema)
