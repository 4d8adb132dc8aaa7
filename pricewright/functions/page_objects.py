"""Product objects in a page's scripts: JSON-LD, application JSON and assigned JSON, at any depth.

Only the walk over JSON trees is Python; what the objects mean is left to expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extraction, pages
from .workers import arrow_rows

MONEY = "struct<text: string, number: double>"
OFFER = f"struct<price: {MONEY}, currency: string, name: string, price_type: string, kind: string>"
VARIANT = (
    f"struct<place: int, id: string, own_id: string, options: array<string>, title: string, price: {MONEY}, compare: {MONEY}, currency: string, "
    "sku: string, barcode: string, available: string, selected: boolean>"
)
TEXTS = ("title", "canonical_url", "product_id", "variant_id", "handle", "sku", "barcode", "mpn", "vendor", "brand", "description", "availability", "currency")
OBJECT = (
    "source string, place int, " + ", ".join(f"{name} string" for name in TEXTS) + f", features array<string>, offered array<{OFFER}>, n_variants int, variants array<{VARIANT}>"
)
#: Names of an object's facts, the first that is there.
NAMES = {
    "title": ("name", "title", "headline"), "canonical_url": ("url", "productUrl", "canonicalUrl"), "product_id": ("productId", "id"),
    "variant_id": ("variantId", "selectedVariantId"), "handle": ("handle",), "sku": ("sku",),
    "barcode": ("gtin13", "gtin12", "gtin14", "gtin", "barcode"), "mpn": ("mpn",), "vendor": ("vendor",), "brand": ("brand", "vendor"),
    "description": ("description", "body_html"), "availability": ("availability",), "currency": ("currency",),
}
LIST_PRICE = re.compile("list|compare|regular|rrp|msrp")
ASSIGNED = re.compile(r"(?:window\.[\w$.]+|(?:var|let|const)\s+\w+)\s*=\s*(?=[{\[])", re.ASCII)


def given(value: dict, *names: str):
    """The first of the named members that is there and not null."""
    return next((value[n] for n in names if value.get(n) is not None), None)


def truthy(value) -> bool:
    """Whether a script would take the value for true: empty lists and objects are."""
    return isinstance(value, (list, dict)) or bool(value)


def shown(value) -> str | None:
    """A text or number as a text; null for all else."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(value)


def money(value) -> dict:
    return {"text": shown(value), "number": float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None}


def objects(value) -> Iterator[dict]:
    """All objects of a JSON tree, each before what it holds; members with numbers for names come first, by number."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            yield value
            numbered = sorted((n for n in value if n.isascii() and n.isdigit() and str(int(n)) == n), key=int)
            value = [value[n] for n in numbered] + [v for n, v in value.items() if n not in numbered]
        if isinstance(value, list):
            todo.extend(reversed(value))


def find_objects(value, fits) -> list[dict]:
    return [o for o in objects(value) if fits(o)]


def is_product(value: dict) -> bool:
    kinds = value.get("@type")
    return any(str(kind).lower() == "product" for kind in (kinds if isinstance(kinds, list) else [kinds]))


def has_variants(value: dict) -> bool:
    return is_product(value) or (isinstance(value.get("variants"), list) and truthy(given(value, "name", "title")))


def is_stated(value: dict) -> bool:
    """An object with a name and a price, offers or variants; one that looks like a variant itself is none."""
    named = truthy(value.get("title")) or truthy(value.get("name"))
    whole = any(truthy(value.get(n)) for n in ("productId", "handle", "variants", "offers"))
    variant = truthy(value.get("id")) and named and truthy(value.get("price")) and not whole
    return not variant and truthy(given(value, "name", "title")) and truthy(given(value, "price", "offers", "variants"))


def _refused(name: str):
    raise ValueError(name)


DECODER = json.JSONDecoder(parse_constant=_refused)


def parsed(text: str):
    """A JSON value; None if the text isn't one."""
    try:
        return DECODER.decode(text)
    except (ValueError, RecursionError):
        return None


def assigned(text: str) -> tuple[bool, object]:
    """Whether a script assigns an object or list, and the first such value if the script ends with it."""
    head = ASSIGNED.search(text)
    if not head or text.rstrip().rstrip(";").rstrip()[-1:] not in ("}", "]"):
        return False, None
    try:
        value, end = DECODER.raw_decode(text, head.end())
    except (ValueError, RecursionError):
        return True, None
    return True, value if text[end:].strip() in ("", ";") else None


def products_of(kind: str, body: str) -> Iterator[tuple[str, dict]]:
    """(source, object) of one script."""
    if kind == "application/ld+json":
        yield from (("json-ld", o) for o in find_objects(parsed(body), is_product))
    if kind in ("application/json", ""):
        yield from (("shopify-json", o) for o in find_objects(parsed(body), has_variants))
    has, value = assigned(body)
    if not has and kind in ("application/json", "text/json", ""):
        value = parsed(body)
    yield from (("embedded-json", o) for o in find_objects(value, is_stated))


def _list(value) -> list:
    return value if isinstance(value, list) else [value] if truthy(value) else []


def offers_of(value: dict) -> Iterator[dict]:
    """Prices of an object in order: each offer's, its specifications', then the object's own."""
    for offer in _list(given(value, "offers", "offer")):
        if not isinstance(offer, dict):
            continue
        currency = given(offer, "priceCurrency") or given(value, "priceCurrency")
        name = shown(offer.get("name")) or ""
        yield {"price": money(given(offer, "price", "lowPrice")), "currency": shown(currency), "name": name}
        for spec in _list(offer.get("priceSpecification")):
            if isinstance(spec, dict):
                kind = (shown(spec.get("priceType")) or "").lower()
                own = given(spec, "priceCurrency")
                of = "original" if LIST_PRICE.search(kind) else None
                yield {"price": money(spec.get("price")), "currency": shown(currency if own is None else own), "name": name, "price_type": kind, "kind": of}
    yield {"price": money(value.get("price")), "currency": shown(given(value, "priceCurrency", "currency")), "name": None}


def variant_of(place: int, value: dict, currency) -> dict:
    own = value.get("options")
    options = own if isinstance(own, list) else [value.get(f"option{n}") for n in (1, 2, 3)]
    return {
        "place": place, "id": shown(given(value, "id", "variantId")), "own_id": shown(value.get("id")), "options": [shown(o) for o in options],
        "title": shown(given(value, "title", "name")), "price": money(value.get("price")), "compare": money(given(value, "compare_at_price", "compareAtPrice")),
        "currency": shown(given(value, "priceCurrency") or currency), "sku": shown(value.get("sku")), "barcode": shown(value.get("barcode")),
        "available": shown(value.get("available")), "selected": truthy(given(value, "selected", "isSelected")),
    }


def facts_of(source: str, place: int, value: dict) -> dict:
    variants = value.get("variants") if isinstance(value.get("variants"), list) else []
    brand = given(value, "brand", "vendor")
    out = {fact: shown(given(value, *names)) for fact, names in NAMES.items()}
    more = value.get("additionalProperty")
    return out | {
        "source": source, "place": place, "brand": shown(brand.get("name")) if isinstance(brand, dict) else shown(brand),
        "features": [shown(p.get("value")) for p in (more if isinstance(more, list) else []) if isinstance(p, dict)],
        "offered": list(offers_of(value)), "n_variants": len(variants),
        "variants": [variant_of(n, v, value.get("currency")) for n, v in enumerate(variants) if isinstance(v, dict)],
    }


#: Sources in the order in which a page's candidates stand.
SOURCES = ("json-ld", "shopify-json", "embedded-json")


def script_products(docs: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """A row for each product object in the scripts of each row of ``docs``: ``key``, page_url and the
    columns of ``OBJECT``; ``place`` orders a page's objects by source and then by script.

    What isn't JSON is skipped; a page without products, and a null one, gives no row.
    """
    decoded = F.transform(extraction.scripts(F.col(content)), lambda s: F.struct(s["type"].alias("type"), pages.decoded(s["body"]).alias("body")))
    named = docs.select(F.col(key), F.col(url).alias("page_url"), F.filter(decoded, lambda s: F.contains(s["body"], F.lit("{"))).alias("scripts"))
    rows = named.filter(F.size("scripts") > 0)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, page_url string, {OBJECT}"
    kinds = {"offered": _arrow(f"array<{OFFER}>"), "variants": _arrow(f"array<{VARIANT}>"), "features": pa.list_(pa.string()), "place": pa.int32(), "n_variants": pa.int32()}
    names = ["source", "place", *TEXTS, "features", "offered", "n_variants", "variants"]

    def found(batches):
        for batch in batches:
            at, out = [], []
            for n, scripts in enumerate(batch.column("scripts").to_pylist()):
                found = [x for script in scripts for x in products_of(script["type"], script["body"])]
                found.sort(key=lambda x: SOURCES.index(x[0]))
                out += [facts_of(source, place, value) for place, (source, value) in enumerate(found)]
                at += [n] * len(found)
            take = pa.array(at, pa.int64())
            columns = [pa.array([row[name] for row in out], kinds.get(name, pa.string())) for name in names]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(take), batch.column("page_url").take(take), *columns], [key, "page_url", *names])

    return arrow_rows(rows, found, schema)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))
