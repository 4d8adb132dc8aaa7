"""Products of hand-made pages: what is found, which price holds, and why a page is doubted."""

import json

import pytest

from pricewright.functions import page_objects
from pricewright.plans import page_products


def script(value, kind="application/json"):
    return f'<script type="{kind}">{json.dumps(value)}</script>'


def variants(*rows, **more):
    return {"product": {"title": "Desk Clock", "currency": "USD", "variants": list(rows)} | more}


LAMP = {"@type": "Product", "name": "Lamp Kit Nine", "sku": "L-9", "brand": {"name": "Lumo"}, "offers": {"price": "149.99", "priceCurrency": "USD"}}
GRAPH = {"@graph": [{"@type": "BreadcrumbList", "name": "x"}, {"@type": "Product", "name": "Graphed", "offers": {"price": "119.99", "priceCurrency": "EUR"}}]}
LINES = "\n  # Main\n Now $119.99\n Was $149.99\n Shipping $9.99\n Subscribe monthly $99.99\n Pay in 4 installments of $30.00\n Unit price $12.00 / kg\n Related products Widget $19.99\n"
KEYS = "<h1>Keylab K2 Wireless Keyboard</h1>\n<p>SKU: K2-B1</p>\n<p>Sale price $59.99 Regular price $84.99</p>\n<p>Palm Rest $12.99</p>\n<p>Switch Set $24.99</p>"
CAM = "<h1>Actcam HERO12 Black Camera</h1>\n<p>HERO12 Black $369.99</p>\n<p>Join subscribers for $0.00 today</p>\n<p>Recommended mount $49.99</p>"
PAGES = {
    "ld": (None, script(LAMP, "application/ld+json") + "<nav>" + "Menu " * 500 + "</nav>"),
    "graph": (None, script(GRAPH, "application/ld+json")),
    "heading": (None, "# Similar accessory\nSale price $19.99\nOther things"),
    "selected": ("https://a.example/products/clock?variant=7", script(variants({"id": 7, "title": "Red", "price": "119.99", "compare_at_price": "149.99", "sku": "R"}, {"id": 8, "price": "129.99"}, id=123))),
    "unselected": (None, script(variants({"id": 1, "title": "S", "price": 1000}, {"id": 2, "title": "L", "price": 2000}))),
    "flagged": (None, script(variants({"id": 1, "price": 1000}, {"id": 2, "option1": "L", "option2": "Blue", "price": 250000, "isSelected": True}))),
    "kinds": (None, LINES),
    "anchored": ("https://k.example/products/keylab-k2-wireless-keyboard", KEYS),
    "cluster": ("https://g.example/en/shop/cameras/hero12-black/C-121-master.html", CAM),
    "conflict": (None, "<h1>Clash</h1>" + script({"@type": "Product", "name": "Clash", "offers": {"price": "129.99", "priceCurrency": "USD"}}, "application/ld+json") + script({"product": {"title": "Clash", "currency": "USD", "variants": [{"id": 3, "price": "119.99"}]}})),
    "related": (None, "<h1>Main Thing</h1>" + script([{"@type": "Product", "name": "Recommended Part", "offers": {"price": "9.99", "priceCurrency": "CAD"}}, {"@type": "Product", "name": "Main Thing", "offers": {"price": "99.99", "priceCurrency": "CAD"}}], "application/ld+json")),
    "semantic": (None, '<h1 itemprop="name">Semantic</h1><span itemprop="priceCurrency" content="GBP"></span><span itemprop="price" content="44.50"></span><meta itemprop="sku" content="S-1">'),
    "embedded": (None, script({"state": {"product": {"name": "Deep", "price": "79.99", "currency": "AUD"}}})),
    "assigned": (None, '<script>window.__S__ = {"product": {"name": "Assigned }; x", "price": "39.99", "currency": "GBP"}};</script>'),
    "twice": (None, '<script>var a = {"name": "A", "price": 1}; var b = {"name": "B", "price": 2};</script>'),
    "accents": (None, "<h1>Machine à café Élan</h1>\n<p>Machine a cafe Elan 12,50 €</p>\n<p>€12,50</p>"),
    "empty": (None, ""), "null": (None, None), "broken": (None, script("x")[:-3] + "<script type='application/ld+json'>" + "[" * 5000 + "</script>"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(name, url, html, 1) for name, (url, html) in PAGES.items()], "page string, url string, html string, price int")
    return {r["page"]: r for r in page_products.products(df, "page", "url", "html").collect()}


def prices(row):
    return [(p["value"], p["kind"]) for p in row["prices"]]


def test_pages_without_products(found):
    assert not {"empty", "null", "broken", "twice"} & set(found)


def test_structured_pages(found):
    facts = lambda name: tuple(found[name][c] for c in ("title", "price", "currency", "source", "state"))
    assert facts("ld") == ("Lamp Kit Nine", 149.99, "USD", "json-ld", "confident") and found["ld"]["vendor"] == "Lumo"
    assert facts("graph") == ("Graphed", 119.99, "EUR", "json-ld", "confident")
    assert facts("semantic")[:4] == ("Semantic", 44.5, "GBP", "semantic-html")
    assert facts("embedded")[:4] == ("Deep", 79.99, "AUD", "embedded-json")
    assert facts("assigned")[:3] == ("Assigned }; x", 39.99, "GBP")
    assert facts("related")[:2] == ("Main Thing", 99.99) and found["related"]["n_products"] == 2


def test_variants(found):
    row = found["selected"]
    assert (row["price"], row["sale_price"], row["original_price"], row["sku"], row["product_id"], row["variant_id"]) == (119.99, 119.99, 149.99, "R", "123", "7")
    row = found["unselected"]
    assert row["variant_ambiguous"] and row["price"] is None and row["state"] == "unresolved" and "variant_ambiguity" in row["reasons"]
    assert found["flagged"]["price"] == 2500.0 and found["flagged"]["options"] == ["L / Blue"]


def test_prices_in_text(found):
    assert (found["kinds"]["price"], found["kinds"]["original_price"]) == (119.99, 149.99)
    assert [k for _, k in prices(found["kinds"])] == ["sale", "original", "shipping", "subscription", "installment", "unit", "related"]
    assert prices(found["anchored"]) == [(59.99, "sale"), (84.99, "original")] and not found["anchored"]["price_conflict"]
    assert found["cluster"]["price"] == 369.99 and not found["cluster"]["price_conflict"]
    assert found["heading"]["reasons"] == ["unsupported_page_structure", "low_confidence"] and not found["heading"]["structured"]
    assert found["accents"]["title"] == "Machine à café Élan" and found["accents"]["price"] == 12.5


def test_conflicts_go_by_authority(found):
    row = found["conflict"]
    assert (row["price"], row["source"], row["price_conflict"], row["settled"]) == (119.99, "shopify-json", True, True)


def test_trees_are_walked_in_order():
    tree = {"b": [{"n": 1}, {"n": 2, "x": {"n": 3}}], "10": {"n": 5}, "2": {"n": 4}}
    assert [o.get("n") for o in page_objects.objects(tree)] == [None, 4, 5, 1, 2, 3]
    assert page_objects.parsed('{"a": NaN}') is None and page_objects.parsed("[" * 100_000) is None
    assert page_objects.assigned('let q = [{"a": "};"}] ; ') == (True, [{"a": "};"}])
    assert page_objects.assigned('var a = {}; var b = {};') == (True, None) and page_objects.assigned("x = {}") == (False, None)
