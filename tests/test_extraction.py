"""What pages state in their markup, by hand-made pages."""

from pyspark.sql import functions as F

from pricewright.functions import extraction

PAGE = """<meta name='og:title' content=''><META property="og:Title" content="Blue &amp; red"><meta content="9.50" property='product:price:amount'>
<script>var a = 1;</script><script async type='application/LD+json'>
[{"@type": "Offer", "x": {"@type": "product", "title": "Deep", "brand": "B", "offers": {"price": 3, "priceCurrency": "USD"}}}, {"@type": "Product", "name": "", "sku": 7, "offers": []}]
</script><b itemprop="name">A <i>b</i></b><meta itemprop="price" content="4.20">"""


def facts(spark, frame_of):
    rows = [(1, PAGE), (2, ""), (3, None), (4, "<script type='application/ld+json'>" + "[" * 3000 + "</script>")]
    return frame_of(spark.createDataFrame(rows, "id long, html string"))


def test_markup(spark):
    got = facts(spark, lambda d: d.select("id", extraction.meta_facts(F.col("html")).alias("m"), extraction.semantic_facts(F.col("html")).alias("s"), extraction.scripts(F.col("html")).alias("t")))
    got = {r["id"]: r for r in got.collect()}
    assert (got[1]["m"]["title"], got[1]["m"]["price"], got[1]["m"]["sku"]) == ("Blue & red", "9.50", None)
    assert (got[1]["s"]["title"], got[1]["s"]["price"], got[1]["s"]["currency"]) == ("A", "4.20", None)
    assert [(s["type"], s["body"][:10]) for s in got[1]["t"]] == [("", "var a = 1;"), ("application/ld+json", '[{"@type":')]
    assert got[2]["t"] == [] and got[3]["t"] is None and got[3]["m"]["title"] is None and got[2]["s"]["title"] is None


def test_jsonld(spark):
    got = facts(spark, lambda d: extraction.jsonld_products(d, "id", "html")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Deep", None, "B", "3", "USD", None), (1, 1, None, "7", None, None, None, None)]
