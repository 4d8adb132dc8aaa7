"""Write rules, CSV sources, matching functions and streams on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pricewright.functions import matching, pages
from pricewright.functions import text as texts
from pricewright.plans import writes
from pricewright.sources import product_csv
from pricewright.streaming import prices


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a", 1.0, 5.0), (2, "b", 2.0, None), (None, "n", 0.0, 0.0)], "id long, title string, price double, cost double")
    new = spark.createDataFrame([(1, "x", None, None), (3, "c", 3.0, 1.0)], stored.schema)
    got = rows(writes.upsert(stored, new, ["id"], keep_if_null=["cost"], never=["title"]))
    assert got == sorted([(1, "a", None, 5.0), (2, "b", 2.0, None), (3, "c", 3.0, 1.0), (None, "n", 0.0, 0.0)], key=repr)
    assert rows(writes.upsert(stored, new.limit(0), ["id"])) == rows(stored)


def test_update_and_delete(spark):
    stored = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    assert rows(writes.update(stored, F.col("s") == "a", s=F.lit("b"))) == [(1, "b"), (2, None)]
    assert rows(writes.delete(stored, F.col("s") == "a")) == [(2, None)]
    with pytest.raises(ValueError):
        writes.update(stored, F.lit(True), absent=F.lit(1))
    moves = spark.createDataFrame([(1, 9)], "old_id long, new_id long")
    assert rows(writes.repointed(stored, moves, "id")) == [(2, None), (9, "a")]


@pytest.mark.parametrize(
    ("shown", "want"),
    [("$1,234.50", 1234.5), ("1.234,50 €", 1234.5), ("12,50", 12.5), ("1,234", 1234.0), ("1.234.5", 1234.5), ("0", None), ("free", None), (None, None), ("1,234.5.6", None), ("1.234,5,6", None)],
)
def test_parsed_price(spark, shown, want):
    df = spark.createDataFrame([(shown,)], "s string")
    assert df.select(matching.parsed_price(F.col("s"))).first()[0] == want


def test_csv(spark, tmp_path):
    file = tmp_path / "c.csv"
    file.write_text('Product Name,Code,Selling Price,Cost\n"Big ""A"", two\nlines",s1,"$1,50",x\n,s2,3,\nb,,none,2\n,,,\n')
    got = rows(product_csv.checked(product_csv.read_csv(spark, str(file))).select("title", "sku", "price", "cost", "refused"))
    assert got == sorted(
        [('Big "A", two\nlines', "s1", 1.5, None, None), (None, "s2", 3.0, None, "missing title"), ("b", None, None, 2.0, 'invalid price "none"')], key=repr
    )


def test_price_change_stream(spark, tmp_path):
    schema = "product_id long, competitor_id long, recorded_at timestamp_ntz, price double"
    folder, seen = str(tmp_path / "in"), []
    for values in ([(1, 1, 1, 10.0), (1, 1, 2, 9.0), (2, 1, 1, 5.0)], [(1, 1, 3, 9.0), (1, 1, 4, None), (2, 1, 2, 6.0)]):
        made = spark.createDataFrame(values, "product_id long, competitor_id long, day int, price double")
        made = made.withColumn("recorded_at", F.expr("make_timestamp_ntz(2024, 1, day, 0, 0, 0)")).select("product_id", "competitor_id", "recorded_at", "price")
        made.coalesce(1).write.mode("append").parquet(folder)
        stream = prices.alerts(prices.price_changes(spark.readStream.schema(schema).parquet(folder)))
        kept = lambda df, _: seen.extend((r.product_id, r.previous_price, r.new_price, r.severity) for r in df.collect())
        stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [(1, 10.0, 9.0, "high"), (2, 5.0, 6.0, "high")]


URLS = [
    ("https://shop.x.com:8443/a/?q=1", "https://shop.x.com:8443/a?q=1", "https://shop.x.com:8443/a", "shop.x.com"), ("HTTPS://www.X.com", "https://x.com/", "https://www.x.com", "x.com"),
    ("https://x.com/a?b=2&REF=3&a=1&utm_x=9#f", "https://x.com/a?a=1&b=2", "https://x.com/a", "x.com"), ("ftp://u:p@x.com", None, None, None), ("http://x.com:80//", "http://x.com/", "http://x.com", "x.com"), (None, None, None, None),
]


@pytest.mark.parametrize(("url", "listing", "base", "domain"), URLS)
def test_addresses(spark, url, listing, base, domain):
    c = F.col("u")
    got = spark.createDataFrame([(url,)], "u string").select(texts.listing_url(c), matching.site_base(c), texts.shop_domain(c)).first()
    assert tuple(got) == (listing, base, domain)


def test_bare_domains(spark):
    got = spark.createDataFrame([(" WWW.Shop.com. ",), ("shop.com/a",), ("",)], "u string").select(texts.shop_domain(F.col("u"))).collect()
    assert [r[0] for r in got] == ["shop.com", "shop.com", None]


def test_white_space_at_the_ends(spark):
    row = spark.createDataFrame([("\t a  b \n",)], "s string").select(texts.normal_name(F.col("s")), texts.normal_sku(F.col("s")), texts.content_hash(F.col("s"))).first()
    assert row[0] == "a b" and row[1] == "A  B" and row[2] == hashlib.sha256(b"a b").hexdigest()


KINDS = [
    ("Standard shipping $5", "shipping"), ("$0.00 today, then membership", "subscription"), ("or 4 payments of $9", "installment"), ("was $20 | now $10", "original"),
    ("special price", "sale"), ("$12 /kg", "unit"), ("set of 3", "bundle"), ("you save $3", "discount"), ("only $9", "current"), (" | related items", "related"),
]


def test_price_kinds(spark):
    got = spark.createDataFrame(list(enumerate(k for k, _ in KINDS)), "n int, s string").orderBy("n").select(pages.price_kind(F.col("s"))).collect()
    assert [r[0] for r in got] == [k for _, k in KINDS]


def test_page_classes(spark):
    one = '<script type="application/ld+json">{"@type": "Product"}</script>'
    rows = [
        (one, "https://a.com/x", "confirmed_product"), (one, "https://a.com/search?q=1", "non_product"), (one * 2, "https://a.com/x", "non_product"), ("<h1>Some thing</h1> add to cart", None, "probable_product"),
        ("<h1>Some thing</h1>", None, "non_product"), ("$12.50", "https://a.com/products/1", "probable_product"), ("text", "not an address", "non_product"),
    ]
    got = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(rows)], "n int, html string, url string").orderBy("n").select(pages.page_class(F.col("html"), F.col("url"))).collect()
    assert [r[0] for r in got] == [c for _, _, c in rows]


def test_streams_once_and_in_windows(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "event_id long, user_id long, ts timestamp_ntz"
    made = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 5), (3, 2, 40)], "event_id long, user_id long, m int")
    made.select("event_id", "user_id", F.expr("make_timestamp_ntz(2024, 1, 1, 0, m, 0)").alias("ts")).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["event_id"] for r in run(prices.events_once(stream()), "once", "append")) == [1, 2, 3]
    assert sorted((r["user_id"], r["hits"]) for r in run(prices.hits_in_windows(stream()), "hits", "complete")) == [(1, 3), (2, 1)]
