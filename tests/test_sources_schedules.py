"""Shop lists, search replies, competitors, ratings, daily times, page markers and anchored windows."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pricewright.functions import schedule, storefront
from pricewright.sources import product_csv, shop_json
from pricewright.streaming import prices


def test_shop_products(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"products": [
        {"id": 7, "title": "Pot", "body_html": "<p>Big <b>pot</b></p>", "vendor": "", "product_type": "Kitchen", "images": [{"src": "u"}], "variants": [{"id": 70, "sku": "S", "price": "9.50", "inventory_item_id": 5}, {"id": 71, "price": "1"}]},
        {"id": 8, "variants": []}, None]}, indent=1))
    (tmp_path / "b.json").write_text("[]")
    got = {r.shop_product_id: r for r in shop_json.shop_products(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["7", "8"]
    assert (got["7"].title, got["7"].description, got["7"].price, got["7"].shop_variant_id, got["7"].vendor, got["7"].image_url) == ("Pot", "Big pot", "9.50", "70", None, "u")
    assert (got["8"].title, got["8"].description, got["8"].price, got["8"].sku) == ("Untitled Product", None, "0.00", None)
    costs = spark.createDataFrame([("5", "4.25"), ("5", "x"), ("6", "1")], "inventory_item_id string, cost string")
    assert {(r.shop_product_id, r.cost_price) for r in shop_json.with_costs(shop_json.shop_products(spark, str(tmp_path)), costs).collect()} == {("7", 4.25), ("8", None)}


def test_search_results(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"query": "pot", "organic_results": [{"title": "A", "link": "a"}, {"position": 5, "title": "B", "link": "b"}]}\n{"query": "none"}\n')
    assert sorted(tuple(r) for r in shop_json.search_results(spark, str(tmp_path)).collect()) == [("pot", 1, "A", "a"), ("pot", 5, "B", "b")]


def test_competitors(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,domain,desc\nA,https://a.com/x/y,first\n,b.co.uk,\nC,-c.com,\nD,,\n')
    got = sorted((r.name, r.domain, r.description, r.faults) for r in product_csv.read_competitors(spark, str(tmp_path)).collect())
    assert got == [("", "b.co.uk", None, ["Missing name"]), ("A", "a.com", "first", []), ("C", "-c.com", None, ["Invalid domain"]), ("D", "", None, ["Missing domain"])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("name\nA\n")
    with pytest.raises(ValueError, match="domain"):
        product_csv.read_competitors(spark, str(tmp_path / "d"))


def test_ratings(spark):
    made = [("₹1,099", "64%", "4.1", "A|B"), ("399 only", "75%", "4", " "), ("", "5%", "3.0", None), (None, None, "2.9", "x" * 300)]
    got = shop_json.rated_products(spark.createDataFrame(made, "actual_price string, discount_percentage string, rating string, category string")).collect()
    assert [(r.price, r.status, r.category) for r in got] == [(1099.0, "optimal", "A|B"), (399.0, "underpriced", "Other"), (None, "overpriced", "Other"), (None, "alert", "x" * 255)]


DAILY = [  # now, hour, minute, zone, due; the third is in the hour that summer time skips, the fourth after it
    ("2024-01-10 05:00", 6, 30, "UTC", "2024-01-10 06:30"), ("2024-01-10 06:30", 6, 30, "UTC", "2024-01-11 06:30"), ("2024-03-10 05:00", 2, 30, "America/New_York", "2024-03-10 06:30"),
    ("2024-03-10 12:00", 9, 0, "America/New_York", "2024-03-10 13:00"), ("2024-12-31 20:00", 1, 0, "Asia/Kolkata", "2025-01-01 19:30"), ("2024-10-26 22:30", 3, 0, "Europe/Paris", "2024-10-27 02:00"), ("2024-01-10 05:00", 1, 1, None, None),
]


def test_next_daily(spark):
    micros = lambda s: None if s is None else int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
    made = spark.createDataFrame([(i, micros(n), h, m, z) for i, (n, h, m, z, _) in enumerate(DAILY)], "i int, n long, h int, m int, z string")
    got = made.select("i", schedule.next_daily(F.col("n"), F.col("h"), F.col("m"), F.col("z")).alias("due")).orderBy("i").collect()
    assert [r.due for r in got] == [micros(due) for *_, due in DAILY]


def test_markers(spark):
    made = [("x Shopify.theme = 1; productData", "shopify", "shopify.theme|state.productData"), ("<i itemprop='price'> myproductData", "custom", "dom.price"), ('{"@type" : "product"}', "custom", "schema.product"),
            ("/wp-content/plugins/woocommerce/a", "woocommerce", "woocommerce|woocommerce.plugin"), ("", "unknown", ""), (None, "unknown", "")]
    rows = spark.createDataFrame([(s,) for s, *_ in made], "s string").select(storefront.markers(F.col("s")).alias("names"))
    got = rows.select(storefront.platform(F.col("names")), F.array_join("names", "|")).collect()
    assert [tuple(r) for r in got] == [tuple(want) for _, *want in made]


def test_anchored_hits(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    for minutes in ([("a", 1, 0), ("a", 2, 10), ("b", 3, 4), (None, 9, 1)], [("a", 4, 14), ("a", 5, 15), ("a", 6, 20), ("b", 7, 30)]):
        made = spark.createDataFrame(minutes, "user_id string, event_id long, m int").select("user_id", "event_id", F.expr("make_timestamp_ntz(2024, 1, 1, 0, m, 0)").alias("ts"))
        made.coalesce(1).write.mode("append").parquet(folder)
        stream = prices.anchored_hits(spark.readStream.schema("user_id string, event_id long, ts timestamp_ntz").parquet(folder), "user_id", 15 * 60_000)
        kept = lambda df, _: seen.extend((r.key, r.event_id, r.hit) for r in df.collect())
        stream.writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [("a", 1, 1), ("a", 2, 2), ("a", 4, 3), ("a", 5, 1), ("a", 6, 2), ("b", 3, 1), ("b", 7, 1)]
