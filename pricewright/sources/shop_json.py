"""Shops' own product lists in JSON files: one object a file or a line, with an array ``products``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = """products array<struct<id: string, title: string, body_html: string, vendor: string, product_type: string, tags: string,
  images: array<struct<src: string>>,
  variants: array<struct<id: string, sku: string, barcode: string, price: string, compare_at_price: string, inventory_item_id: string>>>>"""


def shop_products(spark: SparkSession, path: str, currency: str = "USD", whole_files: bool = True) -> DataFrame:
    """Each product with its first variant's price; fields that are missing or empty are null.

    Without a title it is an ``Untitled Product``, without a price ``0.00``.  A file that is no
    such object gives no rows.  ``whole_files=False`` reads an object a line, so files can be split.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    p = lambda name: some(F.col(f"p.{name}"))
    first = lambda name: some(F.get(F.col("p.variants"), F.lit(0)).getField(name))
    return spark.read.schema(PAGE).json(path, multiLine=whole_files).select(F.explode("products").alias("p")).filter("p IS NOT NULL").select(
        p("id").alias("shop_product_id"), first("id").alias("shop_variant_id"), F.coalesce(p("title"), F.lit("Untitled Product")).alias("title"),
        some(F.regexp_replace("p.body_html", "<[^>]*>", "")).alias("description"), first("sku").alias("sku"), first("barcode").alias("barcode"),
        p("vendor").alias("vendor"), p("product_type").alias("category"), p("tags").alias("tags"), F.coalesce(first("price"), F.lit("0.00")).alias("price"),
        first("compare_at_price").alias("compare_at_price"), first("inventory_item_id").alias("inventory_item_id"),
        F.lit(currency).alias("currency"), some(F.get(F.col("p.images"), F.lit(0)).getField("src")).alias("image_url"),
    )


def with_costs(products: DataFrame, costs: DataFrame) -> DataFrame:
    """``products`` with ``cost_price`` from rows of (inventory_item_id, cost); an item's largest cost if it has several."""
    by_item = costs.groupBy("inventory_item_id").agg(F.max(F.col("cost").try_cast("double")).alias("cost_price"))
    return products.join(by_item, "inventory_item_id", "left")


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """(query, position, title, link) of search replies, one object a line with an array ``organic_results``.

    A reply without the array has no rows; a result without a position takes its place in the array.
    """
    reply = "query string, organic_results array<struct<position: int, title: string, link: string>>"
    rows = spark.read.schema(reply).json(path).select("query", F.posexplode("organic_results").alias("place", "r"))
    return rows.filter("r IS NOT NULL").select("query", F.coalesce("r.position", F.col("place") + 1).alias("position"), "r.title", "r.link")


def rupees(c: Column) -> Column:
    """The number that an amount starts with, without currency signs and commas; null if none."""
    return F.regexp_extract(F.trim(F.regexp_replace(c, "[₹,]", "")), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def rated_products(rows: DataFrame) -> DataFrame:
    """``rows`` with ``price``, ``discount`` and ``status`` from actual_price, discount_percentage, rating and category in text.

    A rating below 3 is an alert; else a discount above 70 is underpriced and one below 20 overpriced.
    A missing rating or discount counts as 0; a missing category is ``Other``.
    """
    rating = F.coalesce(F.trim("rating").try_cast("double"), F.lit(0.0))
    discount = F.coalesce(F.trim(F.replace(F.col("discount_percentage"), F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))
    status = F.when(rating < 3, "alert").when(discount > 70, "underpriced").when(discount < 20, "overpriced").otherwise("optimal")
    category = F.coalesce(F.nullif(F.substring(F.trim("category"), 1, 255), F.lit("")), F.lit("Other"))
    return rows.withColumns({"price": rupees(F.col("actual_price")), "discount": discount, "status": status, "category": category})
