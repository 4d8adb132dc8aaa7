"""Domain relations over the driver's tables, in DataFrames and, as text, in the oracle's SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import round2

SQL = """WITH observations AS (
  SELECT l_partkey AS product_id, l_suppkey AS competitor_id,
    floor(l_extendedprice / l_quantity * 100 + 0.5::DOUBLE) / 100 AS price,
    l_shipdate AS recorded_at, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS turn,
    count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS turns
  FROM lineitem WHERE l_quantity > 0),
products AS (
  SELECT p_partkey AS product_id, p_name AS title, p_brand AS vendor, p_type AS category,
    floor(p_retailprice * (1.5::DOUBLE + (p_partkey % 7) * 0.4::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS price,
    p_partkey % 15 AS user_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE floor(p_retailprice * 0.8::DOUBLE * 100 + 0.5::DOUBLE) / 100 END AS cost_price,
    p_size % 7 <> 0 AS is_tracked FROM part),
competitors AS (
  SELECT s_suppkey AS competitor_id, s_name AS name,
    CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 2000 THEN 'inactive' ELSE 'active' END AS status FROM supplier),
links AS (
  SELECT product_id, competitor_id, price, recorded_at AS updated_at,
    CASE l_returnflag WHEN 'A' THEN 'auto-generated' WHEN 'R' THEN 'manual' END AS match_method, l_linestatus = 'O' AS is_active
  FROM observations WHERE turn = turns)
"""


@dataclass
class Domain:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        rows = self.table("lineitem").filter("l_quantity > 0")
        return rows.select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("competitor_id"),
            round2(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("recorded_at"),
            "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
        )

    @property
    def turns(self) -> Window:
        """One listing's observations in their total order."""
        return Window.partitionBy("product_id", "competitor_id").orderBy("recorded_at", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")

    @cached_property
    def links(self) -> DataFrame:
        """The latest observation of each listing, by one aggregate with map-side combining."""
        last = F.max(
            F.struct("recorded_at", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "price", "l_returnflag", "l_linestatus")
        ).alias("last")
        return self.observations.groupBy("product_id", "competitor_id").agg(last).select(
            "product_id", "competitor_id", "last.price", F.col("last.recorded_at").alias("updated_at"),
            F.when(F.col("last.l_returnflag") == "A", "auto-generated").when(F.col("last.l_returnflag") == "R", "manual").alias("match_method"),
            (F.col("last.l_linestatus") == "O").alias("is_active"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("category"),
            round2(F.col("p_retailprice") * (F.lit(1.5) + (F.col("p_partkey") % 7) * F.lit(0.4))).alias("price"),
            (F.col("p_partkey") % 15).alias("user_id"),
            F.when(F.col("p_size") % 5 != 0, round2(F.col("p_retailprice") * 0.8)).alias("cost_price"), (F.col("p_size") % 7 != 0).alias("is_tracked"),
        )

    @cached_property
    def competitors(self) -> DataFrame:
        balance = F.col("s_acctbal")
        status = F.when(balance < 0, "error").when(balance < 2000, "inactive").otherwise("active")
        return self.table("supplier").select(F.col("s_suppkey").alias("competitor_id"), F.col("s_name").alias("name"), status.alias("status"))

    @cached_property
    def real_links(self) -> DataFrame:
        """Links that weren't generated, with competitors that the product's account follows."""
        product_user = F.col("product_id") % 15
        return self.links.filter(~F.col("match_method").eqNullSafe("auto-generated") & ((F.col("competitor_id") + product_user) % 3 != 0))

    @cached_property
    def followed(self) -> DataFrame:
        """Accounts with the competitors that they follow."""
        accounts = self.products.select("user_id").distinct()
        return accounts.join(self.competitors, (F.col("competitor_id") + F.col("user_id")) % 3 != 0).select("user_id", "competitor_id", "status")

    @cached_property
    def owned_links(self) -> DataFrame:
        """Links with their product's account."""
        return self.links.join(self.products.select("product_id", "user_id"), "product_id")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Each product's market: cents are averaged, so each price counts as shown."""
        price = F.col("price")
        cents = F.sum(F.floor(price * 100 + 0.5))
        return self.real_links.filter(price > 0).groupBy("product_id").agg(
            F.count("*").alias("competitor_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
            (F.floor(cents / F.count("*") + 0.5).cast("double") / 100).alias("avg_price"),
        )
