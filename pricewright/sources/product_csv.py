"""Product catalogues in CSV files: read, map headers, check rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The headers that stand for each field, in any case.
ALIASES = {
    "title": ("title", "name", "product", "product name", "product_title"),
    "sku": ("sku", "variant sku", "code", "reference"),
    "price": ("price", "selling price", "retail price", "variant price"),
    "cost": ("cost", "cost price", "cost per item", "buy price", "wholesale"),
    "category": ("category", "type", "product type", "product_type"),
    "vendor": ("vendor", "brand", "manufacturer", "supplier"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows as strings, under the six fields' names; fields without a column are null.

    Quoted cells may hold line breaks and doubled quotes; rows of blank cells only are left out.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    first: dict[str, str] = {}
    for name in rows.columns:
        for field, aliases in ALIASES.items():
            if name.strip().lower() in aliases:
                first.setdefault(field, name)
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    kept = rows.filter(F.coalesce(*(F.nullif(F.trim(quoted(c)), F.lit("")) for c in rows.columns)).isNotNull())
    return kept.select(*((F.trim(quoted(first[f])) if f in first else F.lit(None).cast("string")).alias(f) for f in ALIASES))


def amount(c: Column) -> Column:
    """Digits and signs of the cell with the first comma as a dot; null if that is no number."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9.,-]", ""), "^([^,]*),", "$1.").try_cast("double")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` with numbers for price and cost (null unless above 0) and the reason for refusal, or null."""
    price, cost = amount(F.col("price")), amount(F.col("cost"))
    refused = F.when(F.coalesce(F.col("title"), F.lit("")) == "", "missing title").when(
        ~F.coalesce(price > 0, F.lit(False)), F.concat(F.lit('invalid price "'), F.coalesce("price", F.lit("")), F.lit('"'))
    )
    none = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rows.select("title", none("sku"), price.alias("price"), F.when(cost > 0, cost).alias("cost"), none("category"), none("vendor"), refused.alias("refused"))


def read_competitors(spark: SparkSession, path: str) -> DataFrame:
    """(name, domain, description, faults) of a file with columns ``name`` and ``domain``; without faults a row is valid.

    A domain may be given as an address.  A file without the two columns raises ``ValueError``.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if not {"name", "domain"} <= set(rows.columns):
        raise ValueError("the file needs columns 'name' and 'domain'")
    cell = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in rows.columns else F.lit("")
    domain = F.regexp_replace(F.regexp_replace(cell("domain"), "^https?://", ""), "(?s)/.*$", "")
    some = lambda c: F.nullif(c, F.lit(""))
    read = rows.select(cell("name").alias("name"), domain.alias("domain"), F.coalesce(some(cell("description")), some(cell("desc"))).alias("description"))
    plain = F.col("domain").rlike(r"\A[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,}(\.[a-zA-Z]{2,})?\z")
    faults = F.array_compact(F.array(
        F.when(F.col("name") == "", "Missing name"), F.when(F.col("domain") == "", "Missing domain"), F.when((F.col("domain") != "") & ~plain, "Invalid domain")
    ))
    return read.withColumn("faults", faults)


def write_csv(products: DataFrame, path: str) -> None:
    """One file a partition, each with a header; prices have two decimals."""
    shown = products.withColumn("price", F.when(F.col("price") > 0, F.format_number("price", 2)).otherwise(F.lit("Price not set")))
    shown.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")
