"""Queries of guards: public addresses, sanitized trees, compared texts and filters that may be left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, matching, structured
from .catalog import query
from .domain import Domain

_N = "(event_id * 2654435761 + 12345) % 4294967296"
_INSIDE = " OR ".join(f"n BETWEEN {sum(int(p) << s for p, s in zip(first.split('.'), (24, 16, 8, 0)))} AND {sum(int(p) << s for p, s in zip(first.split('.'), (24, 16, 8, 0))) + (1 << (32 - bits)) - 1}" for first, bits in addresses.PRIVATE)


@query(f"SELECT event_id, CASE event_id % 5 WHEN 3 THEN event_id % 16 >= 2 WHEN 4 THEN false ELSE NOT ({_INSIDE}) END AS is_public FROM (SELECT event_id, {_N} AS n FROM events)", domain=False)
def fn_public_ip(d: Domain) -> DataFrame:
    """Each event's number as an address: dotted, mapped in two spellings, of version 6, and none."""
    key = F.col("event_id")
    n = F.pmod(key * 2654435761 + 12345, F.lit(4294967296))
    part = lambda shift: F.pmod(F.floor(n / (1 << shift)), F.lit(256)).cast("string")
    dotted = F.concat_ws(".", *(part(s) for s in (24, 16, 8, 0)))
    half = lambda c: F.hex(c.cast("long"))
    heads = F.array(*map(F.lit, ("fc00::", "FE80::"))), F.lit("[2600::")
    six = F.concat(F.coalesce(F.get(heads[0], (key % 16).cast("int")), heads[1]), half(n % 65536), F.when(key % 16 >= 2, "]").otherwise(""))
    text = (
        F.when(key % 5 == 0, dotted).when(key % 5 == 1, F.concat(F.lit("::ffff:"), dotted))
        .when(key % 5 == 2, F.concat(F.lit("0:0:0:0:0:FFFF:"), half(F.floor(n / 65536)), F.lit(":"), half(n % 65536))).when(key % 5 == 3, six).otherwise(F.concat(dotted, F.lit(".1")))
    )
    return addresses.with_public(d.table("events").select("event_id", text.alias("address")), "address", "is_public").drop("address")


@query("""SELECT event_id, '{"Password":"[REDACTED]","note":"call [REDACTED_EMAIL]","items":[' || array_to_string(list_transform(range(least(100, 95 + event_id % 10)), lambda i: i::VARCHAR), ',') ||
  '],"a":{"b":{"c":{"d":{"e":' || CASE WHEN event_id % 2 = 0 THEN '{"f":{"g":"[TRUNCATED]"}}' ELSE '[]' END || '}}}}}' AS clean FROM events""", domain=False)
def fn_sanitize_struct(d: Domain) -> DataFrame:
    """Trees with a secret, an address of mail, a list around the limit and a member below the deepest level."""
    key = F.col("event_id")
    items = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 94 + key % 10), lambda i: i.cast("string")), ",")
    deepest = F.when(key % 2 == 0, '{"f":{"g":1}}').otherwise("[]")
    tree = F.concat(F.lit('{"Password": "x", "note": "call a.b@c.example", "items": ['), items, F.lit('], "a": {"b": {"c": {"d": {"e": '), deepest, F.lit("}}}}}"))
    return structured.sanitized_json(d.table("events").select("event_id", tree.alias("clean")), "clean")


@query("SELECT product_id, product_id % 3 <> 2 AS same FROM products")
def fn_norm_text_eval(d: Domain) -> DataFrame:
    """A title against itself in full-width and ligature forms, with other signs, and against another."""
    key, title = F.col("product_id"), F.col("title")
    wide = F.translate(F.upper(title), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + n) for n in range(26)))
    other = F.when(key % 3 == 0, F.concat(F.lit("  "), wide, F.lit("!"))).when(key % 3 == 1, F.regexp_replace(F.replace(title, F.lit("fi"), F.lit("ﬁ")), " ", " - ")).otherwise(F.concat(title, F.lit("1")))
    return d.products.select("product_id", (matching.comparable(title) == matching.comparable(other)).alias("same"))


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """``rows`` whose columns equal what is given; None asks for nothing."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return rows.filter(reduce(Column.__and__, tests)) if tests else rows


@query("""SELECT * FROM (VALUES ('none', NULL, NULL), ('vendor', 'Brand#2', NULL), ('user', NULL, 3), ('both', 'Brand#13', 4)) x(asked, v, u), LATERAL (SELECT count(*) AS n, min(price) AS lowest FROM products WHERE (v IS NULL OR vendor = v) AND (u IS NULL OR user_id = u)) y""".replace("SELECT * FROM (VALUES", "SELECT asked, n, lowest FROM (VALUES"))
def flt_optional(d: Domain) -> DataFrame:
    """Products by filters given and left out."""
    asked = {"none": {}, "vendor": {"vendor": "Brand#2"}, "user": {"user_id": 3}, "both": {"vendor": "Brand#13", "user_id": 4}}
    counted = [
        optional(d.products, **({"vendor": None, "user_id": None} | given)).agg(F.count("*").alias("n"), F.min("price").alias("lowest")).select(F.lit(name).alias("asked"), "n", "lowest")
        for name, given in asked.items()
    ]
    return reduce(DataFrame.unionByName, counted)
