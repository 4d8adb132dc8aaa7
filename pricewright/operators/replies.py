"""Queries of model replies: each product's row is written as a reply, most of them broken in one way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from .catalog import query
from .domain import Domain

#: What a reply of product_id % 24 comes to; 0 to 2 and from 17 on are whole.
VERDICTS = {3: "no_object", 4: "no_object", 5: "malformed", 6: "schema", 7: "schema", 8: "schema", 9: "schema", 10: "schema", 11: "values", 12: "values", 13: "price", 14: "currency", 15: "title", 16: "schema"}


def written_replies(d: Domain) -> DataFrame:
    """product_id, price and reply."""
    key = F.col("product_id") % 24
    price, text = F.format_string("%.2f", "price"), F.to_json(F.struct(F.concat(F.col("title"), F.lit(' {"} \\ ')).alias("t")))
    title = F.expr("substring(t, 6, length(t) - 6)")
    of = lambda n, broken, whole: F.when(key == n, broken).otherwise(whole)
    lit = F.lit
    amount = F.when(key == 20, F.format_string("%.2f", F.col("price") + 1)).otherwise(price)
    offer = F.concat(lit('{"amount": '), of(10, lit('"12"'), amount), lit(', "currency": "usd", "association": "'), F.when(key == 21, "strong").otherwise("exact"), lit('"}'))
    candidate = F.concat(lit('{"title": null, "brand": "b", "model": null, '), of(9, lit(""), lit('"variant": null, ')), lit('"prices": ['), offer, lit("]}"))
    members = (
        F.concat(lit('{"targetProductFound": '), of(18, lit("false"), of(6, lit('"yes"'), lit("true")))), F.concat(lit('"isMatch": '), of(22, lit("false"), lit("true"))), lit('"confidence": 1.5, "matchConfidence": -1'),
        F.concat(lit('"skuMatchConfidence": '), of(11, lit("null"), lit("0"))), F.concat(lit('"titleSimilarity": '), of(23, lit("0.8199"), lit("0.82"))), F.concat(lit('"variantSimilarity": '), of(2, lit("0.99"), lit("1"))),
        F.concat(lit('"currency": "'), of(14, lit("usd1"), lit("usd")), lit('"')), F.concat(lit('"price": '), price), F.concat(lit('"salePrice": '), of(13, lit("0"), of(12, lit('"9"'), lit("null")))), lit('"originalPrice": null'),
        F.concat(lit('"title": '), of(15, lit('""'), title)), F.concat(of(7, lit('"subtitle"'), lit('"description"')), lit(": null")), lit('"brand": null, "model": null, "generation": null, "capacity": null, "variant": "v", "extra": [1]'),
        F.concat(lit('"features": ['), of(8, lit('"a", 1'), lit('"a {", "b"')), lit("]")), lit('"reasoning": "a \\"quoted\\" }"'), F.concat(lit('"priceAssociation": "'), F.when(key == 19, "strong").when(key == 16, "close").otherwise("exact"), lit('"')),
        F.concat(lit('"products": ['), candidate, lit("]}")),
    )
    whole = F.array_join(F.array(*members), ", ")
    reply = (
        F.when(key == 3, lit("I found nothing.")).when(key == 4, F.expr("substring(w, 1, length(w) - 1)")).when(key == 5, F.replace(F.col("w"), lit('"price": '), lit('"price": +')))
        .when(key % 2 == 0, F.concat(lit("Thinking. ```json\n"), F.col("w"), lit("\n``` {}"))).otherwise(F.concat(lit('It is "so: '), lit('" '), F.col("w"), lit(" and } {more}")))
    )
    rows = d.products.select("product_id", "title", "price").withColumn("t", text).withColumn("w", whole)
    return rows.select("product_id", "price", reply.alias("reply"))


CASES = " ".join(f"WHEN {n} THEN '{v}'" for n, v in VERDICTS.items())
VERDICT = f"SELECT *, product_id % 24 AS k, CASE product_id % 24 {CASES} ELSE 'valid' END AS verdict FROM products"


@query(f"SELECT product_id, k NOT IN (3, 4) AS closed FROM ({VERDICT})")
def fn_balanced_json(d: Domain) -> DataFrame:
    return written_replies(d).select("product_id", replies.balanced_object(F.col("reply")).isNotNull().alias("closed"))


@query(f"""SELECT product_id, verdict, CASE WHEN verdict = 'valid' THEN price END AS price, CASE WHEN verdict = 'valid' THEN 'USD' END AS currency, CASE WHEN verdict = 'valid' THEN title || ' {{"}} \\ ' END AS title,
    CASE WHEN verdict = 'valid' THEN 1::DOUBLE END AS confidence, CASE WHEN verdict = 'valid' THEN 0::DOUBLE END AS match_confidence, CASE WHEN verdict = 'valid' THEN 2 END::INT AS n_features, CASE WHEN verdict = 'valid' THEN 1 END::INT AS n_products FROM ({VERDICT})""")
def fn_parse_extraction(d: Domain) -> DataFrame:
    rows = replies.parsed_replies(written_replies(d).withColumnRenamed("reply", "answer").drop("price"), "answer")
    valid = F.col("reply").isNotNull()
    return rows.select(
        "product_id", "verdict", "reply.price", "reply.currency", "reply.title", F.col("reply.confidence").alias("confidence"), F.col("reply.matchConfidence").alias("match_confidence"),
        F.when(valid, F.size("reply.features")).alias("n_features"), F.when(valid, F.size("reply.products")).alias("n_products"),
    )


@query(f"""SELECT product_id, CASE WHEN verdict <> 'valid' THEN NULL WHEN k = 22 THEN 'consistent' WHEN k = 18 THEN 'not_found' WHEN k = 19 THEN 'price_ambiguous' WHEN k IN (20, 21) THEN 'price_unsupported'
    WHEN k = 23 THEN 'title' WHEN k = 2 THEN 'variant' WHEN product_id % 5 = 0 THEN 'page_conflict' ELSE 'consistent' END AS outcome FROM ({VERDICT})""")
def fn_ai_consistency(d: Domain) -> DataFrame:
    """Every fifth product's page has a price conflict, the others lack confidence only."""
    rows = replies.parsed_replies(written_replies(d).withColumnRenamed("reply", "answer"), "answer")
    reasons: Column = F.array(F.when(F.col("product_id") % 5 == 0, "price_conflict").otherwise("low_confidence"))
    return rows.select("product_id", replies.consistency(F.col("reply"), reasons).alias("outcome"))
