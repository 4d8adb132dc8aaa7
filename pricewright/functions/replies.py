"""Replies of a language model: the object in their prose, its schema, values, and consistency with the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Members that a reply must have, by kind, and associations of prices.
SCORES = ("confidence", "matchConfidence", "skuMatchConfidence", "titleSimilarity", "variantSimilarity")
PRICES = ("price", "salePrice", "originalPrice")
TEXTS = ("title", "description", "brand", "model", "generation", "capacity", "variant")
REQUIRED = ("targetProductFound", "isMatch", *SCORES, "currency", *PRICES, *TEXTS, "features", "reasoning", "priceAssociation", "products")
CANDIDATE = ("title", "brand", "model", "variant", "prices")
ASSOCIATIONS = ("exact", "strong", "ambiguous", "unknown")
CONFLICTS = ("product_conflict", "variant_ambiguity", "price_conflict")
LEAST_SIMILAR = 0.82

#: A backslash with what it escapes, a quote, a brace, or a run of anything else.
PIECES = r'(?s)\\.|["{}]|[^\\"{}]+'
FENCED = r"(?s)```(?:json)?\s*(.*?)```"


def balanced_object(text: Column) -> Column:
    """The first JSON object of a text, by braces outside quotes; of a text with a fenced block, the first
    of that block.  Null if none is closed."""
    inside = F.when(text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)).otherwise(text)
    start = F.instr(inside, F.lit("{"))
    body = F.when(start > 0, F.substring(inside, start, F.length(inside)))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        quoted = F.when(piece == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(~s["quoted"] & (piece == "{"), 1).when(~s["quoted"] & (piece == "}"), -1).otherwise(0)
        size = s["size"] + F.length(piece)
        end = F.when((depth == 0) & ~s["quoted"] & (piece == "}"), size).otherwise(0)
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), size.alias("size"), end.alias("end")))

    end = F.aggregate(F.regexp_extract_all(body, F.lit(PIECES), F.lit(0)), state, step)["end"]
    return F.when(end > 0, F.substring(body, F.lit(1), end))


def member(v: Column, name: str) -> Column:
    """A member of a JSON object as JSON; null if it is missing, and not null if it is JSON's null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """string, number, boolean, array, object or null; null for a missing value."""
    name = F.schema_of_variant(v)
    out = F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
    return out.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.isNotNull(), "number")


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(kind(v).isin(*kinds), F.lit(False))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _associated(v: Column) -> Column:
    return _is(v, "string") & F.coalesce(F.try_variant_get(v, "$", "string").isin(*ASSOCIATIONS), F.lit(False))


def _whole_price(p: Column) -> Column:
    return _is(p, "object") & _is(member(p, "amount"), "number") & _is(member(p, "currency"), "string") & _associated(member(p, "association"))


def _whole_candidate(c: Column) -> Column:
    texts = _is(member(c, CANDIDATE[0]), "string", "null")
    for name in CANDIDATE[1:-1]:
        texts &= _is(member(c, name), "string", "null")
    prices = member(c, "prices")
    return _is(c, "object") & texts & _is(prices, "array") & F.coalesce(F.forall(_elements(prices), _whole_price), F.lit(False))


# Whether all members are there and of their kinds.
def _schema(v: Column) -> Column:
    there = F.lit(True)
    for name in REQUIRED:
        there &= member(v, name).isNotNull()
    for name in ("targetProductFound", "isMatch"):
        there &= _is(member(v, name), "boolean")
    for name in ("currency", "reasoning"):
        there &= _is(member(v, name), "string")
    for name in TEXTS:
        there &= _is(member(v, name), "string", "null")
    there &= _associated(member(v, "priceAssociation"))
    for name, whole in (("features", lambda e: _is(e, "string")), ("products", _whole_candidate)):
        there &= _is(member(v, name), "array") & F.coalesce(F.forall(_elements(member(v, name)), whole), F.lit(False))
    return there


def _values(v: Column) -> Column:
    fits = F.lit(True)
    for name in SCORES:
        fits &= _is(member(v, name), "number")
    for name in PRICES:
        fits &= _is(member(v, name), "number", "null")
    return fits


PRICE = "struct<amount: double, currency: string, association: string>"
PRODUCT = f"struct<title: string, brand: string, model: string, variant: string, prices: array<{PRICE}>>"


def parsed_replies(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with each reply's verdict and facts.

    ``verdict`` is no_object, malformed, schema, values, price, currency, title or valid, the first
    that fits; the facts (``reply``, a struct) are null unless it is valid.  A null or empty reply
    has no object.  An object with a member twice is malformed.
    """
    rows = rows.withColumn("_object", balanced_object(F.col(text)))
    rows = rows.withColumn("_v", F.try_parse_json("_object"))
    v = F.col("_v")
    rows = rows.withColumns({"_schema": _schema(v), "_values": _values(v)})
    number = lambda name: F.try_variant_get(v, f"$.{name}", "double")
    string = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    score = lambda name: F.least(F.lit(1.0), F.greatest(F.lit(0.0), number(name)))
    products = F.transform(F.try_variant_get(v, "$.products", f"array<{PRODUCT}>"), lambda p: p.withField("prices", F.transform(p["prices"], lambda q: q.withField("currency", F.upper(q["currency"])))))
    facts = {
        "found": F.try_variant_get(v, "$.targetProductFound", "boolean"), "is_match": F.try_variant_get(v, "$.isMatch", "boolean"), **{name: score(name) for name in SCORES}, "currency": F.upper(string("currency")),
        **{name: number(name) for name in PRICES}, **{name: F.nullif(string(name), F.lit("")) if name in ("title", "description") else string(name) for name in TEXTS},
        "features": F.try_variant_get(v, "$.features", "array<string>"), "association": string("priceAssociation"), "products": products,
    }
    rows = rows.withColumn("_reply", F.struct(*(c.alias(name) for name, c in facts.items())))
    r = F.col("_reply")
    low = F.lit(False)
    for name in PRICES:
        low |= F.coalesce(r[name] <= 0, F.lit(False))
    verdict = (
        F.when(F.col("_object").isNull(), "no_object").when(v.isNull(), "malformed").when(~F.col("_schema"), "schema").when(~F.col("_values"), "values").when(low, "price")
        .when(~r["currency"].rlike("^[A-Z]{3}$"), "currency").when(r["price"].isNotNull() & r["title"].isNull(), "title").otherwise("valid")
    )
    return rows.withColumn("verdict", verdict).withColumn("reply", F.when(F.col("verdict") == "valid", r)).drop("_object", "_v", "_schema", "_values", "_reply")


def consistency(reply: Column, reasons: Column) -> Column:
    """Whether a valid reply's match may stand beside the page's own reasons against it: what it fails by,
    the first that fits; ``consistent`` for all else, also for a reply that claims no match."""
    r = reply
    exact = F.exists(r["products"], lambda p: F.exists(p["prices"], lambda q: (q["association"] == "exact") & (q["currency"] == r["currency"]) & (F.abs(q["amount"] - r["price"]) < 0.005)))
    against = F.coalesce(F.arrays_overlap(reasons, F.array(*map(F.lit, CONFLICTS))), F.lit(False))
    return (
        F.when(r.isNull(), None).when(~r["is_match"], "consistent").when(~r["found"], "not_found").when(r["association"] != "exact", "price_ambiguous")
        .when(r["price"].isNotNull() & ~F.coalesce(exact, F.lit(False)), "price_unsupported").when(r["titleSimilarity"] < LEAST_SIMILAR, "title").when(r["variantSimilarity"] != 1, "variant")
        .when(against, "page_conflict").otherwise("consistent")
    )
