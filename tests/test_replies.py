"""Model replies against a plain reading by json."""

import copy
import json
import math
import random

from pyspark.sql import functions as F

from pricewright.functions import replies

WHOLE = {
    "targetProductFound": True, "isMatch": True, "confidence": 0.9, "matchConfidence": 0.95, "skuMatchConfidence": 0, "titleSimilarity": 0.9, "variantSimilarity": 1, "price": 12.5,
    "currency": "usd", "salePrice": None, "originalPrice": 20, "title": "A {thing}", "description": None, "features": ["x", "y \"}"], "reasoning": "as \\ is", "brand": None, "model": "m",
    "generation": None, "capacity": None, "variant": None, "priceAssociation": "exact",
    "products": [{"title": "A", "brand": None, "model": None, "variant": None, "prices": [{"amount": 12.5, "currency": "usd", "association": "exact"}]}],
}


def plain_object(text):
    """The first object by a count of braces outside quotes."""
    parts = text.split("```")
    inside = parts[1].removeprefix("json").lstrip() if len(parts) > 2 else text
    begin = inside.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(begin, len(inside)) if begin >= 0 else ():
        c = inside[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return inside[begin : i + 1]
    return None


def plain_verdict(text):
    found = plain_object(text)
    if found is None:
        return "no_object"
    try:
        v = json.loads(found, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return "malformed"
    text_or_null = lambda x: x is None or isinstance(x, str)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    kinds = ("exact", "strong", "ambiguous", "unknown")
    price = lambda p: isinstance(p, dict) and number(p.get("amount")) and isinstance(p.get("currency"), str) and p.get("association") in kinds

    def product(p):
        if not isinstance(p, dict) or any(n not in p for n in replies.CANDIDATE) or not all(text_or_null(p[n]) for n in replies.CANDIDATE[:-1]):
            return False
        return isinstance(p["prices"], list) and all(map(price, p["prices"]))

    if any(n not in v for n in replies.REQUIRED) or not all(isinstance(v[n], bool) for n in ("targetProductFound", "isMatch")):
        return "schema"
    if not isinstance(v["currency"], str) or not isinstance(v["reasoning"], str) or not all(text_or_null(v[n]) for n in replies.TEXTS) or not (isinstance(v["priceAssociation"], str) and v["priceAssociation"] in kinds):
        return "schema"
    if not isinstance(v["features"], list) or not all(isinstance(x, str) for x in v["features"]) or not isinstance(v["products"], list) or not all(map(product, v["products"])):
        return "schema"
    if not all(number(v[n]) for n in replies.SCORES) or not all(v[n] is None or number(v[n]) for n in replies.PRICES):
        return "values"
    if any(v[n] is not None and v[n] <= 0 for n in replies.PRICES):
        return "price"
    if not (len(v["currency"]) == 3 and v["currency"].isascii() and v["currency"].isalpha()):
        return "currency"
    return "title" if v["price"] is not None and not v["title"] else "valid"


def mutated(rng):
    v = copy.deepcopy(WHOLE)
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        target = rng.choice([v, v, v, v["products"][0] if v.get("products") and isinstance(v["products"], list) and isinstance(v["products"][0], dict) else v])
        name = rng.choice(list(target) or ["x"])
        if rng.random() < 0.2:
            target.pop(name, None)
        else:
            target[name] = rng.choice([None, "text", "", "EUR", True, 0, -1, 3.5, [], {}, ["a"], [1], [{"amount": 1, "currency": "EUR", "association": "odd"}], [None], "exact"])
    text = json.dumps(v, indent=rng.choice([None, 2]))
    if rng.random() < 0.15:
        cut = rng.randrange(len(text))
        text = text[:cut] + rng.choice(["", "}", '"', "\\", "NaN"]) + text[cut + rng.randint(0, 2) :]
    return rng.choice(["{0}", "So {0} and {{1}}", "```json\n{0}\n``` {{}}", "```{0}```", 'a " b {0}']).format(text)


def test_verdicts_are_those_of_a_plain_reading(spark):
    rng = random.Random(7)
    texts = [mutated(rng) for _ in range(500)] + ["", "no", "}{", "{", '{"a": "}', "```\n```{}", "{}", '{"a": 1, "a": 2}'[:-1] + "}"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, text string").withColumn("reply", F.lit(1)).withColumnRenamed("reply", "other")
    got = {r["id"]: r for r in replies.parsed_replies(rows.withColumn("object", replies.balanced_object(F.col("text"))), "text").collect()}
    assert got.pop(-1)["verdict"] == "no_object"
    assert [got[i]["object"] for i in range(len(texts))] == [plain_object(t) for t in texts]
    twice = len(texts) - 1  # a member twice isn't read at all
    assert [got[i]["verdict"] for i in range(twice)] == [plain_verdict(t) for t in texts[:-1]] and got[twice]["verdict"] == "malformed"
    assert sum(got[i]["verdict"] == "valid" for i in got) > 60


def test_matches_need_support(spark):
    def case(reasons=("low_confidence",), amount=12.5, **changes):
        v = copy.deepcopy(WHOLE) | changes
        v["products"][0]["prices"][0]["amount"] = amount
        return json.dumps(v), list(reasons)

    cases = {
        "consistent": case(), "price_unsupported": case(amount=12.51), "not_found": case(targetProductFound=False), "price_ambiguous": case(priceAssociation="strong"),
        "title": case(titleSimilarity=0.81), "variant": case(variantSimilarity=0.5), "page_conflict": case(reasons=("product_conflict",)),
    }
    rows = [(name, *c) for name, c in cases.items()] + [("consistent", *case(isMatch=False, targetProductFound=False)), ("consistent", case()[0], None), (None, "none", None)]
    df = replies.parsed_replies(spark.createDataFrame(rows, "want string, text string, reasons array<string>"), "text")
    got = df.select("want", replies.consistency(F.col("reply"), F.col("reasons")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got
