"""A page's product: candidates from its markup and text, merged, priced, selected and judged.

Each step is a relation.  ``candidates`` has a row for each product that some part of a page
states; ``merged`` one for each product of a page, by normal name; ``selected`` one for each page,
with the price by authority of sources, a state and reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extraction, matching, page_objects, pages

# How much a source counts, prices that aren't the product's own, points and limits.
AUTHORITY = {"shopify-json": 5, "json-ld": 4, "embedded-json": 4, "semantic-html": 3, "product-meta": 2, "page-text": 1}
EXCLUDED = ("shipping", "subscription", "installment", "unit", "bundle", "related", "discount")
CONTEXTS = {"json-ld": "Schema.org Product JSON-LD", "shopify-json": "Shopify product/variant JSON", "embedded-json": "embedded application state"}
RELATED = "related|recommended|you may also like|customers also"
CONFIDENT = 78
MISSING = ("missing_product_identity", "missing_price", "missing_currency")
BLOCKING = ("variant_ambiguity", "price_conflict", "product_conflict")
PRICE_IN_TEXT = r"(?i)((?:[$€£¥]\s*)[0-9][0-9.,]*|[0-9][0-9.,]*\s?(?:USD|EUR|GBP|CAD|AUD|MAD|JPY|CHF)" + pages.EDGE + ")"
IDENTIFIER = (
    r"(?i)\b(?:sku|model|mpn|item\s*(?:number|no\.?|#)|product\s*(?:code|number|no\.?|#)|part\s*(?:number|no\.?|#))\b"
)
PRODUCT_PATH, SKU_PATH = r"/(?:products?|p|dp|item|itm)[/_-]", r"(?:^|[-_])sku[-_]"
TWO_PRICES = "sale|save|regular|was|now|compare|msrp|off"

IDENTITY = ("title", "canonical_url", "product_id", "variant_id", "handle", "sku", "barcode", "mpn", "vendor", "brand")
#: Places of the sources that are one candidate a page, after all objects.
LATER = {"product-meta": 1 << 40, "semantic-html": 2 << 40, "page-text": 3 << 40}
COLUMNS = ("page_url", "cand", "source", *IDENTITY, "description", "features", "availability", "options", "ambiguous", "score", "context", "prices")


def authority(source: Column) -> Column:
    out = F.lit(0)
    for name, points in AUTHORITY.items():
        out = F.when(source == name, points).otherwise(out)
    return out


def bare_price(value: Column, currency: Column, source: Column, context: Column, kind: Column | None = None, variant: Column | None = None, *more: Column) -> Column:
    """A price that ``judged_prices`` gives its kind, by the context unless one is given, and confidence."""
    none = F.lit(None).cast("string")
    return F.struct(
        value.alias("value"), currency.alias("currency"), source.alias("source"), context.alias("context"),
        (none if kind is None else kind).alias("kind"), (none if variant is None else variant).alias("variant"), *more,
    )


def judged_prices(prices: Column, *more: str) -> Column:
    """Prices that are any, with kinds and confidence; ``more`` names further fields that stay."""
    there = F.filter(prices, lambda p: p["value"].isNotNull())
    kinded = F.transform(there, lambda p: p.withField("kind", F.coalesce(p["kind"], pages.price_kind(p["context"]))))

    def judged_price(p: Column) -> Column:
        kind = p["kind"]
        worth = authority(p["source"]) / 5 + F.when(kind.isin(*EXCLUDED), -0.35).otherwise(0.0) + F.when(kind.isin("current", "sale"), 0.03).otherwise(0.0)
        own = [p[f].alias(f) for f in ("value", "currency", "source")]
        sure = F.greatest(F.lit(0.1), F.least(F.lit(0.99), worth)).alias("confidence")
        return F.struct(*own, F.left(p["context"], F.lit(300)).alias("context"), kind.alias("kind"), sure, p["variant"].alias("variant"), *(p[f].alias(f) for f in more))

    return F.transform(kinded, judged_price)


def amount(money: Column) -> Column:
    """A positive price of a JSON number or text; null for all else."""
    number = money["number"]
    return F.when(number.isNotNull(), F.when((number > 0) & (number < float("inf")), number)).otherwise(matching.parsed_price(money["text"]))


def minor_amount(money: Column) -> Column:
    """As ``amount``, where whole numbers from 1000 on are in hundredths."""
    number = money["number"]
    return F.when((number >= 1000) & (number == F.floor(number)), number / 100).otherwise(amount(money))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stating(rows: DataFrame) -> DataFrame:
    """Rows with a title or a price.

    The partition's number keeps the optimizer from pushing the test below the steps that make
    titles and prices, where it would repeat all of their expressions.
    """
    fits = (F.col("title").isNotNull() | (F.size("prices") > 0)) & (F.col("_part") >= 0)
    return rows.withColumn("_part", F.spark_partition_id()).filter(fits).drop("_part")


def object_candidates(docs: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """Candidates of product objects in scripts."""
    context = F.lit(None).cast("string")
    for name, words in CONTEXTS.items():
        context = F.when(F.col("source") == name, words).otherwise(context)
    rows = page_objects.script_products(docs, key, url, content).withColumn("context", context)
    rows = rows.withColumns({name: pages.clean_text(F.col(name)) for name in (*IDENTITY, "description", "availability")})
    source, wanted = F.col("source"), F.nullif(F.regexp_extract("page_url", r"(?i)[?&]variant=([0-9]+)", 1), F.lit(""))

    def offered(o: Column) -> Column:
        words = F.concat_ws(" ", F.col("context"), F.when(o["name"].isNotNull(), _text(pages.clean_text(o["name"]))), o["price_type"])
        return bare_price(amount(o["price"]), pages.currency(o["currency"], _text(o["price"]["text"])), source, words, o["kind"])

    def labelled(v: Column) -> Column:
        options = F.filter(F.transform(v["options"], pages.clean_text), lambda o: o.isNotNull())
        return F.struct(v.alias("v"), F.coalesce(F.nullif(F.array_join(options, " / "), F.lit("")), pages.clean_text(v["title"])).alias("label"))

    def usable(x: Column) -> Column:
        v, words = x["v"], F.concat(F.col("context"), F.lit(" variant "), _text(x["label"]))
        money = pages.currency(v["currency"], F.lit(""))
        current = bare_price(minor_amount(v["price"]), money, source, words, None, x["label"])
        compare = bare_price(minor_amount(v["compare"]), money, source, F.concat(words, F.lit(" compare at")), F.lit("original"), x["label"])
        return F.struct(v.alias("v"), x["label"].alias("label"), current.alias("current"), compare.alias("compare"))

    rows = rows.withColumns({"offered": F.transform("offered", offered), "labelled": F.transform("variants", labelled)})
    rows = rows.withColumn("usable", F.transform("labelled", usable))
    values = F.filter(F.transform("usable", lambda u: u["current"]["value"]), lambda v: v.isNotNull())
    marked = _first(F.filter("usable", lambda u: u["v"]["selected"] | F.coalesce(u["v"]["id"] == wanted, F.lit(False))))
    rows = rows.withColumns({"differ": F.coalesce(F.array_max(values) - F.array_min(values) > 0.01, F.lit(False)), "marked": marked})
    same = F.filter("usable", lambda u: (u["v"]["place"] == F.col("marked.v.place")) | (_text(u["v"]["own_id"]) == _text(F.col("marked.v.own_id"))))
    rows = rows.withColumn("chosen", F.when(F.col("marked").isNotNull(), _first(same)).when(~F.col("differ"), _first(F.col("usable"))))
    own = lambda name: pages.clean_text(F.col(f"chosen.v.{name}"))
    chosen = F.col("chosen").isNotNull()
    rows = rows.withColumn("prices", F.concat("offered", F.when(chosen, F.array("chosen.current", "chosen.compare")).otherwise(F.slice("offered", 1, 0))))
    rows = rows.withColumns({
        "prices": judged_prices(F.col("prices")), "variant_id": F.when(chosen, own("id")).otherwise(F.col("variant_id")),
        "sku": F.coalesce("sku", own("sku")), "barcode": F.coalesce("barcode", own("barcode")),
        # An object without a name of its own is none; whether it has one is asked before variants lend theirs.
        "named": F.coalesce("title", "product_id", "sku").isNotNull(), "availability": F.coalesce(F.col("availability"), own("available")),
        "ambiguous": (F.col("n_variants") > 1) & ~chosen & F.col("differ"), "options": F.filter(F.transform("usable", lambda u: u["label"]), lambda o: o.isNotNull()),
        "features": F.slice(F.filter(F.transform("features", pages.clean_text), lambda f: f.isNotNull()), 1, 12),
    }).filter("named")
    points = lambda fits, n: F.when(fits, n).otherwise(0.0)
    score = (
        authority(source) / 5 + points(F.col("title").isNotNull(), 0.12) + points(F.size("prices") > 0, 0.12)
        + points(F.coalesce("product_id", "sku").isNotNull(), 0.1) - points(F.lower("context").rlike(RELATED), 0.45) - points(F.col("ambiguous"), 0.2)
    )
    return rows.withColumns({"score": score, "cand": F.col("place").cast("long")}).select(key, *COLUMNS)


def canonical_url(content: Column) -> Column:
    tag = F.regexp_extract(content, r"""(?i)<link\b[^>]*rel=["'][^"']*canonical[^"']*["'][^>]*>""", 0)
    return F.nullif(F.regexp_extract(tag, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def _inner(content: Column, tag: str) -> Column:
    """What the first element of that name holds; null if there is none."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return F.when(content.rlike(pattern), F.regexp_extract(content, pattern, 1))


def page_title(content: Column, meta_title: Column) -> Column:
    """By the main heading, meta tags, the title, or a line marked as a heading, the first that is there."""
    line = F.nullif(F.regexp_extract(content, r"(?:^|\n)#\s+(\S[^\r\n]*)", 1), F.lit(""))
    return pages.clean_text(F.coalesce(_inner(content, "h1"), meta_title, _inner(content, "title"), line))


def _packed(rows: DataFrame, name: str, source: str, facts: dict[str, Column], working: str) -> DataFrame:
    """``rows`` with a page's one candidate of a source as a struct, without the working columns of that prefix."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    base = {c: none for c in (*IDENTITY, "description", "availability")} | {"features": empty, "options": empty, "ambiguous": F.lit(False)}
    base |= {"cand": F.lit(LATER[source]), "source": F.lit(source), "page_url": F.col("page_url"), "canonical_url": F.col("canonical")} | facts
    return rows.withColumn(name, F.struct(*(base[c].alias(c) for c in COLUMNS))).drop(*(c for c in rows.columns if c.startswith(working)))


def _one_price(value: Column, currency: Column, source: str, context: str) -> Column:
    return judged_prices(F.array(bare_price(matching.parsed_price(value), pages.currency(currency, _text(value)), F.lit(source), F.lit(context))))


def with_meta(rows: DataFrame) -> DataFrame:
    """``rows`` (page_url, content, canonical, tags) with the candidate that their meta tags state, as ``meta``."""
    rows = rows.withColumns({f"m_{fact}": extraction.meta_fact(F.col("tags"), fact) for fact in extraction.META_NAMES})
    rows = rows.withColumn("m_prices", _one_price(F.col("m_price"), F.col("m_currency"), "product-meta", "OpenGraph/product meta price"))
    score = F.lit(0.55) + F.when(F.size("m_prices") > 0, 0.12).otherwise(0.0) + F.when(F.col("m_title").isNotNull(), 0.12).otherwise(0.0)
    own = {"title": "title", "sku": "sku", "barcode": "barcode", "vendor": "vendor", "brand": "vendor", "description": "description", "availability": "availability"}
    facts = {name: F.col(f"m_{fact}") for name, fact in own.items()} | {"prices": F.col("m_prices"), "score": score, "context": F.lit("OpenGraph/product meta")}
    return _packed(rows, "meta", "product-meta", facts, "m_")


def with_semantic(rows: DataFrame) -> DataFrame:
    """``rows`` with the candidate that item properties state, as ``semantic``."""
    rows = rows.withColumns({f"s_{fact}": extraction.item_property(F.col("content"), name) for fact, name in extraction.ITEM_NAMES.items()})
    rows = rows.withColumn("s_prices", _one_price(F.col("s_price"), F.col("s_currency"), "semantic-html", "semantic Product price"))
    score = F.lit(0.8) + F.when(F.size("s_prices") > 0, 0.1).otherwise(0.0)
    facts = {"title": F.col("s_title"), "sku": F.col("s_sku"), "prices": F.col("s_prices"), "score": score, "context": F.lit("semantic Product HTML")}
    return _packed(rows, "semantic", "semantic-html", facts, "s_")


def _differ(two: Column) -> Column:
    return (F.size(two) == 2) & (F.get(two, F.lit(0))["value"] != F.get(two, F.lit(1))["value"])


def _relabelled(rows: Column, two: Column, fits: Column) -> Column:
    """Of two prices the lower is a sale's and the other the original one, if it fits."""
    lower = F.least(F.get(two, F.lit(0))["value"], F.get(two, F.lit(1))["value"])
    within = lambda r: F.exists(two, lambda t: (t["line"] == r["line"]) & (t["turn"] == r["turn"]))
    return F.transform(rows, lambda r: F.when(fits & within(r), r.withField("kind", F.when(r["value"] == lower, "sale").otherwise("original"))).otherwise(r))


def _own_line(rows: DataFrame, near_title: bool) -> DataFrame:
    """On a product's page, the prices of the first line that has one of its own, if they are three at most."""
    r = F.col("t_rows")
    able = F.filter(r, lambda p: ~p["kind"].isin(*EXCLUDED) & ((p["line"] >= F.col("t_at")) & (p["line"] - F.col("t_at") <= 12) if near_title else F.lit(True)))
    rows = rows.withColumn("t_first", F.array_min(F.transform(able, lambda p: p["line"])))
    rows = rows.withColumn("t_own", F.filter("t_rows", lambda p: p["line"] == F.col("t_first")))
    current = F.filter("t_own", lambda p: p["kind"] == "current")
    told = F.col("t_sku_path") | F.lower(F.array_join(F.transform("t_own", lambda p: p["context"]), " ")).rlike(TWO_PRICES)
    fits = F.col("t_product_page") & (F.col("t_at") >= 0 if near_title else F.lit(True)) & F.size("t_own").between(1, 3)
    return rows.withColumn("t_rows", F.when(fits, _relabelled(F.col("t_own"), current, _differ(current) & told)).otherwise(F.col("t_rows"))).drop("t_first", "t_own")


def with_text(rows: DataFrame) -> DataFrame:
    """``rows`` with the candidate of their visible text, as ``text``: the page's title and the prices,
    narrowed to those near what names the product.

    Lines stand without tags; ``t_at`` is the line that has most of the title's tokens, and
    ``t_rows`` are prices with their lines.
    """
    stripped = F.transform(F.split("content", r"\r?\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), f"{pages.SPACES}+", " ")))
    rows = rows.withColumns({"t_title": page_title(F.col("content"), extraction.meta_fact(F.col("tags"), "title")), "t_lines": F.filter(stripped, lambda s: s != "")})
    anchor = F.coalesce("t_title", "page_url")
    rows = rows.withColumns({
        "t_anchor": matching.title_tokens(matching.decomposed(_text(anchor))), "t_plain": matching.decomposed(F.array_join("t_lines", "\n")),
        "t_url_tokens": matching.title_tokens(matching.decomposed(_text(F.col("page_url")))), "t_title_words": matching.title_tokens(matching.decomposed(_text(F.col("t_title")))),
    })
    shared = F.transform(F.split("t_plain", "\n"), lambda s: F.size(F.filter(matching.title_tokens(s), lambda t: F.array_contains("t_anchor", t))))
    rows = rows.withColumn("t_shared", shared)
    least = F.least(F.lit(3), F.greatest(F.lit(1), F.size(F.array_distinct("t_anchor"))))
    numbered = F.transform("t_lines", lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    heading = _first(F.filter(numbered, lambda x: x["s"].rlike(r"^#\s+\S") & (F.get("t_shared", x["i"]) >= least)))["i"]
    best = F.when(F.array_max("t_shared") > 0, F.array_position("t_shared", F.array_max("t_shared")).cast("int") - 1)
    rows = rows.withColumn("t_at", F.when(anchor.isNotNull(), F.coalesce(heading, best, F.lit(-1))).otherwise(-1))

    priced = F.filter(numbered, lambda x: x["s"].rlike(PRICE_IN_TEXT))
    line = lambda i: F.get("t_lines", i)
    parts = lambda x: F.split(F.regexp_replace(F.replace(x["s"], F.lit("\x01"), F.lit(" ")), PRICE_IN_TEXT, "\x01$1\x01"), "\x01")
    rows = rows.withColumn("t_priced", F.transform(priced, lambda x: F.struct(x["i"].alias("i"), parts(x).alias("parts"), F.concat_ws(" ", line(x["i"] - 1), line(x["i"]), line(x["i"] + 1)).alias("nearby"))))

    def prices_of(x: Column) -> Column:
        def price(turn: Column) -> Column:
            shown, before = F.get(x["parts"], turn), F.array_join(F.slice(x["parts"], 1, turn), "")
            words = F.concat(before, F.lit(" "), shown, F.lit(" | nearby: "), x["nearby"])
            money = pages.currency(F.lit(None).cast("string"), shown)
            return bare_price(matching.parsed_price(shown), money, F.lit("page-text"), words, None, None, x["i"].alias("line"), turn.alias("turn"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(x["parts"]) - 1), lambda k: k % 2 == 1), price)

    rows = rows.withColumn("t_rows", judged_prices(F.flatten(F.transform("t_priced", prices_of)), "line", "turn"))
    rows = rows.drop("t_plain", "t_priced", "t_shared", "t_lines")
    gap = lambda p: p["line"] - F.col("t_at")
    rows = rows.withColumn("t_rows", F.when((F.size("t_rows") > 8) & (F.col("t_at") >= 0), F.filter("t_rows", lambda p: F.abs(gap(p)) <= 30)).otherwise(F.col("t_rows")))
    headed, local = F.filter("t_rows", lambda p: gap(p) == 0), F.filter("t_rows", lambda p: (gap(p) > 0) & (gap(p) <= 30))
    close = (F.size("t_local") == 2) & (F.get("t_local", F.lit(1))["line"] - F.get("t_local", F.lit(0))["line"] <= 2)
    rows = rows.withColumns({"t_headed": headed, "t_local": local})
    rows = rows.withColumn("t_main", F.when(F.size("t_headed") == 2, F.col("t_headed")).when(close, F.col("t_local")).otherwise(F.slice("t_rows", 1, 0)))
    fits = _differ(F.col("t_main")) & F.forall("t_main", lambda p: p["kind"] == "current")
    rows = rows.withColumns({"t_rows": _relabelled(F.col("t_rows"), F.col("t_main"), fits), "t_main": _relabelled(F.col("t_main"), F.col("t_main"), fits)})
    path = F.lower(_text(F.try_parse_url("page_url", F.lit("PATH"))))
    in_url = lambda t: F.array_contains("t_url_tokens", t)
    rows = rows.withColumn("t_sku_path", path.rlike(SKU_PATH))
    named = F.exists(pages.model_tokens(F.col("t_title")), in_url) | (F.size(F.filter("t_title_words", in_url)) >= 2) | F.col("t_sku_path")
    rows = rows.withColumn("t_product_page", (path.rlike(PRODUCT_PATH) | F.col("t_sku_path")) & F.coalesce(named, F.lit(False)))
    rows = rows.withColumn("t_rows", F.when(F.col("t_product_page") & (F.size("t_main") > 0), F.col("t_main")).otherwise(F.col("t_rows")))
    rows = _own_line(_own_line(rows, near_title=True), near_title=False)
    rows = rows.withColumn("t_anchored", F.filter("t_rows", lambda p: (gap(p) >= 0) & (gap(p) <= 8) & pages.found(p["context"], IDENTIFIER)))
    rows = rows.withColumn("t_rows", F.when((F.col("t_at") >= 0) & F.size("t_anchored").between(1, 3), F.col("t_anchored")).otherwise(F.col("t_rows")))
    price = lambda p: F.struct(*(p[f].alias(f) for f in ("value", "currency", "source", "context", "kind", "confidence", "variant")))
    score = F.lit(0.38) + F.when(F.col("t_title").isNotNull(), 0.1).otherwise(0.0)
    facts = {"title": F.col("t_title"), "prices": F.transform("t_rows", price), "score": score, "context": F.lit("relevant product page text")}
    return _packed(rows, "text", "page-text", facts, "t_")


def candidates(docs: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """A row for each product that a part of a page states: ``key`` and ``COLUMNS``; cand orders a page's.

    A null page states nothing, and a null address is as none; repeated keys are to be left out
    before.  Other columns are left aside.
    """
    rows = docs.select(F.col(key), F.col(url).alias("page_url"), F.col(content).alias("content")).filter("content is not null")
    rows = rows.withColumns({"canonical": canonical_url(F.col("content")), "tags": extraction.meta_tags(F.col("content"))})
    rows = with_text(with_semantic(with_meta(rows))).select(key, F.explode(F.array("meta", "semantic", "text")).alias("c")).select(key, "c.*")
    out = object_candidates(docs, key, url, content).unionByName(_stating(rows))
    named = F.coalesce("title", "sku", "barcode", "product_id")
    tokens = F.array_join(matching.title_tokens(matching.decomposed(_text(named))), " ")
    return out.withColumn("name_key", F.coalesce(F.nullif(tokens, F.lit("")), F.concat(F.lit("source:"), F.col("source"))))


def merged(found: DataFrame, key: str) -> DataFrame:
    """One row for each product of a page: of candidates of one name the first facts, all sources and
    prices in order, and a score that each further candidate raises."""
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("cand"))).alias(name)
    inside = F.struct("cand", "source", "score", "prices", "features", "options")
    facts = [first(name) for name in (*IDENTITY, "description", "availability", "page_url")]
    rows = found.groupBy(key, "name_key").agg(
        *facts, F.min("cand").alias("cand"), F.min_by("context", "cand").alias("context"), F.bool_or("ambiguous").alias("ambiguous"),
        F.max(F.when(F.col("source") == "page-text", F.col("title"))).alias("page_title"), F.array_sort(F.collect_list(inside)).alias("parts"),
    )
    each = lambda name: F.transform("parts", lambda p: p[name])
    once = lambda values: F.when(F.size("parts") == 1, values).otherwise(F.array_distinct(values))
    score = F.aggregate(F.slice(each("score"), 2, F.size("parts")), _first(each("score")), lambda total, one: F.greatest(total, one) + 0.08)
    return rows.withColumns({
        "sources": F.array_distinct(each("source")), "prices": F.flatten(each("prices")), "score": score,
        "features": F.slice(once(F.flatten(each("features"))), 1, 12), "options": once(F.flatten(each("options"))),
    }).drop("parts")


def price_groups(prices: Column) -> Column:
    """Equal current prices together, best first: by the most authoritative source, its confidence and their number."""
    current = F.filter(prices, lambda p: p["kind"].isin("current", "sale", "unknown"))
    cents = lambda p: F.format_string("%.2f", p["value"])

    def group(shown: Column, place: Column) -> Column:
        own = F.filter(current, lambda p: cents(p) == shown)
        worth = F.array_max(F.transform(own, lambda p: authority(p["source"]) * 10 + p["confidence"])) + F.size(own)
        return F.struct(
            (-worth).alias("order"), place.alias("place"), F.array_max(F.transform(own, lambda p: authority(p["source"]))).alias("authority"),
            F.size(F.array_distinct(F.transform(own, lambda p: p["source"]))).alias("n_sources"), _first(own).alias("price"),
        )

    return F.array_sort(F.transform(F.array_distinct(F.transform(current, cents)), group))


def priced(rows: DataFrame) -> DataFrame:
    """``rows`` of ``merged`` with the price in force, the original one, conflicts and how good the evidence is."""
    rows = rows.withColumn("groups", price_groups(F.col("prices")))
    rows = rows.withColumns({"winner": _first(F.col("groups")), "runner": F.get("groups", F.lit(1)), "conflict": F.size("groups") > 1})
    originals = F.transform(F.filter("prices", lambda p: p["kind"] == "original"), lambda p, i: F.struct((-authority(p["source"])).alias("order"), i.alias("place"), p.alias("price")))
    settled = ~F.col("conflict") | (F.col("winner.authority") > F.col("runner.authority"))
    rows = rows.withColumns({
        "current": F.col("winner.price"), "original": _first(F.array_sort(originals))["price"], "settled": settled,
        "n_sources": F.coalesce("winner.n_sources", F.lit(0)),
    })
    points = (
        F.col("score") / 1.4 + F.when(F.col("current").isNotNull(), 0.12).otherwise(0.0) + F.when(F.col("n_sources") > 1, 0.12).otherwise(0.0)
        + F.when(F.col("settled"), 0.03).otherwise(-0.18) - F.when(F.col("ambiguous"), 0.2).otherwise(0.0)
    )
    return rows.withColumn("evidence_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), points))).drop("groups", "winner", "runner")


def chosen(rows: DataFrame, key: str) -> DataFrame:
    """The product of each page: that of the highest score, raised by tokens shared with the page's
    title; product_conflict tells of a near second one with another id."""
    page = Window.partitionBy(key)
    title = F.max("page_title").over(page)
    rows = rows.withColumns({"page_title": title, "n_products": F.count("*").over(page)})
    rows = rows.withColumns({"_page": matching.title_tokens(matching.decomposed(_text(F.col("page_title")))), "_own": matching.title_tokens(matching.decomposed(_text(F.col("title")))), "_id": F.array_join(matching.title_tokens(matching.decomposed(_text(F.col("product_id")))), " ")})
    boost = F.size(F.filter("_own", lambda t: F.array_contains("_page", t))) * 0.02
    order = page.orderBy(F.desc(F.col("score") + boost), "cand")
    after = {c: F.lead(c).over(order) for c in ("product_id", "_id", "score")}
    clash = F.col("product_id").isNotNull() & after["product_id"].isNotNull() & (F.col("_id") != after["_id"]) & (F.abs(F.col("score") - after["score"]) <= 0.1)
    ranked = rows.withColumns({"product_conflict": F.coalesce(clash, F.lit(False)), "_place": F.row_number().over(order)})
    return ranked.filter("_place = 1").drop("_page", "_own", "_id", "_place")


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with score parts, reasons against the product and its state."""
    current, kinds = F.col("current"), F.transform("prices", lambda p: p["kind"])
    percent = F.col("evidence_score") * 100
    only = lambda kind: current.isNull() & F.array_contains(kinds, kind)
    reasons = {
        "missing_product_identity": F.coalesce("title", "product_id", "sku", "barcode").isNull(), "missing_price": current.isNull(),
        "missing_currency": current.isNotNull() & F.col("current.currency").isNull(), "variant_ambiguity": F.col("ambiguous"),
        "price_conflict": F.col("conflict") & ~F.col("settled"), "product_conflict": F.col("product_conflict"),
        "related_product_confusion": only("related"), "subscription_price_confusion": only("subscription"), "installment_price_confusion": only("installment"),
        "shipping_price_confusion": only("shipping"), "bundle_price_confusion": only("bundle"),
        "unsupported_page_structure": F.forall("sources", lambda s: s == "page-text"), "low_confidence": percent < CONFIDENT,
    }
    parts = {
        "source_reliability": F.col("score") / 1.4 * 100, "price_present": F.when(current.isNotNull(), 12.0).otherwise(0.0),
        "cross_source_agreement": F.when(F.col("n_sources") > 1, 12.0).otherwise(0.0), "price_consistency": F.when(F.col("settled"), 3.0).otherwise(-18.0),
        "variant_consistency": F.when(F.col("ambiguous"), -20.0).otherwise(0.0),
    }
    rows = rows.withColumn("reasons", F.filter(F.array(*(F.when(fits, name) for name, fits in reasons.items())), lambda r: r.isNotNull()))
    lacks = lambda names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    state = F.when(lacks(MISSING), "unresolved").when(lacks(BLOCKING) | (percent < CONFIDENT), "ambiguous").otherwise("confident")
    breakdown = F.array(*(F.struct(F.lit(name).alias("signal"), points.alias("points")) for name, points in parts.items()))
    return rows.withColumns({"state": state, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100)), "breakdown": breakdown})


def products(docs: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """The product of each page that states any: ``key`` and its facts, prices, state and reasons."""
    rows = judged(chosen(priced(merged(candidates(docs, key, url, content), key)), key))
    clear = lambda c: F.when(~F.col("ambiguous"), c)
    current, original = F.col("current"), F.col("original")
    on_sale = (original.isNotNull() | (F.col("current.kind") == "sale")) & (original.isNull() | (F.col("current.value") < F.col("original.value")))
    best = F.array_max(F.transform("sources", authority))
    return rows.select(
        key, F.coalesce("title", "page_title").alias("title"), "description", "features", clear(F.col("current.value")).alias("price"),
        clear(F.coalesce("current.currency", "original.currency")).alias("currency"), clear(F.when(current.isNotNull() & on_sale, F.col("current.value"))).alias("sale_price"),
        clear(F.col("original.value")).alias("original_price"), "availability", "sku", "barcode", F.coalesce("vendor", "brand").alias("vendor"), "brand", "product_id", "variant_id",
        "handle", "mpn", F.coalesce("canonical_url", "page_url").alias("canonical_url"), _first(F.filter("sources", lambda s: authority(s) == best)).alias("source"), "sources",
        F.exists("sources", lambda s: s != "page-text").alias("structured"), "n_products", "options", F.col("ambiguous").alias("variant_ambiguous"), F.col("conflict").alias("price_conflict"),
        "settled", "product_conflict", "n_sources", "evidence_score", "confidence", "state", "reasons", "breakdown", "prices", "name_key",
    )


SHOWN_AS = {"json-ld": "jsonld", "shopify-json": "shopify", "embedded-json": "embedded_state", "product-meta": "meta", "semantic-html": "semantic_html", "page-text": "visible_text"}
FIELDS = {
    "title": "title", "canonical_url": "product", "product_id": "product_id", "handle": "handle", "sku": "sku", "barcode": "gtin", "mpn": "mpn", "vendor": "vendor", "brand": "brand",
}


def evidence(found: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """What speaks for each page's product, a row for each distinct piece: ``key``, part (product, variant
    or price), source, field, value, confidence and context."""
    own = found.join(selected.select(key, "name_key"), [key, "name_key"])
    source = lambda c: F.element_at(F.create_map(*(F.lit(x) for pair in SHOWN_AS.items() for x in pair)), c)
    piece = lambda part, field, value, sure, words, of: F.struct(*(c.alias(n) for c, n in ((F.lit(part), "part"), (of, "source"), (field, "field"), (value, "value"), (sure, "confidence"), (words, "context"))))
    short = lambda c: F.left(F.trim(F.regexp_replace(c, f"{pages.SPACES}+", " ")), F.lit(500))
    sure, words, of = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), short(F.col("context")), source(F.col("source"))
    facts = F.array(*(piece("product", F.lit(field), F.col(name), sure, words, of) for name, field in FIELDS.items()))
    variants = F.concat(
        F.array(piece("variant", F.lit("variant_id"), F.col("variant_id"), sure, words, of)),
        F.transform("options", lambda o: piece("variant", F.lit("variant_option"), o, sure, words, of)),
    )
    amounts = F.transform("prices", lambda p: piece("price", F.when(p["kind"] == "original", "compare_at_price").otherwise("price"), p["value"].cast("string"), p["confidence"], short(p["context"]), source(p["source"])))
    currencies = F.transform("prices", lambda p: piece("price", F.lit("currency"), p["currency"], p["confidence"], short(p["context"]), source(p["source"])))
    address = F.array(piece("product", F.lit("product"), F.col("page_url"), F.lit(0.5), F.lit("requested page URL"), F.lit("url")))
    rows = own.select(key, "cand", F.explode(F.filter(F.concat(facts, variants, amounts, currencies, address), lambda e: e["value"].isNotNull())).alias("e"))
    return rows.groupBy(key, "e.part", "e.source", "e.field", "e.value", "e.context").agg(F.min_by("e.confidence", "cand").alias("confidence"))


def assessed(rows: DataFrame, title: str, sku: str, barcode: str, vendor: str) -> DataFrame:
    """``rows`` of ``products``, each with an own product's columns, judged as one product or two: the
    columns of ``pages.match_scores``, high_confidence, deterministic_match, and match_state,
    match_reasons and match_score of both together."""
    rows = rows.withColumn("identity_url", F.concat_ws(" ", "canonical_url", "mpn"))
    scored = pages.match_scores(rows.withColumnsRenamed({"title": "seen_title", "sku": "seen_sku", "vendor": "seen_vendor"}), title, sku, vendor, "seen_title", "seen_sku", "seen_vendor", "identity_url")
    kept = rows.select("page_id", "price", "currency", "structured", "state", "variant_ambiguous", "evidence_score", "n_sources", "source", "settled", "reasons", F.size("prices").alias("n_prices"), matching.equal_identifier(F.col(barcode), F.col("barcode")).alias("same_barcode"))
    out = scored.select("page_id", "title_similarity", "sku_confidence", "model_exact", "variant_similarity", "vendor_matches", "vendor_confirmed", "identity_strong", "match_confidence").join(kept, "page_id")
    exact = (F.col("sku_confidence") == 1) | F.col("same_barcode")
    out = out.withColumns({"exact": exact, "identity_strong": F.col("identity_strong") | F.col("same_barcode"), "match_confidence": F.when(F.col("same_barcode"), 1.0).otherwise(F.col("match_confidence"))})
    complete = F.coalesce((F.col("price") > 0) & (F.col("currency") != ""), F.lit(False))
    agrees = (F.col("n_sources") > 1) | F.col("exact") | (F.col("source").isin("shopify-json", "json-ld", "embedded-json") & (F.col("title_similarity") >= 0.92))
    sure = (
        F.col("structured") & (F.col("state") == "confident") & complete & F.col("identity_strong") & (F.col("variant_similarity") == 1) & F.col("vendor_matches")
        & ~F.col("variant_ambiguous") & (F.col("evidence_score") >= 0.78) & agrees
    )
    blocked = F.arrays_overlap("reasons", F.array(*map(F.lit, ("missing_price", "missing_currency", *BLOCKING))))
    literal = F.col("identity_strong") & F.col("model_exact") & F.col("vendor_confirmed") & complete & ~F.col("variant_ambiguous") & F.col("settled") & (F.col("n_prices") > 0) & ~blocked
    out = out.withColumns({"is_match": F.col("identity_strong") & (F.col("variant_similarity") == 1) & F.col("vendor_matches"), "high_confidence": sure, "deterministic_match": literal, "complete": complete})
    low = F.least(F.lit(0.84), F.greatest(F.lit(0.0), F.col("evidence_score") * 0.75 + F.col("match_confidence") * 0.25))
    score = F.when(F.col("high_confidence"), F.greatest(F.lit(0.92), F.least(F.lit(0.99), F.col("evidence_score") + 0.15))).otherwise(low)
    more = {"missing_product_identity": ~F.col("identity_strong"), "variant_ambiguity": F.col("variant_similarity") != 1, "product_conflict": ~F.col("vendor_matches"), "low_confidence": ~F.col("high_confidence")}
    added = F.filter(F.array(*(F.when(fits, name) for name, fits in more.items())), lambda r: r.isNotNull())
    state = F.when(F.col("high_confidence"), "confident").when(F.col("complete") & F.col("identity_strong"), "ambiguous").otherwise("unresolved")
    return out.withColumns({"match_score": score, "match_reasons": F.array_union("reasons", added), "match_state": state}).drop("exact", "complete", "n_prices", "same_barcode")
