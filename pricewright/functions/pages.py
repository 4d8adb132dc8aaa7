"""Pages and listings: price kinds, currencies, page classes, identifiers and the scored match, as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching

# Fixed values.
CURRENCIES = (
    "USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CNY", "MAD", "CHF", "SEK",
    "NOK", "DKK", "PLN", "BRL", "MXN", "INR", "AED", "SAR", "NZD",
)
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "د.م.": "MAD"}
CARD_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP"}
COUNTRY_OF = {"USD": "US", "GBP": "GB", "EUR": "FR", "CAD": "CA", "AUD": "AU", "JPY": "JP", "BRL": "BR", "INR": "IN", "MAD": "MA"}
COUNTRIES = ("US", "GB", "DE", "FR", "CA", "AU", "JP", "BR", "IN", "NL", "MA")
GENERIC_TOKENS = ("4k", "5g", "8k", "bluetooth", "gb", "hd", "hz", "inch", "mah", "tb", "usb", "wifi", "wireless")
# Kinds of prices by words near them, the first that fits, and patterns of pages.
PRICE_KINDS = (
    ("shipping", r"shipping|delivery|postage|freight|handling"),
    ("subscription", r"subscription|subscribe|monthly|per month|/month|recurring"),
    ("installment", r"installment|afterpay|affirm|klarna|pay in [0-9]|[0-9]+ payments?|interest-free|/mo\b"),
    ("unit", r"per unit|unit price|/[a-z]{1,3}\b|\bkg\b|\b100 ?g\b"),
    ("bundle", r"bundle|pack of|\bset of|each\b|together"),
    ("related", r"related|recommended|you may also like|customers also"),
    ("discount", r"save|discount|you save"),
    ("original", r"was\b|old price|original price|compared? at|list price|regular price|rrp|msrp"),
    ("sale", r"now\b|sale price|special price|offer price|clearance"),
)
NOT_PRODUCT_PATHS = (
    r"/(?:search|s|collections?|categories?|category|blog|reviews?|stores?|brands?|pages?|clp|site|b|most-wished-for|shopping/pl|goto)(?:/|$)",
    r"(?:^|/)\b(?:best|review|support|manual|compare)\b",
)
PRODUCT_PATH = r"(?i)/products?/|/dp/|/p/|/item/|/itm/|/ip/"
JUNK_TITLE = r"(?i)\b(?:review|support|manual|category|collection|best)\b"
PRICE_ON_PAGE = (
    r"(?i)[$£€][ \t\n\r]?[0-9][0-9,.]*|[0-9][0-9,.]*[ \t\n\r]?(?:USD|EUR|GBP|CAD|AUD|MAD|JPY|CHF)\b",
    r"""(?i)["']price["'][ \t\n\r]*:[ \t\n\r]*["']?[0-9][0-9,.]*""",
    r"""(?i)(?:product:price:amount|itemprop=["']price["'])[^>\n]*[0-9]""",
)
STRUCTURED = (r"""(?is)application/ld\+json.{0,1000}"@type"[ \t\n\r]*:[ \t\n\r]*(?:"Product"|\[[^\]]*"Product")""", r"(?i)itemtype|data-product-type|product:price:amount|shopify_product")
INTERACTION = r"(?i)add to (?:cart|bag)|buy now|select (?:options|variant)|choose (?:options|variant)|sku|availability|in stock|out of stock"
TITLED = (r"(?i)<(?:h1|title)\b[^>]*>[^<]{3,200}</(?:h1|title)>", r"(?i)og:title|twitter:title|product:title")
ITEM_PATH = r"(?i)/(?:products?|items?|dp|p|ip|itm)\b"
ENTITIES = (("(?i)&quot;|&#34;", '"'), ("(?i)&apos;|&#39;", "'"), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&nbsp;", " "))
#: Failures of a search service by message and status.
QUOTA = r"quota|out of searches|run out of searches|no[ \t\n\r]+searches|searches?[ \t\n\r]+(?:left|limit|exhausted|remaining)|insufficient credits|credit limit|plan limit|monthly limit|daily limit|exhausted"

#: A word's edge by ASCII letters, digits and underscores, whatever the runtime's default is.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def edged(pattern: str) -> str:
    r"""The pattern with ``\b`` by ASCII."""
    return pattern.replace(r"\b", EDGE)


def found(c: Column, *patterns: str) -> Column:
    """Whether any of the patterns occurs."""
    hit = c.rlike(edged(patterns[0]))
    for pattern in patterns[1:]:
        hit |= c.rlike(edged(pattern))
    return hit


def price_kind(context: Column) -> Column:
    """What kind of price stands in a context: by its part before a bar, if that isn't blank."""
    lower = F.lower(context)
    own = F.trim(F.substring_index(lower, "|", 1))
    scan = F.when(own != "", own).otherwise(lower)
    kind = F.when(found(scan, r"\$0(?:\.00)?\b") & found(lower, "subscriber|subscription|renews|membership"), "subscription")
    for name, pattern in PRICE_KINDS:
        kind = kind.when(found(scan, pattern), name)
    return kind.otherwise("current")


def currency(given: Column, text: Column) -> Column:
    """The currency by a code or symbol given, by a symbol in the text, or by its first word of three letters."""
    code, symbol = F.upper(F.trim(given)), F.trim(given)
    out = F.when(code.isin(*CURRENCIES), code)
    for sign, name in SYMBOLS.items():
        out = out.when(symbol == sign, name)
    for sign, name in SYMBOLS.items():
        out = out.when(F.contains(text, F.lit(sign)), name)
    word = F.regexp_extract(F.upper(text), EDGE + "([A-Z]{3})" + EDGE, 1)
    return out.when(word.isin(*CURRENCIES), word)


@dataclass(frozen=True)
class CardPrice:
    amount: Column
    currency: Column


def card_price(text: Column) -> CardPrice:
    """The first amount in a result's text and its currency, dollars by default; a lone dot before three digits groups them."""
    pattern = r"(\$|€|£|USD|EUR|GBP)?[ \t\n\r]*([0-9]{1,3}(?:[,.][0-9]{3})*(?:[,.][0-9]{2})|[0-9]+(?:[,.][0-9]{2})?)"
    sign, digits = F.regexp_extract(text, pattern, 1), F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit(""))
    value = F.when(digits.rlike(r"^[0-9]{1,3}\.[0-9]{3}$"), F.replace(digits, F.lit("."), F.lit(""))).otherwise(digits)
    # Of a text with several marks only the number that it begins with counts.
    amount = F.regexp_extract(value, r"^[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    name = F.lit("USD")
    for s, code in CARD_SYMBOLS.items():
        name = F.when(sign == s, code).otherwise(name)
    return CardPrice(F.when(amount > 0, amount), F.when(amount > 0, name))


def model_tokens(c: Column) -> Column:
    """Distinct tokens with a letter and a digit, or of three digits or more, other than generic ones."""
    letters, digits = (lambda t: t.rlike("[a-z]")), (lambda t: t.rlike("[0-9]"))
    fits = lambda t: ~t.isin(*GENERIC_TOKENS) & ((letters(t) & digits(t)) | (~letters(t) & (F.length(t) >= 3)))
    return F.array_distinct(F.filter(matching.title_tokens(c), fits))


#: White space of any script, as a character class.
SPACES = r"[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def decoded(c: Column) -> Column:
    """With the six entities decoded, one kind after the other, and without white space at the ends."""
    for pattern, by in ENTITIES:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, rf"\A{SPACES}+|{SPACES}+\z", "")


def clean_text(c: Column) -> Column:
    """Without tags, white space as single spaces, entities decoded; null if nothing is left."""
    return F.nullif(decoded(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), f"{SPACES}+", " ")), F.lit(""))


def not_product_url(url: Column) -> Column:
    """Whether an address can't be a product's: by host and path, or since it can't be read."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    veto = host.startswith("support.") | (host == "cnet.com") | found(path, *NOT_PRODUCT_PATHS) | path.rlike(r"/shop/(?!products?(?:/|$))")
    return F.coalesce(veto, F.lit(True))


def relevance(title: Column, vendor: Column, url: Column, result_title: Column) -> Column:
    """How well a search result fits a product: shared words and models, a product's path, no junk title."""
    haystack = F.lower(F.concat_ws(" ", result_title, url))
    hits = lambda tokens: F.size(F.filter(tokens, lambda t: F.contains(haystack, t)))
    named = F.least(hits(matching.search_tokens(F.concat_ws(" ", vendor, title))), F.lit(5))
    models = F.least(2 * hits(model_tokens(title)), F.lit(6))
    return named + models + F.when(url.rlike(PRODUCT_PATH), 2).otherwise(0) - F.when(found(result_title, JUNK_TITLE), 5).otherwise(0)


def has_price(content: Column) -> Column:
    return found(content, *PRICE_ON_PAGE)


def shows_price(price: Column, content: Column) -> Column:
    """Whether the content, without commas and white space, has the price with two decimals or its whole part and a dot."""
    plain = F.regexp_replace(content, r"[,\s]", "")
    whole = F.floor(price + 0.5).cast("long").cast("string")
    return F.contains(plain, F.format_string("%.2f", price)) | F.contains(plain, F.concat(whole, F.lit(".")))


def page_class(content: Column, url: Column) -> Column:
    """confirmed_product, probable_product or non_product."""
    many = F.regexp_count(content, F.lit(r'(?i)"@type"[ \t\n\r]*:[ \t\n\r]*"?Product' + EDGE))
    structured = content.rlike(STRUCTURED[0]) | content.rlike(STRUCTURED[1])
    acts, title, path, price = content.rlike(INTERACTION), found(content, *TITLED), found(F.coalesce(url, F.lit("")), ITEM_PATH), has_price(content)
    return (
        F.when(url.isNotNull() & not_product_url(url), "non_product").when(structured & (many <= 1), "confirmed_product")
        .when((many > 1) & ~(title & acts & price & path), "non_product")
        .when((title | path) & (acts | price), "probable_product").otherwise("non_product")
    )


def country(given: Column, money: Column) -> Column:
    """The market: the country if it is known, else the currency's, else the United States."""
    out = F.when(F.upper(given).isin(*COUNTRIES), F.upper(given))
    for code, name in COUNTRY_OF.items():
        out = out.when(F.upper(money) == code, name)
    return out.otherwise("US")


def search_failure(status: Column, message: Column) -> Column:
    """The class of a search service's failure."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(F.coalesce(status == 401, F.lit(False)) | text.rlike("invalid api key|authentication"), "authentication_error")
        .when(text.rlike(QUOTA), "quota_exhausted").when(status == 429, "rate_limited").when(status == 403, "authentication_error")
        .when(status >= 500, "server_error").when(status >= 400, "other_4xx").otherwise("provider_error")
    )


def change_text(kind: Column, title: Column, shop: Column, before: Column, now: Column, percent: Column) -> Column:
    """A sentence about a change; prices in dollars with two decimals, percentages with one, halves up."""
    money = lambda p: F.coalesce(F.concat(F.lit("USD "), F.format_string("%.2f", p)), F.lit("N/A"))
    share = F.format_string("%.1f", F.floor(F.abs(percent) * 10 + 0.5).cast("double") / 10)
    moved = lambda verb, noun: F.concat(shop, F.lit(f' {verb} price for "'), title, F.lit('" from '), money(before), F.lit(" to "), money(now), F.lit(" ("), share, F.lit(f"% {noun})."))
    return (
        F.when(kind == "price_decrease", moved("lowered", "decrease")).when(kind == "price_increase", moved("raised", "increase"))
        .when(kind == "out_of_stock", F.concat(F.lit('"'), title, F.lit('" is now OUT OF STOCK at '), shop, F.lit(".")))
        .when(kind == "back_in_stock", F.concat(F.lit('"'), title, F.lit('" is BACK IN STOCK at '), shop, F.lit(".")))
        .otherwise(F.concat(F.lit('Change detected for "'), title, F.lit('" at '), shop, F.lit(".")))
    )


def overlap(a: Column, b: Column, least: int) -> Column:
    """The tokens of ``a`` that equal one of ``b`` or, with at least so many letters, hold one or are held by one."""
    near = lambda t: F.exists(b, lambda u: (u == t) | ((F.length(t) >= least) & (F.contains(u, t) | F.contains(t, u))))
    return F.filter(a, near)


def match_scores(rows: DataFrame, title: str, sku: str, vendor: str, shown: str, shown_sku: str, shown_vendor: str, url: str) -> DataFrame:
    """``rows`` with how a product and what a page shows agree, by the columns' names: title, sku, model,
    variant and vendor, and whether they are one product.

    Tokens are made once, as columns of their own, and dropped at the end.
    """
    with_digit = lambda tokens: F.filter(tokens, lambda t: t.rlike("[0-9]"))
    identity = F.concat_ws(" ", shown, url, shown_sku)
    tokens = {"_mine": title, "_theirs": shown, "_makers": vendor, "_seen": shown_vendor, "_linked": url}
    out = rows.withColumns({name: matching.title_tokens(F.col(c)) for name, c in tokens.items()} | {"_identity": matching.title_tokens(identity), "_models": model_tokens(F.col(title)), "_models_shown": model_tokens(identity)})
    out = out.withColumns({"_variants": with_digit(F.col("_mine")), "_variants_shown": F.array_distinct(with_digit(F.col("_identity")))})
    mine, makers, seen, variants = (F.col(c) for c in ("_mine", "_makers", "_seen", "_variants"))
    all_in = lambda c: (F.size(makers) > 0) & F.forall(makers, lambda t: F.array_contains(c, t))
    kept = F.size(overlap(variants, F.col("_variants_shown"), 3))
    out = out.withColumns({
        "title_similarity": matching.jaccard(mine, F.col("_theirs")), "sku_confidence": F.when(matching.equal_identifier(F.col(sku), F.col(shown_sku)), 1.0).otherwise(0.0),
        "model_exact": F.size(overlap(F.col("_models"), F.col("_models_shown"), 4)) > 0, "variant_similarity": F.when(F.size(variants) == 0, F.lit(1.0)).otherwise(kept / F.size(variants)),
        "_shared": F.arrays_overlap(makers, seen), "_titled": all_in(F.col("_theirs")),
    })
    unnamed, shared, titled = F.size(makers) == 0, F.col("_shared"), F.col("_titled")
    out = out.withColumns({"vendor_matches": unnamed | (F.size(seen) == 0) | shared | titled, "vendor_confirmed": unnamed | ((F.size(seen) > 0) & shared) | titled | all_in(F.col("_linked"))})
    same_sku, similar, model = F.col("sku_confidence") == 1, F.col("title_similarity"), F.col("model_exact")
    out = out.withColumns({
        "identity_strong": same_sku | (similar >= 0.82) | (model & F.col("vendor_confirmed")),
        "match_confidence": F.greatest(similar, F.col("sku_confidence"), F.when(model & F.col("vendor_matches"), 0.93).otherwise(0.0)),
    })
    out = out.withColumn("is_match", F.col("identity_strong") & (F.col("variant_similarity") == 1) & F.col("vendor_matches"))
    return out.drop(*(c for c in out.columns if c.startswith("_")))
