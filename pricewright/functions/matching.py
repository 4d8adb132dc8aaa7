"""Price text, identifiers, tokens and search results: expressions for matching listings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_host, port_of, scheme_of, web_address

# Fixed values.
TITLE_STOP_WORDS = ("the", "and", "with", "for")
SEARCH_STOP_WORDS = ("and", "for", "the", "with", "wireless", "portable", "bluetooth", "headphones", "speaker", "camera", "product")
EXCLUDED_HOSTS = (
    "youtube.com", "m.youtube.com", "reddit.com", "facebook.com", "instagram.com", "twitter.com",
    "x.com", "pinterest.com", "tiktok.com", "wikipedia.org", "quora.com", "medium.com",
)


def parsed_price(c: Column) -> Column:
    """The amount in a price text, null unless above 0.

    Of a dot and a comma the later one is the decimal mark, which may stand once only; a lone comma
    is one before two closing digits and else groups thousands; of several dots alone the last is
    the decimal mark.
    """
    kept = F.regexp_replace(c, r"[^0-9.,-]", "")
    both = F.contains(kept, F.lit(".")) & F.contains(kept, F.lit(","))
    comma_last = F.instr(F.reverse(kept), ",") < F.instr(F.reverse(kept), ".")
    no_commas = F.replace(kept, F.lit(","), F.lit(""))
    european = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        F.when(both & comma_last, european)
        .when(~both & kept.rlike(r"^[^,]*,\d{2}$"), F.replace(kept, F.lit(","), F.lit(".")))
        .when(both, no_commas)
        .otherwise(F.regexp_replace(no_commas, r"\.(?=.*\.)", ""))
    )
    value = plain.try_cast("double")
    return F.when(value > 0, value)


def equal_identifier(a: Column, b: Column) -> Column:
    """Equal but for case and signs; false if either has no letter or digit."""
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")


def normal_form(c: Column, form: str) -> Column:
    """A Unicode normal form; only texts beyond ASCII leave the JVM for it."""

    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.coalesce(normalised(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def decomposed(c: Column) -> Column:
    """In lower case, with letters and their accents apart, as tokens are made of."""
    return normal_form(F.lower(c), "NFKD")


def comparable(c: Column) -> Column:
    """A text for comparison: compatible forms, lower case, and single spaces for all but ASCII letters and digits."""
    return F.trim(F.regexp_replace(F.lower(normal_form(F.coalesce(c, F.lit("")), "NFKC")), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    """Words of ASCII letters and digits, of two characters or more, without stop words."""
    return F.filter(_words(c), lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOP_WORDS))


def search_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(_words(c), lambda t: (F.length(t) > 1) & ~t.isin(*SEARCH_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays as sets; 0 if either is empty."""
    shared, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / all_).otherwise(F.lit(0.0))


def excluded_host(host: Column) -> Column:
    """Hosts, and their subdomains, that are never competitors."""
    hit = host.isin(*EXCLUDED_HOSTS)
    for excluded in EXCLUDED_HOSTS:
        hit |= host.endswith("." + excluded)
    return F.coalesce(hit, F.lit(False))


def identity_hits(wanted: Column, haystack: Column, most: int = 5) -> Column:
    """How many of the wanted tokens the text has, at most ``most``."""
    return F.least(F.size(F.filter(wanted, lambda t: F.contains(F.lower(haystack), t))), F.lit(most))


def site_base(url: Column) -> Column:
    """Scheme, host, port and path without credentials, parameters, fragment and closing slashes."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(web_address(url), F.concat(scheme_of(url), F.lit("://"), plain_host(url), port_of(url), path))
