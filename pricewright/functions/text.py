"""Text and URL expressions: normal forms, redaction, hashes, domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking parameters that a listing's address is freed of; fixed values.
TRACKING = ("fbclid", "gclid", "ref", "ref_")


#: ASCII white space.
SPACE = r"[ \t\n\x0B\f\r]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind, not only spaces, at the ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), f"{SPACE}+", " ")


def normal_sku(c: Column) -> Column:
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def content_hash(c: Column) -> Column:
    """SHA-256 after CRLF becomes LF and runs of spaces and tabs one space."""
    return F.sha2(trimmed(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "[ \t]+", " ")), 256)


#: What is redacted, in this order: headers, bearer tokens, quoted and bare values of secret keys,
#: query parameters, values of password and token fields, email addresses.
REDACTIONS = (
    (r"(?i)(^|[^a-z0-9_])((?:authorization|cookie|set-cookie)[ \t\r\n]*:)[ \t\r\n]*[^\r\n]+", "$1$2 [REDACTED]"),
    (r"(?i)bearer[ \t\r\n]+[a-z0-9._~+/-]+=*", "Bearer [REDACTED]"),
    (r"""(?i)((?:api[_-]?key|passwd|password|secret|token|session|csrf)["']?[ \t\r\n]*[:=][ \t\r\n]*)["'][^"']*["']""", '$1"[REDACTED]"'),
    (r"""(?i)((?:api[_-]?key|passwd|password|secret|token|session|csrf)["']? *[:=] *)["']?(?:[^ \n,;&"'\[]|\[[^R \n]|\[R[^E \n])[^ \n,;&]*""", "$1[REDACTED]"),
    (r"""(?i)([?&](?:token|key|secret|password|session|auth|code)=)[^&# \t\r\n"']+""", "$1[REDACTED]"),
    (
        r"""(?i)(<input[^a-z0-9_>](?:[^>]*[^a-z0-9_>])?(?:type=["']password["']|name=["'][^"']*(?:token|secret|password|session)[^"']*["'])(?:[^>]*[^a-z0-9_>])?value=["'])[^"']*(["'])""",
        "$1[REDACTED]$2",
    ),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
)


def redacted(c: Column) -> Column:
    """Secrets in headers, key and value pairs, addresses and input fields, and email addresses replaced."""
    for pattern, by in REDACTIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def host_of(url: Column) -> Column:
    """The host in lower case without a leading www; null if the address can't be read."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _part(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, "PROTOCOL"))


def plain_host(url: Column) -> Column:
    """The host in lower case without a closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(_part(url, "HOST")), r"\.$", "")


def port_of(url: Column) -> Column:
    """A colon and the port, unless it is the scheme's own."""
    port = F.regexp_extract(_part(url, "AUTHORITY"), r"(:[0-9]+)$", 1)
    return F.when(port == F.when(scheme_of(url) == "http", ":80").otherwise(":443"), "").otherwise(port)


def web_address(url: Column) -> Column:
    """Whether it is an http or https address with a host."""
    return scheme_of(url).isin("http", "https") & (plain_host(url) != "")


def listing_url(url: Column) -> Column:
    """A listing's address: scheme, host without www, port, path without closing slashes, and sorted
    parameters other than tracking ones, in any case; null with credentials or another scheme."""
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(_part(url, "QUERY"), "&"), lambda p: (p != "") & ~F.lower(name(p)).isin(*TRACKING) & ~F.lower(name(p)).startswith("utm_"))
    path = F.coalesce(F.nullif(F.regexp_replace(_part(url, "PATH"), "/+$", ""), F.lit("")), F.lit("/"))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(name(p).alias("n"), p.alias("p"))))
    tail = F.array_join(F.transform(ordered, lambda x: x.p), "&")
    whole = F.concat(scheme_of(url), F.lit("://"), F.regexp_replace(plain_host(url), r"^www\.", ""), port_of(url), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(web_address(url) & ~F.contains(_part(url, "AUTHORITY"), F.lit("@")), whole)


def shop_domain(given: Column) -> Column:
    """The host of a shop's address or bare domain, without www; null if it is no http address or has credentials."""
    url = trimmed(given)
    url = F.when(url.rlike(r"(?i)^[a-z][a-z\d+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(web_address(url) & ~F.contains(_part(url, "AUTHORITY"), F.lit("@")), F.regexp_replace(plain_host(url), r"^www\.", ""))


def source_url(url: Column) -> Column:
    """The address without credentials, parameters and fragment."""
    path = F.coalesce(F.nullif(_part(url, "PATH"), F.lit("")), F.lit("/"))
    return F.when(plain_host(url) != "", F.concat(scheme_of(url), F.lit("://"), F.lower(_part(url, "HOST")), port_of(url), path))
