"""A page cut down to what tells of a product, for a reader with little room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages

# Parts that are kept as they are, parts that go, lines that matter, and how much of each.
STATED = r"""(?is)<script\b[^>]*type=["'](?:application/ld\+json|application/json)["'][^>]*>.*?</script>"""
OTHER_SCRIPT = r"""(?is)<script\b(?![^>]*type=["']application/(?:ld\+)?json)[^>]*>.*?</script>"""
STYLE = r"(?is)<style\b[^>]*>.*?</style>"
META = r"(?i)<meta\b[^>]*(?:product:|og:|price|currency|availability|sku|gtin)[^>]*>"
RELEVANT = (
    r"(?i)^#{1,3}\s|price|sale|was|now|compare|currency|availability|in stock|out of stock|shipping|subscription|installment|sku|barcode|gtin|model|variant|product"
    r"|[$€£¥]\s?[0-9]|\b[0-9][0-9.,]*\s?(?:USD|EUR|GBP|CAD|AUD|MAD|JPY|CHF)\b"
)
SCRIPT_CHARS, META_TAGS, PLAIN_LINES = 3_500, 30, 40


def with_reduced(rows: DataFrame, content: str, name: str, most: int, evidence: str | None = None) -> DataFrame:
    """``rows`` with at most ``most`` characters of their page: evidence (a column of text), if it is given,
    structured scripts, telling meta tags, and the relevant lines of text, or the first ones if none is.

    Equal parts stand once, in the order of their first.  A null page is reduced to its evidence;
    an empty one to an empty text.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(text, OTHER_SCRIPT, " "), STYLE, " ")
    plain = F.transform(F.split(visible, r"\r?\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), f"{pages.SPACES}+", " ")))
    tags = F.slice(F.regexp_extract_all(text, F.lit(META), F.lit(0)), 1, META_TAGS)
    out = rows.withColumns({
        "_scripts": F.transform(F.regexp_extract_all(text, F.lit(STATED), F.lit(0)), lambda s: F.left(s, F.lit(SCRIPT_CHARS))),
        "_meta": tags, "_lines": F.filter(plain, lambda s: s != ""),
    })
    out = out.withColumn("_telling", F.filter("_lines", lambda s: pages.found(s, RELEVANT)))
    first = F.array(F.concat(F.lit("DETERMINISTIC EVIDENCE\n"), F.col(evidence))) if evidence else F.array().cast("array<string>")
    meta = F.array(F.when(F.size("_meta") > 0, F.array_join("_meta", "\n")))
    body = F.when(F.size("_telling") > 0, F.col("_telling")).otherwise(F.slice("_lines", 1, PLAIN_LINES))
    parts = F.array_distinct(F.array_compact(F.concat(first, F.col("_scripts"), meta, body)))
    return out.withColumn(name, F.left(F.array_join(parts, "\n"), F.lit(most))).select(*rows.columns, name)
