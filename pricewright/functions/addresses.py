"""Network addresses: whether one is public, by its 16-bit groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
# Ranges of 32 bits that aren't public, by first address and bits of the network.
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 16),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def whole_number(v4: Column) -> Column:
    """The 32 bits of a dotted address."""
    parts = F.transform(F.split(v4, r"\."), lambda p: p.try_cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total * 256 + p)


def private_number(n: Column) -> Column:
    hit = F.lit(False)
    for first, bits in PRIVATE:
        begin = sum(int(part) << shift for part, shift in zip(first.split("."), (24, 16, 8, 0), strict=True))
        hit |= n.between(begin, begin + (1 << (32 - bits)) - 1)
    return hit


def with_public(rows: DataFrame, address: str, name: str) -> DataFrame:
    """``rows`` with whether each has an address that anyone may be sent to: of version 4, or 6 in any
    spelling, brackets included; mapped ones go by their 32 bits.

    What isn't an address is not public; null stays null.  The eight groups of an address of
    version 6 are made step by step, as columns that are dropped at the end.
    """
    half = lambda x: F.lower(F.hex(x.cast("long")))
    side = lambda k: F.filter(F.split(F.coalesce(F.get("_sides", F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    out = rows.withColumn("_plain", F.regexp_replace(F.lower(address), r"^\[|\]$", ""))
    out = out.withColumn("_dotted", F.regexp_extract("_plain", f"(?:^|:)({V4})$", 1))
    out = out.withColumn("_bits", F.when(F.col("_dotted") != "", whole_number(F.col("_dotted"))))
    ending = F.concat_ws(":", half(F.floor(F.col("_bits") / 65536)), half(F.col("_bits") % 65536))
    head = F.left("_plain", F.length("_plain") - F.length("_dotted"))
    out = out.withColumn("_hex", F.when(F.col("_bits").isNotNull(), F.concat(head, ending)).otherwise(F.col("_plain")))
    out = out.withColumn("_sides", F.split("_hex", "::")).withColumns({"_left": side(0), "_right": side(1)})
    out = out.withColumn("_missing", 8 - F.size("_left") - F.size("_right"))
    out = out.withColumn("_whole", F.concat("_left", F.array_repeat(F.lit("0"), F.greatest("_missing", F.lit(0))), "_right"))
    # No single colon at an end, none of three, at most one gap, and a gap stands for a group at least.
    formed = F.col("_hex").rlike("^(?:[0-9a-f]{1,4}|:)[0-9a-f:]*$") & ~F.col("_hex").rlike("^:[^:]|[^:]:$|:::") & F.forall("_whole", lambda g: F.length(g) <= 4)
    sized = F.when(F.size("_sides") == 2, F.col("_missing") >= 1).when(F.size("_sides") == 1, F.col("_missing") == 0).otherwise(False)
    out = out.withColumn("_groups", F.when(formed & sized, F.transform("_whole", lambda g: F.conv(g, 16, 10).cast("long"))))
    out = out.withColumns({f"_g{k}": F.get("_groups", F.lit(k)) for k in (0, 1, 5, 6, 7)})
    zeros = lambda n: F.forall(F.slice("_groups", 1, n), lambda x: x == 0)
    four, mapped = F.col("_plain").rlike(f"^{V4}$"), zeros(5) & (F.col("_g5") == 0xFFFF)
    out = out.withColumn("_number", F.when(four, F.col("_bits")).when(mapped, F.col("_g6") * 65536 + F.col("_g7")))
    first = F.col("_g0")
    private = (
        (zeros(7) & (F.col("_g7") <= 1)) | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF) | (first >= 0xFF00) | ((first == 0x2001) & (F.col("_g1") == 0xDB8))
    )
    verdict = F.when(F.col("_number").isNotNull(), ~private_number(F.col("_number"))).when(F.col("_groups").isNotNull(), ~private).when(F.col(address).isNotNull(), False)
    return out.withColumn(name, verdict).select(*rows.columns, name)
