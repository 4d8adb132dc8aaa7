"""Public addresses against the standard library's reading, range by range."""

import ipaddress
import random

from pricewright.functions import addresses

OTHER = [ipaddress.ip_network(n) for n in ("::/127", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32")]


def public(text):
    try:
        a = ipaddress.ip_address(text.removeprefix("[").removesuffix("]"))
    except ValueError:
        return False
    if a.version == 6 and a.ipv4_mapped is not None:
        a = a.ipv4_mapped
    nets = OTHER if a.version == 6 else [ipaddress.ip_network(f"{first}/{bits}") for first, bits in addresses.PRIVATE]
    return not any(a in n for n in nets)


def test_public_addresses(spark):
    rng = random.Random(5)
    texts = ["", "x", "1.2.3", "1.2.3.256", "01.2.3.4", "::", "::1", "0:0:0:0:0:0:0:1", "[::1]", ":::", "1::2::3", "::ffff:10.0.0.1", "::FFFF:808:808", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::8:7", ":1::", "1:", "fe80::1", "febf::", "fec0::1", "2001:db8::1", "2001:db9::1", "64:ff9b::8.8.8.8", "12345::", "8.8.8.8", "[2606:4700::1]"]
    for first, bits in addresses.PRIVATE:
        net = ipaddress.ip_network(f"{first}/{bits}")
        texts += [str(a) for edge in (net[0], net[-1]) for a in (edge, edge - 1 if int(edge) else edge, edge + 1 if int(edge) < 2**32 - 1 else edge)]
    for _ in range(300):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, (2**64 - 1) << 64, 0xFFFF << 112 | 0xFFFF]))
        texts += [str(a), a.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32))), f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}"]
    rows = addresses.with_public(spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, address string"), "address", "p")
    got = {r["id"]: r["p"] for r in rows.collect()}
    assert got.pop(-1) is None
    assert {texts[i]: p for i, p in got.items()} == {t: public(t) for t in texts}
