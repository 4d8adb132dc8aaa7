"""Reduced pages: what stays, in which order, and how much."""

from pricewright.functions import reduction

LD = '<script type="application/ld+json">{"price": "149.99"}</script>'
PAGE = f"""<html><head><meta charset="utf-8"><META property="og:title" content="T"><style>
p {{ price: 1 }}</style>{LD}<script>var price = 3;
</script></head>
<nav>{"Menu " * 500}</nav>
<p>Only   <b>$5</b></p>
<p>Only <b>$5</b></p>
about us"""


def test_pages_are_reduced(spark):
    rows = [(1, PAGE, "{}"), (2, "one\n\ntwo", None), (3, None, "e"), (4, "", None), (5, "\n".join(f"line {n}" for n in range(99)), None), (6, LD.replace("149", "9" * 5000), None)]
    df = spark.createDataFrame(rows, "id long, html string, seen string")
    got = {r["id"]: r["short"] for r in reduction.with_reduced(df, "html", "short", 4000, "seen").collect()}
    assert got[1] == "\n".join(["DETERMINISTIC EVIDENCE\n{}", LD, '<META property="og:title" content="T">', '{"price": "149.99"}', "Only $5"])
    assert got[2] == "one\ntwo" and got[3] == "DETERMINISTIC EVIDENCE\ne" and got[4] == ""
    assert got[5].split("\n") == [f"line {n}" for n in range(40)]
    assert got[6].startswith(LD[:30]) and len(got[6]) <= 4000
    assert {r["short"] for r in reduction.with_reduced(df, "html", "short", 10).collect() if r["id"] == 1} == {LD[:10]}
