"""Sanitized trees at their limits, and texts beyond ASCII."""

from pyspark.sql import functions as F

from pricewright.functions import matching, structured


def nested(depth, leaf):
    for _ in range(depth):
        leaf = {"x": leaf}
    return leaf


def test_depth_and_items():
    assert structured.sanitized(nested(6, 1)) == nested(6, 1)
    assert structured.sanitized(nested(7, 1)) == nested(7, structured.CUT)
    assert structured.sanitized(list(range(100))) == list(range(100)) and len(structured.sanitized(list(range(101)))) == 100
    assert len(structured.sanitized({str(n): n for n in range(101)})) == 100
    assert structured.sanitized({"API_KEY": {"a": 1}, "apikeys": "k", "t": "bearer abc.def", "n": None, "b": True}) == {"API_KEY": "[REDACTED]", "apikeys": "k", "t": "Bearer [REDACTED]", "n": None, "b": True}
    assert len(structured.sanitized("y" * 2001)) == 2000


def test_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, '{"secret": 1}', "p"), (2, "no json", "q"), (3, None, "r"), (4, "[" * 9000, "s")], "id long, tree string, other string")
    got = {r["id"]: (r["tree"], r["other"]) for r in structured.sanitized_json(rows, "tree").collect()}
    assert got == {1: ('{"secret":"[REDACTED]"}', "p"), 2: (None, "q"), 3: (None, "r"), 4: (None, "s")}
    assert structured.sanitized_json(rows.limit(0), "tree").count() == 0


def test_normal_forms(spark):
    rows = spark.createDataFrame([(1, "Café ÉLAN ﬁx"), (2, "plain Text"), (3, None), (4, "ＡＢ１２")], "id long, t string")
    got = {r["id"]: (r["a"], r["b"]) for r in rows.select("id", matching.title_tokens(matching.decomposed(F.col("t"))).alias("a"), matching.comparable(F.col("t")).alias("b")).collect()}
    assert got == {1: (["cafe", "lan", "fix"], "caf lan fix"), 2: (["plain", "text"], "plain text"), 3: ([], ""), 4: (["ab12"], "ab12")}
