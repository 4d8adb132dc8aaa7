"""Every query with an oracle has DuckDB's rows."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

from pricewright.functions import text as texts
from pricewright.operators import catalog
from pricewright.operators.domain import Domain

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_rows(spark, name):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    frame = catalog.QUERIES[name](spark, DATA)
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    result = con.execute(catalog.ORACLE[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at[c]]) for c in names) for r in result.fetchall()), key=repr)
    assert got == want


def test_timeline_is_whole_and_latest_first(spark):
    rows = catalog.QUERIES["set_timeline"](spark, DATA).collect()
    whole = spark.read.parquet(f"{DATA}/lineitem.parquet").filter("l_quantity > 0").count() + spark.read.parquet(f"{DATA}/events.parquet").count()
    assert len(rows) == whole
    at = [r["happened_at"] for r in rows]
    assert at == sorted(at, reverse=True)


SECRETS = [
    ("Authorization: Basic dXNlcjpw", "Authorization: [REDACTED]"), ("a\nCookie: sid=1; b=2\nnext", "a\nCookie: [REDACTED]\nnext"), ("Set-Cookie: sid=9", "Set-Cookie: [REDACTED]"),
    ("bearer abc.def== x", "Bearer [REDACTED] x"), ('{"password": "x y"}', '{"password": "[REDACTED]"}'), ("'csrf':'q'", "'csrf':\"[REDACTED]\""), ('session = "s1"', 'session = "[REDACTED]"'),
    ("passwd=hunter2 on", "passwd=[REDACTED] on"), ('client_secret: "open', "client_secret: [REDACTED]"), ("api_key=[abc] z", "api_key=[REDACTED] z"),
    ("https://a.b/?key=k1&x=2&code=c3#f", "https://a.b/?key=[REDACTED]&x=2&code=[REDACTED]#f"), ("?auth=z&session=y", "?auth=[REDACTED]&session=[REDACTED]"),
    ('<input type="password" value="p">', '<input type="password" value="[REDACTED]">'), ("<input name='my_token' id=a value='t'>", "<input name='my_token' id=a value='[REDACTED]'>"),
    ("to jo@ex.org", "to [REDACTED_EMAIL]"), ("the secret garden; a cookie, a key", "the secret garden; a cookie, a key"), ("", ""), (None, None),
]


def test_redactions(spark):
    got = spark.createDataFrame(list(enumerate(s for s, _ in SECRETS)), "n int, s string").select("n", texts.redacted(F.col("s")).alias("r")).orderBy("n").collect()
    assert [r["r"] for r in got] == [want for _, want in SECRETS]
    con = duckdb.connect()
    for shown, want in SECRETS:
        assert con.execute(f"SELECT {catalog.SANITIZED} FROM (SELECT ?::VARCHAR AS text)", [shown]).fetchone()[0] == want


def test_completed_aggregates_cover_all_accounts(spark):
    """The counts that were missing are there, for every account, and not empty."""
    accounts = spark.read.parquet(f"{DATA}/part.parquet").selectExpr("p_partkey % 15 as user_id").distinct().count()
    wanted = {
        "agg_usage_6": ["products", "competitors", "competitor_matches", "monthly_changes", "alerts_monthly", "ai_runs_monthly"],
        "agg_competitor_stats": ["total", "products_tracked"], "agg_dashboard_stats": ["margin_protected_products"],
    }
    for name, columns in wanted.items():
        rows = catalog.QUERIES[name](spark, DATA).collect()
        assert len(rows) == accounts
        assert all(c in rows[0].asDict() for c in ["user_id", *columns])
    summary = catalog.QUERIES["agg_price_summary"](spark, DATA).collect()
    assert len(summary) == spark.read.parquet(f"{DATA}/part.parquet").count()
    assert all((r["observations"] > 0) == (r["avg_price"] > 0) and r["latest_recorded_at"] for r in summary)


def test_monthly_trend_has_every_month_of_the_table(spark):
    rows = catalog.QUERIES["agg_monthly_trend"](spark, DATA).collect()
    months = "SELECT l_partkey, date_trunc('month', l_shipdate)::TIMESTAMP, count(*) FROM '{}/lineitem.parquet' WHERE l_quantity > 0 GROUP BY 1, 2 ORDER BY 1, 2"
    assert [(r["product_id"], r["month"], r["n"]) for r in rows] == duckdb.sql(months.format(DATA)).fetchall()


def test_monthly_trend_of_few_rows(spark, tmp_path):
    """By hand: months long before the last, rows without a product or time at the end, as in the SQL, and a window where one is asked for."""
    sold = [
        (1, dt.datetime(1995, 3, 31, 23, 59, 59), 10.0, 10.0), (1, dt.datetime(1995, 3, 1), 40.0, 2.0), (1, dt.datetime(2000, 6, 14), 7.0, 1.0), (1, dt.datetime(2000, 6, 15), 8.0, 1.0),
        (2, dt.datetime(2001, 6, 15), 5.0, 1.0), (2, None, 3.0, 1.0), (None, dt.datetime(1996, 1, 2), 4.0, 1.0), (2, dt.datetime(1994, 1, 2), 9.0, 0.0),
    ]
    lines = [(n, part, 1, 1, quantity, price, "N", "O", at) for n, (part, at, price, quantity) in enumerate(sold)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    shown = lambda frame: [(r["product_id"], r["month"], r["n"], r["avg_price"], r["min_price"], r["max_price"]) for r in frame.collect()]
    whole = [
        (1, dt.datetime(1995, 3, 1), 2, 10.5, 1.0, 20.0), (1, dt.datetime(2000, 6, 1), 2, 7.5, 7.0, 8.0), (2, dt.datetime(2001, 6, 1), 1, 5.0, 5.0, 5.0), (2, None, 1, 3.0, 3.0, 3.0), (None, dt.datetime(1996, 1, 1), 1, 4.0, 4.0, 4.0),
    ]
    assert shown(catalog.QUERIES["agg_monthly_trend"](spark, str(tmp_path))) == whole
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for table in ("part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert con.execute(catalog.ORACLE["agg_monthly_trend"]).fetchall() == whole
    assert shown(catalog.agg_monthly_trend(Domain(spark, str(tmp_path)), months=12)) == [(1, dt.datetime(2000, 6, 1), 1, 8.0, 8.0, 8.0), (2, dt.datetime(2001, 6, 1), 1, 5.0, 5.0, 5.0)]
