"""Boards of alerts, recommendations, runs and activity: filters, folds, windows, top lists.

The tables have none of these, so they are derived, here and in the oracle's SQL alike: alerts and
activity from events, recommendations from orders, extraction runs from line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import writes
from .catalog import query
from .domain import Domain

BOARDS = """WITH alerts AS (SELECT event_id AS alert_id, user_id, event_type AS title, CASE WHEN event_type = 'error' THEN 'critical' WHEN json_extract_string(props, '$.k')::INT >= 50 THEN 'high' ELSE 'low' END AS severity,
    event_id % 3 = 0 AS is_read, event_id % 4 = 0 AS is_resolved, ts AS created_at FROM events),
  recs AS (SELECT o_orderkey AS rec_id, o_custkey % 15 AS user_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
    50 + o_orderkey % 50 AS confidence, floor(o_totalprice * 100 + 0.5::DOUBLE)::BIGINT AS savings_cents, o_orderdate AS created_at FROM orders),
  runs AS (SELECT l_orderkey * 8 + l_linenumber AS run_id, 'shop' || (l_suppkey % 20)::VARCHAR AS domain, 'p' || (l_orderkey % 3)::VARCHAR AS platform, 'v' || (l_linenumber % 3)::VARCHAR AS version, l_partkey AS product_id, l_suppkey AS competitor_id,
    l_returnflag <> 'A' AS resolved, l_linestatus = 'O' AS fallback, l_linestatus = 'O' AND l_returnflag = 'R' AS model_failed, l_orderkey % 100 AS confidence, l_linenumber::BIGINT AS occurrences,
    CASE l_orderkey % 4 WHEN 0 THEN ['missing_price'] WHEN 1 THEN ['missing_price', 'low_confidence'] WHEN 3 THEN ['variant_ambiguity'] END AS reasons,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_partkey * 10 END AS chars_before, CASE WHEN l_orderkey % 7 <> 0 THEN l_partkey * 3 END AS chars_after, l_shipdate AS ran_at FROM lineitem)
"""


def boards(sql: str):
    return query(BOARDS + sql, domain=False)


def alerts(d: Domain) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    severity = F.when(F.col("event_type") == "error", "critical").when(k >= 50, "high").otherwise("low")
    return d.table("events").select(
        F.col("event_id").alias("alert_id"), "user_id", F.col("event_type").alias("title"), severity.alias("severity"),
        (F.col("event_id") % 3 == 0).alias("is_read"), (F.col("event_id") % 4 == 0).alias("is_resolved"), F.col("ts").alias("created_at"),
    )


def recommendations(d: Domain) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return d.table("orders").select(
        F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey") % 15).alias("user_id"), "o_custkey", status.alias("status"), (F.col("o_orderkey") % 50 + 50).alias("confidence"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("savings_cents"), F.col("o_orderdate").alias("created_at"),
    )


def runs(d: Domain) -> DataFrame:
    key, fallback = F.col("l_orderkey"), F.col("l_linestatus") == "O"
    reasons = F.when(key % 4 == 0, F.array(F.lit("missing_price"))).when(key % 4 == 1, F.array(F.lit("missing_price"), F.lit("low_confidence"))).when(key % 4 == 3, F.array(F.lit("variant_ambiguity")))
    return d.table("lineitem").select(
        (key * 8 + F.col("l_linenumber")).alias("run_id"), F.concat(F.lit("shop"), (F.col("l_suppkey") % 20).cast("string")).alias("domain"), F.concat(F.lit("p"), (key % 3).cast("string")).alias("platform"),
        F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("version"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("competitor_id"),
        (F.col("l_returnflag") != "A").alias("resolved"), fallback.alias("fallback"), (fallback & (F.col("l_returnflag") == "R")).alias("model_failed"), (key % 100).alias("confidence"),
        F.col("l_linenumber").cast("long").alias("occurrences"), reasons.alias("reasons"), F.when(key % 5 != 0, F.col("l_partkey") * 10).alias("chars_before"),
        F.when(key % 7 != 0, F.col("l_partkey") * 3).alias("chars_after"), F.col("l_shipdate").alias("ran_at"),
    )


def rate(part: Column, whole: Column) -> Column:
    """A share of at least one."""
    return part / F.greatest(whole, F.lit(1))


# ------------------------------------------------------------------------------- filters


@boards("SELECT alert_id, severity FROM alerts WHERE created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 24 HOUR")
def flt_since_24h(d: Domain) -> DataFrame:
    """Alerts of the 24 hours up to the last one."""
    now = alerts(d).agg(F.max("created_at").alias("now"))
    return alerts(d).crossJoin(F.broadcast(now)).filter(F.col("created_at") >= F.col("now") - F.expr("interval 24 hours")).select("alert_id", "severity")


@boards("SELECT alert_id, title FROM alerts WHERE title LIKE 'e%' AND severity IN ('critical', 'high') AND NOT is_resolved")
def flt_like_prefix(d: Domain) -> DataFrame:
    return alerts(d).filter(F.col("title").startswith("e") & F.col("severity").isin("critical", "high") & ~F.col("is_resolved")).select("alert_id", "title")


@boards("SELECT rec_id, status FROM recs WHERE status IN ('accepted', 'rejected') AND confidence >= 90")
def flt_in_list(d: Domain) -> DataFrame:
    return recommendations(d).filter(F.col("status").isin("accepted", "rejected") & (F.col("confidence") >= 90)).select("rec_id", "status")


@boards("SELECT run_id, chars_before FROM runs WHERE chars_before IS NOT NULL AND reasons IS NULL")
def flt_not_null(d: Domain) -> DataFrame:
    return runs(d).filter("chars_before is not null and reasons is null").select("run_id", "chars_before")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = lower('Building')", domain=False)
def flt_lower_email(d: Domain) -> DataFrame:
    """Equal but for case."""
    return d.table("customer").filter(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey", "c_name")


@query(r"SELECT product_id, title FROM products WHERE lower(regexp_replace(category, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) = 'standard polished tin'")
def flt_expr_eq(d: Domain) -> DataFrame:
    """The column's ends are trimmed but its inner white space stays."""
    return d.products.filter(F.lower(F.regexp_replace("category", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) == "standard polished tin").select("product_id", "title")


@boards("SELECT alert_id FROM alerts WHERE (title ILIKE '%o%' OR severity ILIKE '%o%') AND NOT is_resolved AND severity = 'low'")
def flt_alerts_ui(d: Domain) -> DataFrame:
    """A text and a tab."""
    return alerts(d).filter((F.col("title").ilike("%o%") | F.col("severity").ilike("%o%")) & ~F.col("is_resolved") & (F.col("severity") == "low")).select("alert_id")


@query("SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) WHERE json_extract_string(props, '$.k')::INT % 2 = 0", domain=False)
def flt_json_client(d: Domain) -> DataFrame:
    """The newest 20 first, then the filter."""
    newest = d.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return newest.filter(F.get_json_object("props", "$.k").cast("int") % 2 == 0).select("event_id")


@boards("SELECT rec_id FROM recs WHERE status = 'pending' AND created_at + INTERVAL 7 DAY > TIMESTAMP '1998-07-01'")
def flt_token_valid(d: Domain) -> DataFrame:
    """Unused and not expired at a given time."""
    return recommendations(d).filter((F.col("status") == "pending") & (F.col("created_at") + F.expr("interval 7 days") > F.expr("timestamp_ntz'1998-07-01'"))).select("rec_id")


@query("SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' ELSE 'free' END AS plan, CASE user_id % 4 WHEN 1 THEN 100 WHEN 2 THEN NULL ELSE 10 END AS product_limit FROM (SELECT DISTINCT user_id FROM products)")
def prj_plan_lookup(d: Domain) -> DataFrame:
    """A small table of plans; an unknown plan is the free one."""
    plans = d.spark.createDataFrame([("free", 10), ("starter", 100), ("pro", None)], "plan string, product_limit int")
    asked = F.element_at(F.array(*(F.lit(p) for p in ("free", "starter", "pro", "gone"))), (F.col("user_id") % 4 + 1).cast("int"))
    users = d.products.select("user_id").distinct().withColumn("asked", asked)
    known = users.join(F.broadcast(plans.select(F.col("plan").alias("known"))), F.col("asked") == F.col("known"), "left")
    return known.select("user_id", F.coalesce("known", F.lit("free")).alias("plan")).join(F.broadcast(plans), "plan").select("user_id", "plan", "product_limit")


# ------------------------------------------------------------------------------- folds


@boards("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT is_read) AS unread, count(*) FILTER (WHERE severity = 'critical' AND NOT is_resolved) AS critical, count(*) FILTER (WHERE is_resolved) AS resolved FROM alerts GROUP BY 1""")
def agg_alert_stats(d: Domain) -> DataFrame:
    critical = (F.col("severity") == "critical") & ~F.col("is_resolved")
    return alerts(d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(critical).alias("critical"), F.count_if("is_resolved").alias("resolved"))


@boards("""SELECT user_id, sum(n)::BIGINT AS total, max(n) FILTER (WHERE status = 'pending') AS pending, max(n) FILTER (WHERE status = 'accepted') AS accepted, max(n) FILTER (WHERE status = 'rejected') AS rejected, max(c) AS avg_confidence, sum(s)::BIGINT AS savings_cents
  FROM (SELECT user_id, status, count(*) AS n, sum(confidence)::DOUBLE / count(*) AS c, sum(savings_cents) AS s FROM recs GROUP BY 1, 2) GROUP BY 1""")
def agg_rec_stats(d: Domain) -> DataFrame:
    """Groups by status first; the average shown is the highest of the groups'."""
    groups = recommendations(d).groupBy("user_id", "status").agg(F.count("*").alias("n"), (F.sum("confidence").cast("double") / F.count("*")).alias("c"), F.sum("savings_cents").alias("s"))
    states = (F.max(F.when(F.col("status") == s, F.col("n"))).alias(s) for s in ("pending", "accepted", "rejected"))
    return groups.groupBy("user_id").agg(F.sum("n").alias("total"), *states, F.max("c").alias("avg_confidence"), F.sum("s").alias("savings_cents"))


@query("SELECT count(*)::INT AS n FROM products WHERE is_tracked")
def agg_count(d: Domain) -> DataFrame:
    return d.products.filter("is_tracked").agg(F.count("*").cast("int").alias("n"))


@query("SELECT competitor_id, count(*) AS n FROM links WHERE match_method IS NULL OR match_method <> 'auto-generated' GROUP BY 1")
def agg_merged_counts(d: Domain) -> DataFrame:
    return d.links.filter(~F.col("match_method").eqNullSafe("auto-generated")).groupBy("competitor_id").agg(F.count("*").alias("n"))


RATES = """count(*) AS total, count(*) FILTER (WHERE resolved) / greatest(1, count(*))::DOUBLE AS resolved_rate, count(*) FILTER (WHERE fallback) / greatest(1, count(*))::DOUBLE AS fallback_rate,
  count(*) FILTER (WHERE model_failed) / greatest(1, count(*) FILTER (WHERE fallback))::DOUBLE AS model_failure_rate, sum(confidence) / greatest(1, count(*))::DOUBLE AS avg_confidence,
  (sum(chars_before) FILTER (WHERE chars_after IS NOT NULL)) / greatest(1, count(*) FILTER (WHERE chars_before IS NOT NULL AND chars_after IS NOT NULL))::DOUBLE AS avg_chars_before,
  (sum(chars_after) FILTER (WHERE chars_before IS NOT NULL)) / greatest(1, count(*) FILTER (WHERE chars_before IS NOT NULL AND chars_after IS NOT NULL))::DOUBLE AS avg_chars_after"""


@boards(f"SELECT domain, platform, version, {RATES} FROM runs GROUP BY GROUPING SETS ((domain, platform, version), ())")
def agg_extraction_metrics(d: Domain) -> DataFrame:
    """Overall and by site, in one pass: shares with denominators of at least one, lengths over runs that have both."""
    n, both = F.count("*"), F.col("chars_before").isNotNull() & F.col("chars_after").isNotNull()
    mean = lambda c: F.sum(F.when(both, F.col(c))) / F.greatest(F.count_if(both), F.lit(1))
    return runs(d).groupingSets([["domain", "platform", "version"], []], "domain", "platform", "version").agg(
        n.alias("total"), rate(F.count_if("resolved"), n).alias("resolved_rate"), rate(F.count_if("fallback"), n).alias("fallback_rate"),
        rate(F.count_if("model_failed"), F.count_if("fallback")).alias("model_failure_rate"), rate(F.sum("confidence"), n).alias("avg_confidence"),
        mean("chars_before").alias("avg_chars_before"), mean("chars_after").alias("avg_chars_after"),
    )


@boards("SELECT reason, sum(occurrences)::BIGINT AS occurrences FROM (SELECT unnest(coalesce(reasons, ['unknown'])) AS reason, occurrences FROM runs) GROUP BY 1")
def agg_failure_reasons(d: Domain) -> DataFrame:
    """No list of reasons counts as unknown."""
    reasons = F.explode(F.coalesce("reasons", F.array(F.lit("unknown")))).alias("reason")
    return runs(d).select(reasons, "occurrences").groupBy("reason").agg(F.sum("occurrences").alias("occurrences"))


@boards("SELECT version, count(*) AS fixtures, count(*) FILTER (WHERE model_failed) AS false_positives, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE model_failed) / count(*)::DOUBLE END AS false_positive_rate FROM runs WHERE fallback GROUP BY 1")
def agg_false_positive(d: Domain) -> DataFrame:
    wrong = F.count_if("model_failed")
    return runs(d).filter("fallback").groupBy("version").agg(F.count("*").alias("fixtures"), wrong.alias("false_positives"), F.try_divide(wrong, F.count("*")).alias("false_positive_rate"))


CLUSTERS = """, failures AS (SELECT run_id, domain, platform, unnest(reasons) AS reason, occurrences, confidence FROM runs WHERE reasons IS NOT NULL),
  sized AS (SELECT domain, platform, reason, sum(occurrences)::BIGINT AS occurrences FROM failures GROUP BY 1, 2, 3 HAVING sum(occurrences) >= 20),
  worst AS (SELECT domain, platform, reason, list(run_id ORDER BY confidence, run_id) AS representatives FROM (SELECT *, row_number() OVER (PARTITION BY domain, platform, reason ORDER BY confidence, run_id) AS r FROM failures) WHERE r <= 3 GROUP BY 1, 2, 3)
  SELECT sha256(concat_ws('|', s.domain, s.platform, s.reason)) AS cluster_key, s.domain, s.platform, s.reason, occurrences, array_to_string(representatives, ',') AS representatives
  FROM sized s JOIN worst w ON w.domain = s.domain AND w.platform = s.platform AND w.reason = s.reason"""


@boards(CLUSTERS)
def agg_failure_cluster(d: Domain) -> DataFrame:
    """Failures by site and reason that recur, each with its three least confident runs."""
    by = ["domain", "platform", "reason"]
    failures = runs(d).select("run_id", "domain", "platform", F.explode("reasons").alias("reason"), "occurrences", "confidence")
    sized = failures.groupBy(*by).agg(F.sum("occurrences").alias("occurrences")).filter("occurrences >= 20")
    ranked = failures.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("confidence", "run_id"))).filter("r <= 3")
    worst = ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "run_id"))), lambda x: x.run_id.cast("string")), ",").alias("representatives"))
    return sized.join(worst, by).select(F.sha2(F.concat_ws("|", *by), 256).alias("cluster_key"), *by, "occurrences", "representatives")


EVALUATED = """, evaluated AS (SELECT run_id % 4000 AS fixture_id, version, bool_or(resolved) AS resolved, bool_or(resolved AND confidence >= 50) AS correct, bool_or(model_failed) AS wrong FROM runs GROUP BY 1, 2)
"""


def _evaluated(d: Domain) -> DataFrame:
    sure = F.col("resolved") & (F.col("confidence") >= 50)
    return runs(d).groupBy((F.col("run_id") % 4000).alias("fixture_id"), "version").agg(F.bool_or("resolved").alias("resolved"), F.bool_or(sure).alias("correct"), F.bool_or("model_failed").alias("wrong"))


@boards(EVALUATED + "SELECT version, count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT resolved) AS unresolved, count(*) FILTER (WHERE wrong) AS false_positives FROM evaluated GROUP BY 1")
def agg_eval(d: Domain) -> DataFrame:
    rows = _evaluated(d).groupBy("version")
    return rows.agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.count_if("correct").alias("correct"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if("wrong").alias("false_positives"))


@boards(EVALUATED + """, compared AS (SELECT b.correct AS was, c.correct AS now, c.wrong FROM evaluated b JOIN evaluated c ON c.fixture_id = b.fixture_id WHERE b.version = 'v0' AND c.version = 'v1')
  SELECT count(*) FILTER (WHERE now AND NOT was) AS improved, count(*) FILTER (WHERE was AND NOT now) AS regressed, count(*) FILTER (WHERE was = now) AS unchanged,
  CASE WHEN count(*) FILTER (WHERE was AND NOT now) = 0 AND count(*) FILTER (WHERE now AND NOT was) > 0 AND count(*) FILTER (WHERE wrong) = 0 THEN 'APPROVE' ELSE 'REJECT' END AS decision FROM compared""")
def agg_eval_compare(d: Domain) -> DataFrame:
    """Two versions on the same fixtures; any regression or false positive rejects."""
    base = _evaluated(d).filter("version = 'v0'").select("fixture_id", F.col("correct").alias("was"))
    new = _evaluated(d).filter("version = 'v1'").select("fixture_id", F.col("correct").alias("now"), "wrong")
    was, now = F.col("was"), F.col("now")
    counts = base.join(new, "fixture_id").agg(F.count_if(now & ~was).alias("improved"), F.count_if(was & ~now).alias("regressed"), F.count_if(was == now).alias("unchanged"), F.count_if("wrong").alias("wrong"))
    good = (F.col("regressed") == 0) & (F.col("improved") > 0) & (F.col("wrong") == 0)
    return counts.select("improved", "regressed", "unchanged", F.when(good, "APPROVE").otherwise("REJECT").alias("decision"))


@boards(EVALUATED + "SELECT b.fixture_id, b.correct AS was, c.correct AS now FROM evaluated b JOIN evaluated c ON c.fixture_id = b.fixture_id WHERE b.version = 'v0' AND c.version = 'v2'")
def contains_dedupe(d: Domain) -> DataFrame:
    base = _evaluated(d).filter("version = 'v0'").select("fixture_id", F.col("correct").alias("was"))
    return base.join(_evaluated(d).filter("version = 'v2'").select("fixture_id", F.col("correct").alias("now")), "fixture_id")


@boards("""SELECT domain, count(*) AS discovered, count(*) FILTER (WHERE resolved) AS matched, count(*) FILTER (WHERE confidence >= 80 AND resolved) AS recommended, count(*) - count(*) FILTER (WHERE resolved) + count(*) FILTER (WHERE model_failed) AS failed FROM runs GROUP BY 1""")
def agg_run_totals(d: Domain) -> DataFrame:
    n, matched = F.count("*"), F.count_if("resolved")
    return runs(d).groupBy("domain").agg(n.alias("discovered"), matched.alias("matched"), F.count_if(F.col("resolved") & (F.col("confidence") >= 80)).alias("recommended"), (n - matched + F.count_if("model_failed")).alias("failed"))


@boards("SELECT domain, count(*) FILTER (WHERE ran_at >= TIMESTAMP '1996-01-01') - count(*) FILTER (WHERE ran_at < TIMESTAMP '1996-01-01') AS delta FROM runs GROUP BY 1")
def agg_metric_delta(d: Domain) -> DataFrame:
    later = F.col("ran_at") >= F.expr("timestamp_ntz'1996-01-01'")
    return runs(d).groupBy("domain").agg((F.count_if(later) - F.count_if(~later)).alias("delta"))


@query("SELECT product_id, array_to_string(list_sort(list(competitor_id)), ',') AS competitors FROM links WHERE is_active GROUP BY 1")
def agg_group_collect(d: Domain) -> DataFrame:
    """A product's links are as many as its sellers."""
    return d.links.filter("is_active").groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("competitor_id")), lambda x: x.cast("string")), ",").alias("competitors"))


@boards("SELECT count(DISTINCT title) AS n FROM (SELECT title FROM alerts WHERE is_resolved ORDER BY created_at DESC, alert_id DESC LIMIT 40)")
def agg_done_ids(d: Domain) -> DataFrame:
    return alerts(d).filter("is_resolved").orderBy(F.desc("created_at"), F.desc("alert_id")).limit(40).agg(F.count_distinct("title").alias("n"))


@query("""SELECT p.product_id, coalesce(n, 0) AS competitor_count, cents / n / 100::DOUBLE AS avg_price FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, sum(floor(price * 100 + 0.5::DOUBLE)::BIGINT)::DOUBLE AS cents FROM links WHERE price > 0 GROUP BY 1) l ON l.product_id = p.product_id WHERE NOT is_tracked""")
def agg_factors_backfill(d: Domain) -> DataFrame:
    prices = d.links.filter("price > 0").groupBy("product_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("price") * 100 + 0.5).cast("long")).cast("double").alias("cents"))
    rows = d.products.filter(~F.col("is_tracked")).join(prices, "product_id", "left")
    return rows.select("product_id", F.coalesce("n", F.lit(0)).alias("competitor_count"), (F.col("cents") / F.col("n") / 100).alias("avg_price"))


# ------------------------------------------------------------------------------- windows


@query("SELECT competitor_id, product_id, price FROM (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY is_active DESC, updated_at DESC NULLS LAST, product_id) AS r FROM links) WHERE r = 1")
def win_distinct_on(d: Domain) -> DataFrame:
    """Each competitor's first link: active ones, then the latest, then the lowest product."""
    order = Window.partitionBy("competitor_id").orderBy(F.desc("is_active"), F.desc_nulls_last("updated_at"), "product_id")
    return d.links.withColumn("r", F.row_number().over(order)).filter("r = 1").select("competitor_id", "product_id", "price")


@boards("SELECT product_id, competitor_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY ran_at DESC, run_id DESC) AS r FROM runs) WHERE r = 1")
def win_latest_extraction(d: Domain) -> DataFrame:
    last = runs(d).groupBy("product_id", "competitor_id").agg(F.max(F.struct("ran_at", "run_id")).alias("last"))
    return last.select("product_id", "competitor_id", "last.run_id")


@query("""SELECT product_id, competitor_id, recorded_at, turn, CASE WHEN turn = 1 THEN 'new' WHEN price > before THEN 'up' WHEN price < before THEN 'down' ELSE 'same' END AS moved
  FROM (SELECT *, lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY turn) AS before FROM observations)""")
def win_prev_price_ui(d: Domain) -> DataFrame:
    rows = d.observations.withColumn("turn", F.row_number().over(d.turns).cast("long")).withColumn("before", F.lag("price").over(d.turns))
    moved = F.when(F.col("turn") == 1, "new").when(F.col("price") > F.col("before"), "up").when(F.col("price") < F.col("before"), "down").otherwise("same")
    return rows.select("product_id", "competitor_id", "recorded_at", "turn", moved.alias("moved"))


ACTIVITY = ", feed AS (SELECT event_id, user_id, event_id % 20 AS item, event_id % 5 = 0 AS started, event_id % 5 = 1 AS finished, ts AS ran_at FROM events)\n"


def _feed(d: Domain) -> DataFrame:
    key = F.col("event_id")
    return d.table("events").select("event_id", "user_id", (key % 20).alias("item"), (key % 5 == 0).alias("started"), (key % 5 == 1).alias("finished"), F.col("ts").alias("ran_at"))


@boards(ACTIVITY + "SELECT user_id, event_id FROM (SELECT *, coalesce(sum(started::INT) OVER (PARTITION BY user_id ORDER BY ran_at DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM feed) WHERE before = 0")
def win_take_until(d: Domain) -> DataFrame:
    """Each user's newest rows up to and with the first that started something.

    The last start is one aggregate, combined before the shuffle, so no user's rows are sorted.
    """
    last = _feed(d).filter("started").groupBy("user_id").agg(F.max(F.struct("ran_at", "event_id")).alias("last"))
    rows = _feed(d).join(last, "user_id", "left").filter(F.col("last").isNull() | (F.struct("ran_at", "event_id") >= F.col("last")))
    return rows.select("user_id", "event_id")


@boards(ACTIVITY + """SELECT user_id, max(ran_at) FILTER (WHERE started) AS started_at, max(ran_at) FILTER (WHERE finished) AS finished_at,
  coalesce(max(ran_at) FILTER (WHERE started) > coalesce(max(ran_at) FILTER (WHERE finished), TIMESTAMP '1970-01-01') AND max(ran_at) FILTER (WHERE started) >= (SELECT max(ran_at) FROM feed) - INTERVAL 10 MINUTE, false) AS running FROM feed GROUP BY 1""")
def win_bookends(d: Domain) -> DataFrame:
    """Whether a user's last run goes on: started after the last end and within ten minutes of the last event."""
    feed = _feed(d)
    ends = feed.groupBy("user_id").agg(F.max(F.when(F.col("started"), F.col("ran_at"))).alias("started_at"), F.max(F.when(F.col("finished"), F.col("ran_at"))).alias("finished_at"))
    rows = ends.crossJoin(F.broadcast(feed.agg(F.max("ran_at").alias("now"))))
    running = (F.col("started_at") > F.coalesce("finished_at", F.expr("timestamp_ntz'1970-01-01'"))) & (F.col("started_at") >= F.col("now") - F.expr("interval 10 minutes"))
    return rows.select("user_id", "started_at", "finished_at", F.coalesce(running, F.lit(False)).alias("running"))


@boards(ACTIVITY + """, ends AS (SELECT user_id, item, max(ran_at) FILTER (WHERE started) AS s, max(ran_at) FILTER (WHERE finished) AS f FROM feed GROUP BY 1, 2)
  SELECT user_id, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item DESC) AS r FROM ends WHERE s IS NOT NULL AND (f IS NULL OR f < s)) WHERE r = 1""")
def win_current_open(d: Domain) -> DataFrame:
    """Each user's newest item that was started and not finished since."""
    ends = _feed(d).groupBy("user_id", "item").agg(F.max(F.when(F.col("started"), F.col("ran_at"))).alias("s"), F.max(F.when(F.col("finished"), F.col("ran_at"))).alias("f"))
    newest = ends.filter("s is not null and (f is null or f < s)").groupBy("user_id").agg(F.max(F.struct("s", "item")).alias("last"))
    return newest.select("user_id", "last.item")


# ------------------------------------------------------------------------------- top lists


@boards("SELECT rec_id, confidence FROM recs WHERE status = 'pending' ORDER BY confidence DESC, created_at DESC, rec_id LIMIT 6")
def sort_multi(d: Domain) -> DataFrame:
    return recommendations(d).filter("status = 'pending'").orderBy(F.desc("confidence"), F.desc("created_at"), "rec_id").limit(6).select("rec_id", "confidence")


@query("SELECT product_id, competitor_id, updated_at, price FROM links ORDER BY updated_at DESC, price DESC, product_id, competitor_id")
def sort_double(d: Domain) -> DataFrame:
    """The later sort wins, the earlier one orders its ties."""
    return d.links.select("product_id", "competitor_id", "updated_at", "price").orderBy(F.desc("updated_at"), F.desc("price"), "product_id", "competitor_id")


@boards("""SELECT 'recommendation' AS kind, rec_id AS id, created_at FROM (SELECT * FROM recs WHERE status = 'pending' ORDER BY confidence DESC, created_at DESC, rec_id LIMIT 6)
  UNION ALL SELECT 'alert', alert_id, created_at FROM (SELECT * FROM alerts WHERE NOT is_resolved ORDER BY created_at DESC, alert_id LIMIT 6)
  UNION ALL SELECT 'run', run_id, ran_at FROM (SELECT * FROM runs ORDER BY ran_at DESC, run_id LIMIT 12)
  UNION ALL SELECT 'pending_total', count(*), NULL FROM recs WHERE status = 'pending' UNION ALL SELECT 'alert_total', count(*), NULL FROM alerts WHERE NOT is_resolved UNION ALL SELECT 'run_total', count(*), NULL FROM runs""")
def sort_join_fold(d: Domain) -> DataFrame:
    """Three short lists and their totals."""
    pending, open_, made = recommendations(d).filter("status = 'pending'"), alerts(d).filter(~F.col("is_resolved")), runs(d).withColumnRenamed("ran_at", "created_at")
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "created_at")
    total = lambda df, kind: df.agg(F.count("*").alias("id")).select(F.lit(kind).alias("kind"), "id", F.lit(None).cast("timestamp_ntz").alias("created_at"))
    lists = [
        part(pending.orderBy(F.desc("confidence"), F.desc("created_at"), "rec_id").limit(6), "recommendation", "rec_id"), part(open_.orderBy(F.desc("created_at"), "alert_id").limit(6), "alert", "alert_id"),
        part(made.orderBy(F.desc("created_at"), "run_id").limit(12), "run", "run_id"), total(pending, "pending_total"), total(open_, "alert_total"), total(made, "run_total"),
    ]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


@boards("SELECT product_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, run_id) AS r FROM runs) WHERE r <= 4")
def topk_candidates(d: Domain) -> DataFrame:
    best = Window.partitionBy("product_id").orderBy(F.desc("confidence"), "run_id")
    return runs(d).withColumn("r", F.row_number().over(best)).filter("r <= 4").select("product_id", "run_id")


@boards("SELECT product_id, run_id FROM (SELECT *, coalesce(sum(resolved::INT) OVER (PARTITION BY product_id ORDER BY confidence DESC, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs) WHERE before < 3")
def topk_matched(d: Domain) -> DataFrame:
    """A product's candidates in order, up to its third match."""
    earlier = Window.partitionBy("product_id").orderBy(F.desc("confidence"), "run_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("resolved").cast("int")).over(earlier), F.lit(0))
    return runs(d).withColumn("before", before).filter("before < 3").select("product_id", "run_id")


@boards("SELECT run_id FROM runs ORDER BY ran_at DESC, run_id DESC LIMIT 20000")
def limit_window(d: Domain) -> DataFrame:
    return runs(d).orderBy(F.desc("ran_at"), F.desc("run_id")).limit(20_000).select("run_id")


@boards("""SELECT 'alert' AS kind, alert_id AS id FROM (SELECT * FROM alerts ORDER BY created_at DESC, alert_id LIMIT 10) UNION ALL SELECT 'recommendation', rec_id FROM (SELECT * FROM recs ORDER BY created_at DESC, rec_id LIMIT 10)
  UNION ALL SELECT 'run', run_id FROM (SELECT * FROM runs ORDER BY ran_at DESC, run_id LIMIT 10)""")
def limit_feed(d: Domain) -> DataFrame:
    newest = lambda df, kind, ran_at, key: df.orderBy(F.desc(ran_at), key).limit(10).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return newest(alerts(d), "alert", "created_at", "alert_id").unionByName(newest(recommendations(d), "recommendation", "created_at", "rec_id")).unionByName(newest(runs(d), "run", "ran_at", "run_id"))


# ------------------------------------------------------------------------------- sets, joins and writes


@boards("SELECT run_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(reasons, []), ['low_confidence', domain]))), ',') AS reasons FROM runs")
def set_union_distinct(d: Domain) -> DataFrame:
    both = F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), F.array(F.lit("low_confidence"), F.col("domain")))
    return runs(d).select("run_id", F.array_join(F.array_sort(both), ",").alias("reasons"))


@boards("SELECT run_id, array_to_string(list_concat([platform], coalesce(reasons, []), [version]), ',') AS evidence FROM runs")
def set_evidence(d: Domain) -> DataFrame:
    """Parts in a fixed order of their sources."""
    parts = F.concat(F.array("platform"), F.coalesce("reasons", F.array().cast("array<string>")), F.array("version"))
    return runs(d).select("run_id", F.array_join(parts, ",").alias("evidence"))


@query("SELECT l.product_id, l.competitor_id, p.cost_price FROM links l LEFT JOIN products p ON p.product_id = l.product_id AND p.cost_price > 0")
def lookup_cost(d: Domain) -> DataFrame:
    return d.links.join(d.products.filter("cost_price > 0").select("product_id", "cost_price"), "product_id", "left").select("product_id", "competitor_id", "cost_price")


@boards("SELECT alert_id, created_at FROM alerts WHERE user_id = 3 AND EXISTS (SELECT 1 FROM recs WHERE recs.user_id = 3 AND status = 'pending')")
def guard_exists(d: Domain) -> DataFrame:
    """Rows of an account only if it passes a probe."""
    probe = recommendations(d).filter("user_id = 3 and status = 'pending'").select("user_id")
    return alerts(d).filter("user_id = 3").join(probe, "user_id", "left_semi").select("alert_id", "created_at")


@boards("SELECT rec_id FROM recs WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def semi_double_or(d: Domain) -> DataFrame:
    """The same subquery twice is once."""
    some = d.table("customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    return recommendations(d).join(some, "o_custkey", "left_semi").select("rec_id")


@boards("SELECT rec_id, c_name FROM recs JOIN customer ON c_custkey = o_custkey WHERE status = 'accepted'")
def join_run_user(d: Domain) -> DataFrame:
    users = d.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return recommendations(d).filter("status = 'accepted'").join(users, "o_custkey").select("rec_id", "c_name")


@query("SELECT f.user_id, c.competitor_id, c.name FROM (SELECT DISTINCT user_id FROM products) f JOIN competitors c ON (c.competitor_id + f.user_id) % 3 <> 0 WHERE c.status = 'active'")
def join_bridge(d: Domain) -> DataFrame:
    """An account's connections with the shops that they lead to."""
    shops = d.competitors.select("competitor_id", "name")
    return d.followed.filter("status = 'active'").join(shops, "competitor_id").select("user_id", "competitor_id", "name")


@query("SELECT o.product_id, o.competitor_id, c.name, p.title, o.price, o.recorded_at FROM observations o JOIN competitors c ON c.competitor_id = o.competitor_id JOIN products p ON p.product_id = o.product_id WHERE p.user_id = 5")
def join_snapshot_path(d: Domain) -> DataFrame:
    mine = d.products.filter("user_id = 5").select("product_id", "title")
    return d.observations.join(mine, "product_id").join(d.competitors, "competitor_id").select("product_id", "competitor_id", "name", "title", "price", "recorded_at")


@query("""SELECT event_id, e.event_type, p.title FROM events e JOIN products p ON p.product_id = json_extract_string(e.props, '$.k')::BIGINT WHERE e.event_type = 'purchase'""")
def join_event_entity(d: Domain) -> DataFrame:
    """Activity with the entity that its id, of one kind among several, stands for."""
    rows = d.table("events").filter("event_type = 'purchase'").withColumn("product_id", F.get_json_object("props", "$.k").cast("long"))
    return rows.join(d.products.select("product_id", "title"), "product_id").select("event_id", "event_type", "title")


@boards("""SELECT l.run_id AS loser, min(w.run_id) AS winner FROM runs l JOIN runs w ON w.product_id = l.product_id AND w.competitor_id = l.competitor_id AND w.run_id < l.run_id GROUP BY 1""")
def theta_self_dedupe(d: Domain) -> DataFrame:
    """Every run that an earlier one of its listing beats, with the first: a minimum instead of a self-join by order."""
    first = runs(d).groupBy("product_id", "competitor_id").agg(F.min("run_id").alias("winner"))
    beaten = runs(d).join(first, ["product_id", "competitor_id"]).filter("winner < run_id")
    return beaten.groupBy(F.col("run_id").alias("loser")).agg(F.min("winner").alias("winner"))


@boards(""", moves AS (SELECT l_suppkey AS old_id, min(l_suppkey % 10 + 1) AS new_id FROM lineitem WHERE l_suppkey > 10 GROUP BY 1) SELECT run_id, coalesce(new_id, competitor_id) AS competitor_id FROM runs LEFT JOIN moves ON old_id = competitor_id""")
def update_from_join(d: Domain) -> DataFrame:
    """Keys moved along a map of old and new ids."""
    moves = d.table("lineitem").filter("l_suppkey > 10").groupBy(F.col("l_suppkey").alias("old_id")).agg(F.min(F.col("l_suppkey") % 10 + 1).alias("new_id"))
    return writes.repointed(runs(d).select("run_id", "competitor_id"), moves, "competitor_id")


@boards("SELECT min(alert_id) AS alert_id, user_id, date_trunc('day', created_at)::TIMESTAMP AS day FROM alerts GROUP BY user_id, date_trunc('day', created_at)")
def st_dedupe_bucket(d: Domain) -> DataFrame:
    """One job of a user and day is kept, the first."""
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")
    return alerts(d).groupBy("user_id", day).agg(F.min("alert_id").alias("alert_id")).select("alert_id", "user_id", "day")


@query("""SELECT product_id, title FROM products WHERE product_id % 3 <> 0 UNION ALL SELECT product_id + 1000000, upper(title) FROM products WHERE product_id % 5 = 0""")
def sink_insert(d: Domain) -> DataFrame:
    """New rows appended to the stored ones."""
    stored = d.products.filter("product_id % 3 <> 0").select("product_id", "title")
    return stored.unionByName(d.products.filter("product_id % 5 = 0").select((F.col("product_id") + 1_000_000).alias("product_id"), F.upper("title").alias("title")))


@boards("SELECT user_id, event_type, min(event_id) AS event_id, CASE WHEN user_id % 2 = 0 THEN 'processed' ELSE 'processing' END AS state FROM events GROUP BY 1, 2")
def sink_idempotent_event(d: Domain) -> DataFrame:
    """A key that is stored, as half of them are, stays as it is; another is taken once, by its first event."""
    first = d.table("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    stored = first.filter("user_id % 2 = 0").withColumn("state", F.lit("processed"))
    return writes.insert_ignore(stored, first.withColumn("state", F.lit("processing")), ["user_id", "event_type"])
