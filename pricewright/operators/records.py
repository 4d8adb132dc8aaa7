"""Checks of single records: model output, trials, limits, shown text, positions and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..plans import writes
from .boards import boards, recommendations, runs
from .catalog import POSITION, SNAPSHOTS, query
from .domain import Domain

CENTS = "floor({0} * 100 + 0.5::DOUBLE)"


def redacted_keys(c: Column, longest: int) -> Column:
    """Bearer tokens and keys of model services replaced, and the text cut to a length."""
    out = F.regexp_replace(c, r"""(?i)Bearer[ \t\n\r]+[^ \t\n\r"']+""", "Bearer [redacted]")
    return F.substring(F.regexp_replace(out, r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]*[A-Za-z0-9_]", "[redacted]"), 1, longest)


@query(r"""SELECT doc_id, sha256(substring(regexp_replace(regexp_replace('Bearer ab.c' || doc_id::VARCHAR || ' sk-x' || doc_id::VARCHAR || ' ' || text, '(?i)Bearer[ \t\n\r]+[^ \t\n\r"'']+', 'Bearer [redacted]', 'g'),
  '\bsk-[A-Za-z0-9_-]*[A-Za-z0-9_]', '[redacted]', 'g'), 1, 32000)) AS sent_hash FROM documents""", domain=False)
def fn_redact_llm(d: Domain) -> DataFrame:
    """What is sent to a model: without its service's secrets, and of a bounded length."""
    key = F.col("doc_id").cast("string")
    shown = F.concat(F.lit("Bearer ab.c"), key, F.lit(" sk-x"), key, F.lit(" "), "text")
    return d.table("documents").select("doc_id", F.sha2(redacted_keys(shown, 32_000), 256).alias("sent_hash"))


RESETS = "CASE event_id % 5 WHEN 0 THEN '1700000000' WHEN 1 THEN '1700000000123' WHEN 2 THEN '2024-01-02T03:04:05Z' WHEN 3 THEN 'soon' END"


@query(f"""SELECT event_id, CASE WHEN try_cast(v AS DOUBLE) > 0 THEN CASE WHEN try_cast(v AS DOUBLE) < 10000000000 THEN try_cast(v AS DOUBLE) * 1000 ELSE try_cast(v AS DOUBLE) END
  ELSE epoch_ms(try_cast(replace(v, 'Z', '') AS TIMESTAMP))::DOUBLE END AS reset_ms FROM (SELECT event_id, {RESETS} AS v FROM events)""", domain=False)
def fn_reset_ts(d: Domain) -> DataFrame:
    """A rate limit's end as milliseconds: given in seconds, in milliseconds or as a date; null if neither."""
    key = F.col("event_id") % 5
    given = F.when(key == 0, "1700000000").when(key == 1, "1700000000123").when(key == 2, "2024-01-02T03:04:05Z").when(key == 3, "soon")
    number = given.try_cast("double")
    date = F.unix_millis(F.to_utc_timestamp(F.regexp_replace(given, "Z$", "").try_cast("timestamp_ntz").cast("timestamp"), F.current_timezone())).cast("double")
    return d.table("events").select("event_id", F.when(number > 0, F.when(number < 1e10, number * 1000).otherwise(number)).otherwise(date).alias("reset_ms"))


@boards("SELECT rec_id, CASE WHEN status = 'pending' AND created_at <= TIMESTAMP '1998-01-01' THEN 'free' ELSE 'pro' END AS plan, CASE WHEN status = 'pending' AND created_at <= TIMESTAMP '1998-01-01' THEN 'active' ELSE status END AS status FROM recs")
def fn_trial(d: Domain) -> DataFrame:
    """A trial that has ended by a given time becomes the free plan, active; others stay."""
    ended = (F.col("status") == "pending") & (F.col("created_at") <= F.expr("timestamp_ntz'1998-01-01'"))
    rows = recommendations(d).select("rec_id", F.lit("pro").alias("plan"), "status", "created_at")
    return writes.update(rows, ended, plan=F.lit("free"), status=F.lit("active")).drop("created_at")


@boards("SELECT rec_id, (created_at - CASE WHEN rec_id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END)::DATE AS period_start FROM recs")
def fn_period(d: Domain) -> DataFrame:
    """A report's period is a day or a week."""
    return recommendations(d).select("rec_id", F.date_sub("created_at", F.when(F.col("rec_id") % 2 == 0, 1).otherwise(7)).alias("period_start"))


@query("SELECT event_id, array_to_string(list_slice(list_filter(['alpha', 'b c', 'x' || repeat('y', 64), 'k_' || event_type], lambda k: regexp_matches(k, '^[a-zA-Z0-9_]{1,64}$')), 1, 20), ',') AS kept, length(substring(repeat(event_type, 60), 1, 250)) AS value_size FROM events", domain=False)
def fn_norm_props(d: Domain) -> DataFrame:
    """Properties with plain names only, twenty at most, and texts of at most 250 characters."""
    names = F.array(F.lit("alpha"), F.lit("b c"), F.lit("x" + "y" * 64), F.concat(F.lit("k_"), "event_type"))
    values = F.map_from_arrays(names, F.transform(names, lambda _: F.repeat("event_type", F.lit(60))))
    fit = F.slice(F.map_entries(F.map_filter(values, lambda k, _: k.rlike("^[a-zA-Z0-9_]{1,64}$"))), 1, 20)
    kept = F.transform(fit, lambda e: F.struct(e.key.alias("key"), F.substring(e.value, 1, 250).alias("value")))
    return d.table("events").select("event_id", F.array_join(F.transform(kept, lambda e: e.key), ",").alias("kept"), F.length(F.get(kept, F.lit(0)).getField("value")).cast("long").alias("value_size"))


GUARDED = ", outputs AS (SELECT run_id, (confidence - 10) / 85::DOUBLE AS score, CASE WHEN run_id % 4 <> 0 THEN (run_id % 7 - 1)::DOUBLE END AS price, CASE run_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'usd' ELSE '' END AS currency, CASE WHEN run_id % 5 <> 0 THEN 'a title' END AS title, resolved FROM runs)\n"


def _outputs(d: Domain) -> DataFrame:
    key = F.col("run_id")
    return runs(d).select(
        "run_id", ((F.col("confidence") - 10) / 85).alias("score"), F.when(key % 4 != 0, (key % 7 - 1).cast("double")).alias("price"), F.when(key % 3 == 0, "USD").when(key % 3 == 1, "usd").otherwise("").alias("currency"),
        F.when(key % 5 != 0, "a title").alias("title"), "resolved",
    )


@boards(GUARDED + """SELECT run_id, CASE WHEN score < 0 OR score > 1 THEN 'invalid confidence scores' WHEN price <= 0 THEN 'invalid price' WHEN NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'invalid currency code' WHEN price IS NOT NULL AND title IS NULL THEN 'price without title' END AS fault FROM outputs""")
def fn_extraction_guards(d: Domain) -> DataFrame:
    """The first fault of a model's output: scores outside 0 to 1, a price not above 0, a currency that is no code, a price without a title."""
    score, price = F.col("score"), F.col("price")
    fault = (
        F.when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), "invalid confidence scores").when(F.isnan(price) | (price <= 0), "invalid price")
        .when(~F.col("currency").rlike("^[A-Z]{3}$"), "invalid currency code").when(price.isNotNull() & (F.coalesce("title", F.lit("")) == ""), "price without title")
    )
    return _outputs(d).select("run_id", fault.alias("fault"))


@boards(GUARDED + "SELECT run_id, CASE WHEN NOT resolved THEN 'AI_PRODUCT_NOT_FOUND' WHEN price IS NULL THEN 'AI_PRICE_MISSING' WHEN score >= 0.85::DOUBLE THEN 'FINAL_MATCH' ELSE 'AI_PRODUCT_FOUND_VALIDATION_REJECTED' END AS outcome FROM outputs")
def fn_outcome(d: Domain) -> DataFrame:
    outcome = F.when(~F.col("resolved"), "AI_PRODUCT_NOT_FOUND").when(F.col("price").isNull(), "AI_PRICE_MISSING").when(F.col("score") >= 0.85, "FINAL_MATCH")
    return _outputs(d).select("run_id", outcome.otherwise("AI_PRODUCT_FOUND_VALIDATION_REJECTED").alias("outcome"))


@boards(GUARDED + "SELECT run_id, resolved AND (score >= 0.85::DOUBLE OR title IS NULL) AS taken FROM outputs")
def fn_threshold(d: Domain) -> DataFrame:
    """A match is taken if it is confident, or certain by rules (here: has no title)."""
    return _outputs(d).select("run_id", (F.col("resolved") & ((F.col("score") >= 0.85) | F.col("title").isNull())).alias("taken"))


@query("SELECT product_id, CASE WHEN cost_price > 0 THEN '$' || format('{:,.2f}', cost_price) ELSE 'Price not set' END AS shown, printf('%.2f', price) AS fixed FROM products")
def fn_format_price(d: Domain) -> DataFrame:
    """Amounts in dollars with two decimals; one that is missing or not above 0 isn't set."""
    shown = F.when(F.col("cost_price") > 0, F.concat(F.lit("$"), F.format_number("cost_price", 2))).otherwise("Price not set")
    return d.products.select("product_id", shown.alias("shown"), F.format_string("%.2f", "price").alias("fixed"))


@query(SNAPSHOTS + f"""SELECT p.product_id, {POSITION} AS market_position, ({CENTS.format('price')} - {CENTS.format('avg_price')}) / 100 AS price_diff,
  floor((price - avg_price) / avg_price * 100 * 100 + 0.5::DOUBLE) / 100 AS price_diff_percent FROM products p LEFT JOIN snapshots s ON s.product_id = p.product_id""")
def fn_position(d: Domain) -> DataFrame:
    """A product's position with the difference to the market's average, in money and percent."""
    price, average = F.col("price"), F.col("avg_price")
    difference = (money.cents(price) - money.cents(average)) / 100
    rows = d.products.join(d.snapshots, "product_id", "left")
    return rows.select("product_id", money.position(price, average).alias("market_position"), difference.alias("price_diff"), money.round2((price - average) / average * 100).alias("price_diff_percent"))


ACTIONS = SNAPSHOTS + f""", shown AS (SELECT p.product_id, title, avg_price > 0 AND is_tracked AS actionable, abs({CENTS.format('price')} - {CENTS.format('avg_price')})::BIGINT AS cents FROM products p LEFT JOIN snapshots s ON s.product_id = p.product_id)
"""


def _actions(d: Domain) -> DataFrame:
    rows = d.products.join(d.snapshots, "product_id", "left")
    change = F.abs(money.cents(F.col("price")) - money.cents(F.col("avg_price")))
    return rows.select("product_id", "title", ((F.col("avg_price") > 0) & F.col("is_tracked")).alias("actionable"), change.alias("cents"))


@query(ACTIONS + "SELECT product_id, coalesce(actionable, false) AS actionable, cents FROM shown ORDER BY coalesce(actionable, false) DESC, coalesce(cents, -1) DESC, title, product_id")
def sort_actionable(d: Domain) -> DataFrame:
    """What can be acted on first, then by money (none as -1), then by title in binary order."""
    rows = _actions(d).orderBy(F.desc(F.coalesce("actionable", F.lit(False))), F.desc(F.coalesce("cents", F.lit(-1))), "title", "product_id")
    return rows.select("product_id", F.coalesce("actionable", F.lit(False)).alias("actionable"), "cents")


@query(ACTIONS + """SELECT 'raise' AS part, product_id FROM (SELECT * FROM shown WHERE actionable ORDER BY cents DESC, product_id LIMIT 5) UNION ALL SELECT 'quiet', product_id FROM (SELECT * FROM shown WHERE NOT coalesce(actionable, false) ORDER BY product_id LIMIT 3)""")
def topk_slice(d: Domain) -> DataFrame:
    """A report's short lists."""
    part = lambda df, name: df.select(F.lit(name).alias("part"), "product_id")
    top = _actions(d).filter("actionable").orderBy(F.desc("cents"), "product_id").limit(5)
    quiet = _actions(d).filter(~F.coalesce("actionable", F.lit(False))).orderBy("product_id").limit(3)
    return part(top, "raise").unionByName(part(quiet, "quiet"))


@query(SNAPSHOTS + f"""SELECT product_id, title FROM (SELECT p.product_id, title, category, {POSITION} AS pos FROM products p LEFT JOIN snapshots s ON s.product_id = p.product_id) WHERE contains(lower(title), 're') AND category IS NOT NULL AND pos = 'INSUFFICIENT_DATA'""")
def flt_products_ui(d: Domain) -> DataFrame:
    """By text and by position; a product without a market has too little data."""
    position = F.coalesce(money.position(F.col("price"), F.col("avg_price")), F.lit("INSUFFICIENT_DATA"))
    rows = d.products.join(d.snapshots, "product_id", "left").filter(F.contains(F.lower("title"), F.lit("re")) & F.col("category").isNotNull() & (position == "INSUFFICIENT_DATA"))
    return rows.select("product_id", "title")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer", domain=False)
def prj_public_view(d: Domain) -> DataFrame:
    """Only the columns that may be shown."""
    return d.table("customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT product_id, array_to_string(list_filter([CASE WHEN length(title) > 30 THEN 'title' END, CASE WHEN NOT regexp_matches(vendor, '^Brand#[1-3][0-9]$') THEN 'vendor' END, CASE WHEN price > 4000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS faults FROM products")
def prj_schema_validate(d: Domain) -> DataFrame:
    """The fields that break their rules: lengths, patterns and ranges."""
    rules = {"title": F.length("title") > 30, "vendor": ~F.col("vendor").rlike("^Brand#[1-3][0-9]$"), "price": F.col("price") > 4000}
    return d.products.select("product_id", F.array_join(F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))), ",").alias("faults"))


@query("SELECT page_id, line, array_to_string(list_filter([lag(part) OVER w, part, lead(part) OVER w], lambda x: x IS NOT NULL), '|') AS nearby FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL) WHERE line >= 0 WINDOW w AS (PARTITION BY page_id ORDER BY line)", domain=False)
def win_nearby_lines(d: Domain) -> DataFrame:
    """Each line with the one before and the one after, within its document's array."""
    rows = d.table("documents").filter("text is not null").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("lines"))
    near = F.transform("lines", lambda part, i: F.concat_ws("|", F.get("lines", i - 1), part, F.get("lines", i + 1)))
    return rows.select("page_id", F.posexplode(near).alias("line", "nearby")).withColumn("line", F.col("line").cast("long"))


@boards("SELECT product_id, competitor_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS evidence FROM (SELECT product_id, competitor_id, unnest(reasons) AS reason FROM runs) GROUP BY 1, 2")
def set_dedupe_evidence(d: Domain) -> DataFrame:
    """What several runs of a listing have found counts once."""
    found = runs(d).select("product_id", "competitor_id", F.explode("reasons").alias("reason")).distinct()
    return found.groupBy("product_id", "competitor_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("evidence"))


@boards("SELECT product_id, competitor_id, bool_or(resolved) AND product_id % 3 <> 0 AS is_active FROM runs GROUP BY 1, 2 HAVING product_id % 3 <> 0 OR product_id % 2 = 0")
def sink_upsert_bridge(d: Domain) -> DataFrame:
    """Connections once for each pair, active again if one of the new rows is; stored ones that aren't sent stay."""
    pairs = runs(d).groupBy("product_id", "competitor_id").agg(F.bool_or("resolved").alias("is_active"))
    stored = pairs.filter("product_id % 2 = 0").withColumn("is_active", F.lit(False))
    return writes.upsert(stored, pairs.filter("product_id % 3 <> 0"), ["product_id", "competitor_id"])


@boards("SELECT user_id, rec_id, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, rec_id DESC) AS r FROM recs) WHERE r = 1 AND (user_id % 3 <> 0 OR user_id % 2 = 0)")
def sink_upsert_proposal(d: Domain) -> DataFrame:
    """One proposal an account, the newest if one is sent, else the stored one."""
    newest = recommendations(d).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("rec_id")))).filter("r = 1").select("user_id", "rec_id", "status")
    stored = newest.filter("user_id % 2 = 0").withColumn("status", F.lit("old"))
    return writes.upsert(stored, newest.filter("user_id % 3 <> 0"), ["user_id"])
