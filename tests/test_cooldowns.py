"""Cooldowns of a quota over several batches."""

from pyspark.sql import functions as F

from pricewright.streaming import prices


def test_cooldowns(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    full, other = "quota_exhausted", "server_error"
    batches = [
        [("a", 1, 0, other), ("a", 3, 9, full), ("a", 2, 5, full), ("b", 4, 6, None), (None, 9, 1, full)],
        [("a", 5, 14, None), ("a", 6, 15, None), ("b", 7, 7, full)],
        [("a", 8, 40, full), ("b", 10, 16, full), ("b", 11, 17, None), ("b", 12, 26, None), ("a", 13, 49, None)],
    ]
    for rows in batches:
        made = spark.createDataFrame(rows, "user_id string, event_id long, m int, failure string")
        made.select("user_id", "event_id", F.expr("make_timestamp_ntz(2024, 1, 1, 0, m, 0)").alias("ts"), "failure").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("user_id string, event_id long, ts timestamp_ntz, failure string").parquet(folder)
        kept = lambda df, _: seen.extend((r.event_id, r.outcome) for r in df.collect())
        query = prices.cooldowns(stream, "user_id", 10 * 60_000).writeStream.foreachBatch(kept)
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    refused = {event for event, outcome in seen if outcome == "refused"}
    # a is closed from 5 to 15 and from 40 to 50, b from 7 to 17.
    assert len(seen) == 12 and refused == {3, 5, 10, 13}
