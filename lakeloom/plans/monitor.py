"""Monitoring: health of collections, quotas, daily snapshots, signals that come and go, held and retried events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import to_kst
from lakeloom.sources.domain import view, with_views


def collect_health(sources: DataFrame, now: Column, grace_seconds: int = 300) -> DataFrame:
    """State of each source: disabled, failing, waiting, stale or healthy; those that need attention first."""
    late = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_success").cast("timestamp")) > F.greatest(2 * F.col("interval_seconds"), F.lit(grace_seconds))
    state = F.when(~F.col("enabled"), "DISABLED").when(F.col("failures") >= 3, "AUTO_DISABLED").when(F.col("failures") > 0, "FAILING").when(F.col("last_success").isNull(), "WAITING").when(late, "STALE").otherwise("HEALTHY")
    return sources.withColumn("state", state).withColumn("attention", F.col("state").isin("AUTO_DISABLED", "FAILING", "STALE")).orderBy(F.desc("attention"), "source")


def within_quota(calls: DataFrame, daily: int) -> DataFrame:
    """Calls that a day's budget pays for, in order of time."""
    w = Window.partitionBy(F.to_date("ts"), "owner").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum("cost").over(w)).filter(F.col("spent") <= daily)


def daily_snapshots(rows: DataFrame) -> DataFrame:
    """The last values of each key on each UTC day."""
    return rows.groupBy("key", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.count(F.lit(1)).alias("n"))


def failure_days(runs: DataFrame) -> DataFrame:
    """Local days with failures since each key's last success."""
    last = runs.filter("ok").groupBy("key").agg(F.max(F.struct("at", "id")).alias("last"))
    after = runs.filter("not ok").join(last, "key", "left").filter(F.col("last").isNull() | (F.struct("at", "id") > F.col("last")))
    return after.groupBy("key").agg(F.count_distinct(F.to_date(to_kst(F.col("at")))).alias("days"), F.count(F.lit(1)).alias("failures"))


def hold_batches(events: DataFrame, minutes: int) -> DataFrame:
    """Events of a key are held until the oldest has waited long enough and go as one batch; events closer than that to the batch's first belong to it.

    Batches start at fixed distances from the key's first event of the local day.
    """
    day = F.to_date(to_kst(F.col("ts")))
    first = F.min("ts").over(Window.partitionBy("key", "day"))
    number = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))) / (60 * minutes))
    dealt = events.withColumn("day", day).withColumn("first", first).withColumn("batch", number)
    return dealt.groupBy("key", "day", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def retry_state(attempts: DataFrame, most: int = 5) -> DataFrame:
    """State of each message: SENT after a success, FAILED after the last attempt, else PENDING."""
    sums = attempts.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.max("ok").alias("sent"))
    return sums.select("key", F.least("attempts", F.lit(most)).alias("attempts"), F.when(F.col("sent"), "SENT").when(F.col("attempts") >= most, "FAILED").otherwise("PENDING").alias("state"))


def signals(scores: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """Signals after a run: new ones, those seen again (which keep the day they were first seen), and those that are over."""
    now = scores.filter(F.col("score") >= least).select("key", "score", "day")
    old = stored.select("key", F.col("active").alias("was"), F.col("detected").alias("since"))
    both = now.join(old, "key", "full_outer")
    active = F.col("score").isNotNull()
    detected = F.when(active & F.coalesce("was", F.lit(False)), F.col("since")).when(active, F.col("day")).otherwise(F.col("since"))
    return both.select("key", active.alias("active"), detected.alias("detected"))


def stored_and_new(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys only in one of two sets, and in both."""
    only = a.exceptAll(b).withColumn("where", F.lit("left")).unionByName(b.exceptAll(a).withColumn("where", F.lit("right")))
    return only.unionByName(a.intersect(b).withColumn("where", F.lit("both")))


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """Keys of JSON objects, in order of the first row that has them."""
    tall = rows.select("event_id", F.explode(F.json_object_keys(column)).alias("key"))
    return tall.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _events(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("key"), F.col("user_id").alias("owner"), F.col("event_id").alias("id"), "ts", F.col("ts").alias("at"), "value", F.round(F.col("value") * 100).cast("bigint").alias("cents"), (F.col("event_id") % 50 + 1).alias("cost"), (F.col("event_type") == "purchase").alias("ok"))


def _sources(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("key").alias("source")).agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"), (F.count(F.when(~F.col("ok"), 1)) % 5).alias("failures")).select("source", "last_success", "failures", (F.col("source") % 11 != 0).alias("enabled"), (F.col("source") % 4 * 86_400).alias("interval_seconds"))


def _signals(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    week = lambda a, b: e.filter((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).groupBy("key").agg(F.sum("cents").alias("score"))
    before = week("2024-01-01", "2024-01-08").select("key", (F.col("score") >= 100_000).alias("active"), F.lit("2024-01-08").alias("detected"))
    return signals(week("2024-01-08", "2024-01-15").withColumn("day", F.lit("2024-01-15")), before, 100_000)


QUERIES = {
    "collect_health": lambda s, d: collect_health(_sources(s, d), F.lit("2024-01-31").cast("timestamp_ntz")).select("source", "state", "attention"),
    "within_quota": lambda s, d: within_quota(_events(s, d), 60).select("id", "owner", "spent"),
    "daily_snapshots": lambda s, d: daily_snapshots(_events(s, d)).select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "value", "n"),
    "failure_days": lambda s, d: failure_days(_events(s, d)),
    "hold_batches": lambda s, d: hold_batches(_events(s, d), 90).select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "batch", "n", "cents"),
    "retry_state": lambda s, d: retry_state(_events(s, d)),
    "signal_lifecycle": _signals,
    "set_operations": lambda s, d: stored_and_new(s.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).distinct(), s.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))),
    "json_keys": lambda s, d: json_keys(s.read.parquet(f"{d}/events.parquet"), "props"),
    "snapshot_star_join": lambda s, d: view(s, d, "order_line").join(view(s, d, "sku"), "sku_id", "left").groupBy(F.coalesce("brand", F.lit("(unmapped)")).alias("brand")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").alias("amount")),
}

_E = f"{with_views('alert')}, e AS (SELECT user_id AS key, event_id AS id, ts, value, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 50 + 1 AS cost, event_type = 'purchase' AS ok FROM alert)"
SQL = {
    "collect_health": f"""{_E}, s AS (SELECT key AS source, max(ts) FILTER (WHERE ok) AS t, count(*) FILTER (WHERE NOT ok) % 5 AS f FROM e GROUP BY key), h AS (SELECT source, CASE WHEN source % 11 = 0 THEN 'DISABLED' WHEN f >= 3 THEN 'AUTO_DISABLED' WHEN f > 0 THEN 'FAILING' WHEN t IS NULL THEN 'WAITING'
        WHEN epoch(TIMESTAMP '2024-01-31') - floor(epoch(t)) > greatest(2 * (source % 4) * 86400, 300) THEN 'STALE' ELSE 'HEALTHY' END AS state FROM s) SELECT source, state, state IN ('AUTO_DISABLED', 'FAILING', 'STALE') AS attention FROM h""",
    "within_quota": f"{_E} SELECT id, key AS owner, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(cost) OVER (PARTITION BY CAST(ts AS DATE), key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS spent FROM e) WHERE spent <= 60",
    "daily_snapshots": f"{_E} SELECT key, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, (ts, id)) AS value, count(*) AS n FROM e GROUP BY 1, 2",
    "failure_days": f"{_E}, l AS (SELECT key, max((ts, id)) AS last FROM e WHERE ok GROUP BY key) SELECT key, count(DISTINCT CAST(ts + INTERVAL 9 HOUR AS DATE)) AS days, count(*) AS failures FROM e LEFT JOIN l USING (key) WHERE NOT ok AND (last IS NULL OR (ts, id) > last) GROUP BY key",
    "hold_batches": f"""{_E}, x AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM e), y AS (SELECT *, min(ts) OVER (PARTITION BY key, day) AS first FROM x)
        SELECT key, strftime(day, '%Y-%m-%d') AS day, CAST(floor((floor(epoch(ts)) - floor(epoch(first))) / 5400) AS BIGINT) AS batch, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM y GROUP BY ALL""",
    "retry_state": f"{_E} SELECT key, least(count(*), 5) AS attempts, CASE WHEN bool_or(ok) THEN 'SENT' WHEN count(*) >= 5 THEN 'FAILED' ELSE 'PENDING' END AS state FROM e GROUP BY key",
    "signal_lifecycle": f"""{_E}, a AS (SELECT key, sum(cents) >= 100000 AS was FROM e WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' GROUP BY key), b AS (SELECT key, sum(cents) AS score FROM e WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY key HAVING sum(cents) >= 100000)
        SELECT key, score IS NOT NULL AS active, CASE WHEN score IS NOT NULL AND NOT coalesce(was, false) THEN '2024-01-15' ELSE '2024-01-08' END AS detected FROM a FULL JOIN b USING (key)""",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000)
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'right' ELSE 'both' END AS "where" FROM a FULL JOIN b ON a.id = b.id""",
    "json_keys": "SELECT key, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "snapshot_star_join": f"{with_views('order_line', 'sku')} SELECT coalesce(brand, '(unmapped)') AS brand, count(*) AS n_lines, CAST(sum(amount) AS BIGINT) AS amount FROM order_line LEFT JOIN sku USING (sku_id) GROUP BY 1",
}
