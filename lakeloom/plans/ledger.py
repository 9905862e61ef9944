"""Stock ledger, failure streaks and alert suppression: ordered analytics for each key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import KST_HOURS, days_left, in_quiet_hours, to_kst
from lakeloom.sources.domain import view, with_views


def running_balance(movements: DataFrame, step: str = "month") -> DataFrame:
    """Stock after each movement of a SKU, and whether a sale took more than there was.

    Sums run within a SKU's calendar steps; each step starts from the sum of those before, which
    comes from one row for each step. So a SKU with very many movements is spread over its steps.
    """
    parts = movements.withColumn("part", F.date_trunc(step, "created_at"))
    sums = parts.groupBy("sku_id", "part").agg(F.sum("delta").alias("moved"))
    before = Window.partitionBy("sku_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sku_id", "part", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sku_id", "part").orderBy("created_at", "movement_id", "delta").rowsBetween(Window.unboundedPreceding, 0)
    running = parts.withColumn("inside", F.sum("delta").over(inside)).join(starts, ["sku_id", "part"])
    return running.withColumn("quantity_after", F.col("start") + F.col("inside")).drop("part", "inside", "start").withColumn("oversold", (F.col("reason") == "SALE") & (F.col("quantity_after") < 0))


def inconsistent(movements: DataFrame, skus: DataFrame) -> DataFrame:
    """Active SKUs whose ledger does not add up to their stock."""
    total = movements.groupBy("sku_id").agg(F.sum("delta").alias("ledger"))
    return skus.filter("active").join(total, "sku_id", "left").withColumn("ledger", F.coalesce("ledger", F.lit(0))).filter("ledger <> quantity").select("sku_id", "quantity", "ledger")


def stock_outlook(movements: DataFrame, skus: DataFrame, since: str, days: int) -> DataFrame:
    """Average daily sales since a time, days left, and how serious that is."""
    sold = movements.filter((F.col("reason") == "SALE") & (F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))).groupBy("sku_id").agg(F.sum(-F.col("delta")).alias("sold"))
    joined = skus.filter("active").join(sold, "sku_id", "left").withColumn("average", F.coalesce("sold", F.lit(0)) / days)
    level = F.when(F.col("quantity") < 0, "OVERSOLD").when(F.col("quantity") == 0, "OUT").when(F.col("quantity") < F.col("safety_threshold"), "LOW").otherwise("NORMAL")
    return joined.select("sku_id", "quantity", F.round("average", 6).alias("average"), F.round(days_left(F.col("quantity"), F.col("average")), 6).alias("days_left"), level.alias("level"))


def failure_streaks(runs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of failures between successes, by key: how long, from when to when, and whether they disable the source."""
    w = Window.partitionBy("key").orderBy("at", "id")
    islands = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    failures = islands.filter(~F.col("ok")).groupBy("key", "island").agg(F.count(F.lit(1)).alias("failures"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return failures.drop("island").withColumn("disabled", F.col("failures") >= least)


def incidents(events: DataFrame) -> DataFrame:
    """Events with one key fold into an incident until it is resolved; the next event opens a new one."""
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = events.withColumn("incident", F.coalesce(F.sum(F.col("resolves").cast("int")).over(w), F.lit(0)))
    return numbered.groupBy("key", "incident").agg(F.count(F.when(~F.col("resolves"), 1)).alias("occurrences"), F.max(F.col("resolves")).alias("resolved"), F.max("id").alias("last_id")).filter("occurrences > 0")


def suppress(events: DataFrame, hours: float) -> DataFrame:
    """Events that are sent: those with no *sent* event of the same key in the hours before.

    The distance counts from the last one sent, so it is a fold in order of time: one pass over sorted
    partitions, which keeps the last key and time only and jumps from one sent event to the next.
    Null keys are a key; events without a time go.
    """
    step = np.timedelta64(round(hours * 3_600_000_000), "us")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = fold, None  # the last event's key (none yet), and when it may be sent again
        for rows in batches:
            if not len(rows):
                continue
            times, names = rows["ts"].to_numpy("datetime64[us]"), np.where(rows["key"].isna(), None, rows["key"].to_numpy(object))
            heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            keep = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
                if names[a] != key:
                    key, free = names[a], times[a]
                own, at = times[a:b], 0
                while (at := int(np.searchsorted(own, free))) < len(own):
                    keep.append(a + at)
                    free = own[at] + step
            yield rows.iloc[keep]

    ordered = events.select("key", "id", "ts").filter("ts is not null").repartition("key").sortWithinPartitions("key", "ts", "id")
    return ordered.mapInPandas(fold, events.select("key", "id", "ts").schema)


def after_quiet(time: dt.datetime, quiet: tuple[int, int] | None) -> dt.datetime:
    """A time, or the end of the quiet hours (minutes of the local day, from and to; they may pass midnight) that it is in."""
    if not quiet:
        return time
    local = time + dt.timedelta(hours=KST_HOURS)
    minute, (start, end) = local.hour * 60 + local.minute, quiet
    if not (start <= minute < end if start <= end else minute >= start or minute < end):
        return time
    day = local.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=int(start > end and minute >= start))
    return day + dt.timedelta(minutes=end) - dt.timedelta(hours=KST_HOURS)


def held_batches(events: DataFrame, minutes: int, quiet: tuple[int, int] | None = None) -> DataFrame:
    """Events (key, id, ts, cents) held until the oldest has waited `minutes`, or until quiet hours end; then all that are there go as one batch.

    The next event after that opens the next batch: a fold in order of time, one pass over sorted partitions, which jumps
    from batch to batch and keeps the batch at hand only. Null keys are a key; events without a time go.
    """
    wait, columns = np.timedelta64(minutes, "m"), ["key", "oldest", "sent", "n", "cents"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = fold, None  # the key at hand (none yet), and its open batch: [oldest, sent, n, cents]
        for rows in batches:
            if not len(rows):
                continue
            times, names, cents = rows["ts"].to_numpy("datetime64[us]"), np.where(rows["key"].isna(), None, rows["key"].to_numpy(object)), rows["cents"].to_numpy(np.int64)
            heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            out = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
                if names[a] != key:
                    if open_:
                        out.append((key, *open_))
                    key, open_ = names[a], None
                while a < b:
                    if open_ is None:
                        open_ = [times[a], np.datetime64(after_quiet((times[a] + wait).item(), quiet), "us"), 0, 0]
                    to = a + int(np.searchsorted(times[a:b], open_[1], "right"))
                    open_[2:] = open_[2] + to - a, open_[3] + int(cents[a:to].sum())
                    a = to
                    if a < b:
                        out.append((key, *open_))
                        open_ = None
            yield pd.DataFrame(out, columns=columns)
        if open_:
            yield pd.DataFrame([(key, *open_)], columns=columns)

    kind = events.schema["key"].dataType.simpleString()
    ordered = events.select("key", "id", "ts", "cents").filter("ts is not null").repartition("key").sortWithinPartitions("key", "ts", "id")
    return ordered.mapInPandas(fold, f"key {kind}, oldest timestamp_ntz, sent timestamp_ntz, n long, cents long")


def within_budgets(calls: DataFrame, daily: int, search: int) -> DataFrame:
    """Calls (owner, id, ts, cost, search) in order of time with `paid`, and what the owner's UTC day had `used`, and used for `searched`, after each.

    A call that does not fit the day's budget, or as a search the budget of searches, is refused and costs
    nothing, so cheaper ones after it may still be paid: a fold with two sums, over sorted partitions.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, searched = fold, 0, 0
        for rows in batches:
            out = []
            for owner, day, cost, is_search in zip(rows["owner"], rows["day"], rows["cost"], rows["search"], strict=True):
                if (owner, day) != now:
                    now, used, searched = (owner, day), 0, 0
                paid = used + cost <= daily and (not is_search or searched + cost <= search)
                if paid:
                    used, searched = used + cost, searched + cost * bool(is_search)
                out.append((paid, used, searched))
            yield pd.concat([rows, pd.DataFrame(out, columns=["paid", "used", "searched"], index=rows.index)], axis=1)

    rows = calls.select(F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), "id", "ts", F.to_date("ts").cast("string").alias("day"), F.col("cost").cast("long").alias("cost"), F.coalesce("search", F.lit(False)).alias("search"))
    rows = rows.filter("ts is not null and cost is not null")
    ordered = rows.repartition("owner", "day").sortWithinPartitions("owner", "day", "ts", "id")
    return ordered.mapInPandas(fold, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, paid boolean, used long, searched long")


def held_by_quiet_hours(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events of quiet hours (minutes of the local day) that are not urgent."""
    local = to_kst(F.col("ts"))
    return events.filter(in_quiet_hours(F.hour(local) * 60 + F.minute(local), start, end) & (F.col("event_type") != "error"))


def tier_quota(rows: DataFrame, tiers: list[str], limit: int) -> DataFrame:
    """The first rows under one common limit, by tier and then the longest untouched."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    return rows.orderBy(rank, F.col("refreshed").asc_nulls_first(), "id").limit(limit)


def _runs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))


def _resolving(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").filter("event_type in ('error', 'signup')").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("resolves"))


def _tiers(spark, sf_dir) -> DataFrame:
    orders = view(spark, sf_dir, "order_head")
    return orders.select(F.col("order_no").alias("id"), F.element_at(F.array(*[F.lit(t) for t in ("RISING", "HOT", "WARM", "COLD")]), (F.col("customer") % 4 + 1).cast("int")).alias("tier"), F.when(F.col("customer") % 7 != 0, F.col("ordered_at")).alias("refreshed"))


def _cents(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _calls(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 50 + 1).alias("cost"), (F.col("event_id") % 3 == 0).alias("search"))


QUERIES = {
    "running_balance": lambda s, d: running_balance(view(s, d, "movement")).select("sku_id", "movement_id", "delta", "quantity_after"),
    "oversold": lambda s, d: running_balance(view(s, d, "movement")).filter("oversold").select("sku_id", "movement_id", "quantity_after"),
    "ledger_consistency": lambda s, d: inconsistent(view(s, d, "movement"), view(s, d, "sku")),
    "stock_outlook": lambda s, d: stock_outlook(view(s, d, "movement"), view(s, d, "sku"), "2001-01-01", 7),
    "failure_streaks": lambda s, d: failure_streaks(_runs(s, d)),
    "incident_folding": lambda s, d: incidents(_resolving(s, d)),
    "suppress_alerts": lambda s, d: suppress(view(s, d, "alert").select(F.col("alert_key").alias("key"), F.col("event_id").alias("id"), "ts"), 24).select("key", "id"),
    "quiet_hours": lambda s, d: held_by_quiet_hours(view(s, d, "alert"), 23 * 60, 7 * 60).select("event_id", "alert_key"),
    "held_until_due": lambda s, d: held_batches(_cents(s, d), 90, (23 * 60, 7 * 60)).select("key", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest", "sent")], "n", "cents"),
    "budgeted_calls": lambda s, d: within_budgets(_calls(s, d), 60, 25).select("id", "paid", "used", "searched"),
    "tier_quota": lambda s, d: tier_quota(_tiers(s, d), ["RISING", "HOT", "WARM", "COLD"], 100).select("id", "tier"),
}

def _due(ts: str) -> str:
    at = f"({ts} + INTERVAL 90 MINUTE)"
    local = f"({at} + INTERVAL 9 HOUR)"
    return f"(CASE WHEN extract(hour FROM {local}) >= 23 THEN date_trunc('day', {local}) + INTERVAL 22 HOUR WHEN extract(hour FROM {local}) < 7 THEN date_trunc('day', {local}) - INTERVAL 2 HOUR ELSE {at} END)"


_BAL = f"{with_views('movement')}, b AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY sku_id ORDER BY created_at, movement_id, delta ROWS UNBOUNDED PRECEDING) AS BIGINT) AS quantity_after FROM movement)"
SQL = {
    "running_balance": f"{_BAL} SELECT sku_id, movement_id, delta, quantity_after FROM b",
    "oversold": f"{_BAL} SELECT sku_id, movement_id, quantity_after FROM b WHERE reason = 'SALE' AND quantity_after < 0",
    "ledger_consistency": f"{with_views('movement', 'sku')} SELECT sku_id, quantity, CAST(coalesce(ledger, 0) AS BIGINT) AS ledger FROM sku LEFT JOIN (SELECT sku_id, sum(delta) AS ledger FROM movement GROUP BY sku_id) USING (sku_id) WHERE active AND coalesce(ledger, 0) <> quantity",
    "stock_outlook": f"""{with_views('movement', 'sku')}, x AS (SELECT sku.*, coalesce(sold, 0) / 7 AS average FROM sku LEFT JOIN (SELECT sku_id, sum(-delta) AS sold FROM movement WHERE reason = 'SALE' AND created_at >= TIMESTAMP '2001-01-01' GROUP BY sku_id) USING (sku_id) WHERE active)
        SELECT sku_id, quantity, round(average, 6) AS average, CASE WHEN quantity > 0 AND average > 0 THEN round(quantity / average, 6) END AS days_left, CASE WHEN quantity < 0 THEN 'OVERSOLD' WHEN quantity = 0 THEN 'OUT' WHEN quantity < safety_threshold THEN 'LOW' ELSE 'NORMAL' END AS level FROM x""",
    "failure_streaks": f"{with_views('alert')}, i AS (SELECT *, sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM alert) SELECT user_id AS key, count(*) AS failures, min(event_id) AS first_id, max(event_id) AS last_id, count(*) >= 3 AS disabled FROM i WHERE event_type = 'error' GROUP BY user_id, island",
    "incident_folding": f"""{with_views('alert')}, i AS (SELECT *, coalesce(sum(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS incident FROM alert WHERE event_type IN ('error', 'signup'))
        SELECT user_id AS key, CAST(incident AS BIGINT) AS incident, count(*) FILTER (WHERE event_type = 'error') AS occurrences, bool_or(event_type = 'signup') AS resolved, max(event_id) AS last_id FROM i GROUP BY user_id, incident HAVING count(*) FILTER (WHERE event_type = 'error') > 0""",
    "suppress_alerts": f"""{with_views('alert').replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT alert_key AS key, event_id AS id, ts FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY ts, event_id) AS n FROM alert) WHERE n = 1
        UNION ALL SELECT key, id, ts FROM (SELECT s.key, a.event_id AS id, a.ts, row_number() OVER (PARTITION BY s.key ORDER BY a.ts, a.event_id) AS n FROM s JOIN alert a ON a.alert_key = s.key AND a.ts >= s.ts + INTERVAL 24 HOUR) WHERE n = 1) SELECT key, id FROM s""",
    "quiet_hours": f"{with_views('alert')}, l AS (SELECT *, extract(hour FROM ts + INTERVAL 9 HOUR) * 60 + extract(minute FROM ts + INTERVAL 9 HOUR) AS m FROM alert) SELECT event_id, alert_key FROM l WHERE (m >= 1380 OR m < 420) AND event_type <> 'error'",
    "held_until_due": f"""{with_views('alert').replace('WITH ', 'WITH RECURSIVE ', 1)}, h AS (SELECT user_id AS key, min(ts) AS oldest FROM alert GROUP BY 1
        UNION ALL SELECT key, oldest FROM (SELECT h.key, a.ts AS oldest, row_number() OVER (PARTITION BY h.key ORDER BY a.ts) AS n FROM h JOIN alert a ON a.user_id = h.key AND a.ts > {_due('h.oldest')}) WHERE n = 1)
        SELECT key, strftime(oldest, '%Y-%m-%d %H:%M:%S') AS oldest, strftime({_due('oldest')}, '%Y-%m-%d %H:%M:%S') AS sent, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM h JOIN alert a ON a.user_id = h.key AND a.ts >= oldest AND a.ts <= {_due('oldest')} GROUP BY ALL""",
    "budgeted_calls": f"""{with_views('alert').replace('WITH ', 'WITH RECURSIVE ', 1)}, c AS (SELECT event_id AS id, user_id AS owner, CAST(ts AS DATE) AS day, event_id % 50 + 1 AS cost, event_id % 3 = 0 AS search, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM alert),
        r AS (SELECT *, cost <= 60 AND (NOT search OR cost <= 25) AS paid, CASE WHEN cost <= 60 AND (NOT search OR cost <= 25) THEN cost ELSE 0 END AS used, CASE WHEN search AND cost <= 25 THEN cost ELSE 0 END AS searched FROM c WHERE n = 1
        UNION ALL SELECT c.*, p.ok, r.used + CASE WHEN p.ok THEN c.cost ELSE 0 END, r.searched + CASE WHEN p.ok AND c.search THEN c.cost ELSE 0 END FROM r JOIN c ON c.owner = r.owner AND c.day = r.day AND c.n = r.n + 1, LATERAL (SELECT r.used + c.cost <= 60 AND (NOT c.search OR r.searched + c.cost <= 25) AS ok) AS p)
        SELECT id, paid, used, searched FROM r""",
    "tier_quota": f"{with_views('order_head')} SELECT order_no AS id, ['RISING', 'HOT', 'WARM', 'COLD'][customer % 4 + 1] AS tier FROM order_head ORDER BY customer % 4, CASE WHEN customer % 7 <> 0 THEN ordered_at END NULLS FIRST, order_no LIMIT 100",
}
