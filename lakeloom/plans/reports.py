"""Order and stock reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.columns import KST_HOURS
from lakeloom.sources.domain import view, with_views

DAY = dt.date(1997, 3, 10)


def kst_day(orders: DataFrame, day: dt.date) -> DataFrame:
    """Orders of a local calendar day, as a half-open range of UTC times that a scan can prune by."""
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=KST_HOURS)
    return orders.filter((F.col("ordered_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ordered_at") < F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz")))


def daily_totals(orders: DataFrame, day: dt.date) -> DataFrame:
    """Number and amount of a day's placed orders."""
    placed = kst_day(orders, day).filter("status = 'PLACED'")
    return placed.agg(F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))


def channel_summary(orders: DataFrame, status: str = "PLACED") -> DataFrame:
    return orders.filter(F.col("status") == status).groupBy("channel").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("amount").alias("amount")).orderBy(F.desc("amount"), "channel")


def top_skus(lines: DataFrame, orders: DataFrame, skus: DataFrame, n: int = 3) -> DataFrame:
    """The n most sold SKUs of placed orders. Lines are summed by order and SKU before they meet the orders."""
    sold = lines.filter("sku_id is not null").groupBy("order_no", "sku_id").agg(F.sum("quantity").alias("quantity"))
    placed = orders.filter("status = 'PLACED'").select("order_no")
    sums = sold.join(placed, "order_no").groupBy("sku_id").agg(F.sum("quantity").alias("quantity"))
    return sums.join(skus.select("sku_id", "code", "name"), "sku_id").orderBy(F.desc("quantity"), "code").limit(n).select("code", "name", "quantity")


def low_stock(skus: DataFrame) -> DataFrame:
    return skus.filter(F.col("active") & (F.col("quantity") < F.col("safety_threshold"))).select("code", "quantity", "safety_threshold").orderBy("quantity", "code")


def daily_report(orders: DataFrame, lines: DataFrame, skus: DataFrame, day: dt.date) -> DataFrame:
    """One row: orders, amount, cancelled and returned orders, best channel, sold pieces, low stock, unmapped lines."""
    today = kst_day(orders, day)
    heads = today.agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s.lower()}") for s in ("PLACED", "CANCELLED", "RETURNED")],
        F.coalesce(F.sum(F.when(F.col("status") == "PLACED", F.col("amount"))), F.lit(0)).alias("amount"),
    )
    best = today.filter("status = 'PLACED'").groupBy("channel").agg(F.sum("amount").alias("sum")).agg(F.min_by("channel", F.struct(-F.col("sum"), "channel")).alias("best_channel"))
    own = lines.join(today.filter("status = 'PLACED'").select("order_no"), "order_no", "left_semi")
    pieces = own.agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("pieces"), F.count(F.when(F.col("sku_id").isNull(), 1)).alias("n_unmapped"))
    low = low_stock(skus).agg(F.count(F.lit(1)).alias("n_low_stock"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(heads).join(one(best), "__one").join(one(pieces), "__one").join(one(low), "__one").drop("__one")


def unmapped_lines(lines: DataFrame) -> DataFrame:
    """How many lines have no SKU, by item."""
    return lines.filter("sku_id is null").groupBy("item").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("quantity"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest order of every customer: top 1 for each key."""
    return runs.groupBy("customer").agg(F.max_by(F.struct("order_no", "status", "amount"), F.struct("ordered_at", "order_no")).alias("r"), F.count(F.lit(1)).alias("n_orders")).select("customer", "n_orders", "r.*")


def _day_range() -> str:
    return f"ordered_at >= TIMESTAMP '{DAY} 00:00:00' - INTERVAL '{KST_HOURS}' HOUR AND ordered_at < TIMESTAMP '{DAY} 00:00:00' + INTERVAL '{24 - KST_HOURS}' HOUR"


QUERIES = {
    "daily_totals": lambda s, d: daily_totals(view(s, d, "order_head"), DAY),
    "channel_summary": lambda s, d: channel_summary(view(s, d, "order_head")),
    "top_skus": lambda s, d: top_skus(view(s, d, "order_line"), view(s, d, "order_head"), view(s, d, "sku"), 10),
    "low_stock": lambda s, d: low_stock(view(s, d, "sku")),
    "daily_report": lambda s, d: daily_report(view(s, d, "order_head"), view(s, d, "order_line"), view(s, d, "sku"), DAY),
    "unmapped_lines": lambda s, d: unmapped_lines(view(s, d, "order_line")),
    "latest_run_per_key": lambda s, d: latest_run(view(s, d, "order_head")),
}

SQL = {
    "daily_totals": f"{with_views('order_head')} SELECT count(*) AS n_orders, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount FROM order_head WHERE status = 'PLACED' AND {_day_range()}",
    "channel_summary": f"{with_views('order_head')} SELECT channel, count(*) AS n_orders, CAST(sum(amount) AS BIGINT) AS amount FROM order_head WHERE status = 'PLACED' GROUP BY channel",
    "top_skus": f"{with_views('order_head', 'order_line', 'sku')} SELECT code, name, CAST(sum(l.quantity) AS BIGINT) AS quantity FROM order_line l JOIN order_head USING (order_no) JOIN sku USING (sku_id) WHERE status = 'PLACED' GROUP BY code, name ORDER BY 3 DESC, code LIMIT 10",
    "low_stock": f"{with_views('sku')} SELECT code, quantity, safety_threshold FROM sku WHERE active AND quantity < safety_threshold",
    "daily_report": f"""{with_views('order_head', 'order_line', 'sku')}, today AS (SELECT * FROM order_head WHERE {_day_range()}), own AS (SELECT * FROM order_line WHERE order_no IN (SELECT order_no FROM today WHERE status = 'PLACED'))
        SELECT (SELECT count(*) FROM today WHERE status = 'PLACED') AS n_placed, (SELECT count(*) FROM today WHERE status = 'CANCELLED') AS n_cancelled, (SELECT count(*) FROM today WHERE status = 'RETURNED') AS n_returned,
        (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) FROM today WHERE status = 'PLACED') AS amount, (SELECT channel FROM today WHERE status = 'PLACED' GROUP BY channel ORDER BY sum(amount) DESC, channel LIMIT 1) AS best_channel,
        (SELECT CAST(coalesce(sum(quantity), 0) AS BIGINT) FROM own) AS pieces, (SELECT count(*) FROM own WHERE sku_id IS NULL) AS n_unmapped, (SELECT count(*) FROM sku WHERE active AND quantity < safety_threshold) AS n_low_stock""",
    "unmapped_lines": f"{with_views('order_line')} SELECT item, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS quantity FROM order_line WHERE sku_id IS NULL GROUP BY item",
    "latest_run_per_key": f"{with_views('order_head')} SELECT c.customer, n_orders, order_no, status, amount FROM (SELECT customer, count(*) AS n_orders FROM order_head GROUP BY customer) c, LATERAL (SELECT order_no, status, amount FROM order_head o WHERE o.customer = c.customer ORDER BY ordered_at DESC, order_no DESC LIMIT 1) r",
}
