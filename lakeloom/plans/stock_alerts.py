"""Low and empty stock over time: what a monitor finds at the end of each day, and which of it is sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.plans.ledger import running_balance, suppress
from lakeloom.session import cut_lineage
from lakeloom.sources.domain import view, with_views


def days_below(movements: DataFrame, skus: DataFrame, days: int = 7) -> DataFrame:
    """Days at whose end an active SKU that moved is below its threshold: quantity, threshold, and average daily sales of `days` days.

    Rows shrink to a SKU's days before any window over a SKU alone.
    """
    after = running_balance(movements).withColumn("day", F.to_date("created_at"))
    by_day = after.groupBy("sku_id", "day").agg(F.max_by("quantity_after", F.struct("created_at", "movement_id", "delta")).alias("quantity"), F.sum(F.when(F.col("reason") == "SALE", -F.col("delta")).otherwise(0)).alias("sold"))
    recent = Window.partitionBy("sku_id").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    told = by_day.withColumn("average", F.sum("sold").over(recent) / days)
    return told.join(skus.filter("active").select("sku_id", "code", "safety_threshold"), "sku_id").filter(F.col("quantity") < F.col("safety_threshold"))


def stock_alerts(found: DataFrame, repeat_hours: float) -> DataFrame:
    """Alerts that are sent for `days_below`: none of the same kind for the same SKU within so many hours after one was sent.

    Empty stock and low stock are kinds of their own, so a SKU that runs out is told at once; only LOW_STOCK carries the average.
    """
    empty = F.col("quantity") <= 0
    keyed = found.select(F.concat_ws(":", F.when(empty, "OUT_OF_STOCK").otherwise("LOW_STOCK"), "code").alias("key"), F.unix_date("day").cast("bigint").alias("id"), (F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("ts"), "code", "quantity", "safety_threshold", F.when(~empty, F.round("average", 6)).alias("average"))
    keyed = cut_lineage(keyed)
    return keyed.join(suppress(keyed, repeat_hours).select("key", "id"), ["key", "id"], "left_semi").drop("id")


QUERIES = {
    "low_stock_days": lambda s, d: days_below(view(s, d, "movement"), view(s, d, "sku")).select("code", F.date_format("day", "yyyy-MM-dd").alias("day"), "quantity", F.round("average", 6).alias("average")),
    "low_stock_alerts": lambda s, d: stock_alerts(days_below(view(s, d, "movement"), view(s, d, "sku")), 24 * 30).withColumn("ts", F.date_format("ts", "yyyy-MM-dd")),
}

_FOUND = f"""{with_views('movement', 'sku').replace('WITH ', 'WITH RECURSIVE ', 1)}, a AS (SELECT *, CAST(created_at AS DATE) AS day, sum(delta) OVER (PARTITION BY sku_id ORDER BY created_at, movement_id, delta ROWS UNBOUNDED PRECEDING) AS after FROM movement),
    b AS (SELECT sku_id, day, CAST(arg_max(after, (created_at, movement_id, delta)) AS BIGINT) AS quantity, sum(CASE WHEN reason = 'SALE' THEN -delta ELSE 0 END) AS sold FROM a GROUP BY 1, 2),
    c AS (SELECT *, sum(sold) OVER (PARTITION BY sku_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) / 7 AS average FROM b),
    found AS (SELECT code, day, c.quantity, safety_threshold, round(average, 6) AS average, CASE WHEN c.quantity <= 0 THEN 'OUT_OF_STOCK:' ELSE 'LOW_STOCK:' END || code AS key FROM c JOIN sku USING (sku_id) WHERE active AND c.quantity < safety_threshold)"""
SQL = {
    "low_stock_days": f"{_FOUND} SELECT code, strftime(day, '%Y-%m-%d') AS day, quantity, average FROM found",
    "low_stock_alerts": f"""{_FOUND}, s AS (SELECT key, min(day) AS day FROM found GROUP BY key UNION ALL SELECT key, day FROM (SELECT s.key, f.day, row_number() OVER (PARTITION BY s.key ORDER BY f.day) AS n FROM s JOIN found f ON f.key = s.key AND f.day >= s.day + INTERVAL 30 DAY) WHERE n = 1)
        SELECT key, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS ts, code, quantity, safety_threshold, CASE WHEN quantity > 0 THEN average END AS average FROM s JOIN found USING (key, day)""",
}
