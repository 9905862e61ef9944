"""Order ingest: from a batch of channel lines to stored lines, stock movements, alerts, incidents and counts.

A batch may overlap what is stored, repeat itself, and hold orders that cannot be taken. Each line gets one fate, written
once; everything else is read off that table. A line's key is channel, order and line number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.ledger import running_balance
from lakeloom.plans.orders import _MAPPING, _OPTION
from lakeloom.session import cut_lineage
from lakeloom.sources.domain import view, with_views

KEY = ["channel", "order_no", "line_no"]
_REST = ["ordered_at", "item", "option", "quantity", "amount"]


@dataclass(frozen=True)
class Ingested:
    """What a batch comes to. `fates` has every line of it once; the others are views of it."""

    fates: DataFrame

    @property
    def lines(self) -> DataFrame:
        """Lines to store; those without a SKU wait for their mapping with their stock not applied."""
        return self.fates.filter("fate in ('NEW', 'UNMAPPED')").select(*KEY, *_REST, "sku", (F.col("fate") == "NEW").alias("stock_applied"))

    @property
    def movements(self) -> DataFrame:
        return _movements(self.fates.filter("fate = 'NEW'"))

    @property
    def alerts(self) -> DataFrame:
        """Messages to send: one for each new line, for each line that took more than there was, and for each without a SKU."""
        kinds = F.when(F.col("fate") == "UNMAPPED", F.array(F.lit("UNMAPPED_PRODUCT"))).when(F.col("oversold"), F.array(F.lit("NEW_ORDER"), F.lit("OVERSELL"))).otherwise(F.array(F.lit("NEW_ORDER")))
        return self.fates.filter("fate in ('NEW', 'UNMAPPED')").select(F.explode(kinds).alias("type"), *KEY, "item", "option", "sku", "quantity", "quantity_after", F.col("ordered_at").alias("at"))

    @property
    def incidents(self) -> DataFrame:
        """Incidents by key: how often in this batch, first and last."""
        alerts = self.alerts.filter("type <> 'NEW_ORDER'")
        product = F.concat_ws(":", F.lit("UNMAPPED_PRODUCT"), "channel", F.coalesce(F.col("item").cast("string"), F.lit("-")), F.coalesce("option", F.lit("-")))
        key = F.when(F.col("type") == "OVERSELL", F.concat_ws(":", "type", "sku")).otherwise(product)
        return alerts.groupBy(key.alias("key"), "type").agg(F.count(F.lit(1)).alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))

    @property
    def orders(self) -> DataFrame:
        """Counts of lines by order. Of a failed order nothing is taken, so its counts are 0."""
        failed = F.max(F.col("fate") == "FAILED")
        count = lambda c: F.when(failed, 0).otherwise(F.sum(c)).cast("bigint")
        is_ = lambda fate: (F.col("fate") == fate).cast("int")
        again = F.when(F.col("fate") == "DUPLICATE", F.col("copies")).otherwise(F.col("copies") - 1)
        return self.fates.groupBy("channel", "order_no").agg(
            count(is_("NEW")).alias("new"), count(again).alias("duplicates"), count(is_("UNMAPPED")).alias("unmapped"), count(F.coalesce("oversold", F.lit(False)).cast("int")).alias("oversold"), failed.alias("failed")
        )

    @property
    def summary(self) -> DataFrame:
        """A row for each channel; PARTIAL if an order failed, and then the channel's cursor has to stay."""
        sums = self.orders.groupBy("channel").agg(F.count(F.lit(1)).alias("orders"), *[F.sum(c).alias(c) for c in ("new", "duplicates", "unmapped", "oversold")], F.count(F.when(F.col("failed"), 1)).alias("failed"))
        return sums.withColumn("outcome", F.when(F.col("failed") == 0, "SUCCESS").otherwise("PARTIAL"))


def _movements(sold: DataFrame) -> DataFrame:
    return sold.select("sku", (-F.col("quantity")).alias("delta"), F.lit("SALE").alias("reason"), "quantity_after", F.col("ordered_at").alias("created_at"), *KEY)


def _mapped(lines: DataFrame, mapping: DataFrame, skus: DataFrame) -> DataFrame:
    """`lines` with `sku` by channel, item and option (a null option is one of its own), and the `stock` of it, null if that SKU is gone."""
    goods = mapping.filter("active").groupBy(*[F.col(c).alias(f"__{c}") for c in ("channel", "item", "option")]).agg(F.min("sku").alias("sku"))
    goods = goods.join(skus.select("sku", F.col("quantity").alias("stock")), "sku", "left")
    return lines.join(goods, (F.col("channel") == F.col("__channel")) & (F.col("item") == F.col("__item")) & F.col("option").eqNullSafe(F.col("__option")), "left").drop("__channel", "__item", "__option")


def _sold(lines: DataFrame) -> DataFrame:
    """Lines with the stock of their SKU after each, in order of time, and whether it is below 0. Sums run by day, so a SKU that sells most is spread over its days."""
    sales = lines.select("*", F.col("sku").alias("sku_id"), (-F.col("quantity")).alias("delta"), F.lit("SALE").alias("reason"), F.col("ordered_at").alias("created_at"), F.struct(*KEY).alias("movement_id"))
    after = running_balance(sales, "day").withColumn("quantity_after", F.col("stock") + F.col("quantity_after"))
    return after.select(*lines.columns, "quantity_after", (F.col("quantity_after") < 0).alias("oversold"))


def _unsound(*more: Column) -> Column:
    """Lines without a key or time, or without a positive quantity."""
    out = F.coalesce(F.col("quantity") <= 0, F.lit(True))
    for c in (*KEY, "ordered_at"):
        out = out | F.col(c).isNull()
    for c in more:
        out = out | c
    return out


def ingest(incoming: DataFrame, stored: DataFrame, mapping: DataFrame, skus: DataFrame) -> Ingested:
    """Take a batch of lines in.

    A line is a DUPLICATE if its key is stored. Of lines with one key in the batch the least (by time, item, option, quantity,
    amount) counts, the others are its copies. An order with a new line that is unsound, or whose SKU is gone, has FAILED with all its new
    lines. Of the rest a line is UNMAPPED or NEW. Stock may fall below 0; it is the `oversold` lines that have made it so, or kept it there.
    """
    once = incoming.groupBy(*KEY).agg(F.min(F.struct(*_REST)).alias("line"), F.count(F.lit(1)).alias("copies")).select(*KEY, "line.*", "copies")
    known = stored.select(*KEY).distinct().withColumn("known", F.lit(True))
    told = _mapped(once.join(known, KEY, "left"), mapping, skus)
    unsound = F.col("known").isNull() & _unsound(F.col("sku").isNotNull() & F.col("stock").isNull())
    told = cut_lineage(told.withColumn("unsound", unsound))
    failing = told.filter("unsound").select("channel", "order_no").distinct().withColumn("failing", F.lit(True))
    fate = F.when(F.col("known"), "DUPLICATE").when(F.col("unsound") | F.col("failing"), "FAILED").when(F.col("sku").isNull(), "UNMAPPED").otherwise("NEW")
    fates = told.join(failing, ["channel", "order_no"], "left").withColumn("fate", fate).drop("known", "unsound", "failing")
    sold = _sold(fates.filter("fate = 'NEW'"))
    others = fates.filter("fate <> 'NEW'").withColumns({"quantity_after": F.lit(None).cast(sold.schema["quantity_after"].dataType), "oversold": F.lit(None).cast("boolean")})
    return Ingested(cut_lineage(sold.unionByName(others)))


def settle(stored: DataFrame, mapping: DataFrame, skus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored lines after waiting ones whose mapping has come took their SKU and its stock, and the movements of that. Others stay as they are; a second call finds nothing to do."""
    waiting = _mapped(stored.filter("not stock_applied").drop("sku"), mapping, skus)
    done = cut_lineage(_sold(waiting.filter("stock is not null")).select(*stored.columns, "quantity_after"))
    rest = stored.join(done.select(*KEY), KEY, "left_anti")
    return rest.unionByName(done.drop("quantity_after").withColumn("stock_applied", F.lit(True))), _movements(done)


def stock_after(skus: DataFrame, movements: DataFrame) -> DataFrame:
    """SKUs with their quantities after movements."""
    moved = movements.groupBy("sku").agg(F.sum("delta").alias("__moved"))
    return skus.join(moved, "sku", "left").withColumn("quantity", F.col("quantity") + F.coalesce("__moved", F.lit(0))).drop("__moved")


def fold_incidents(known: DataFrame, reported: DataFrame) -> DataFrame:
    """Incidents (key, type, occurrences, first_at, last_at) that are open, with what was reported since; a new key opens one."""
    total = lambda agg, c: agg(c).alias(c)
    both = known.select(*reported.columns).unionByName(reported)
    return both.groupBy("key", "type").agg(total(F.sum, "occurrences"), total(F.min, "first_at"), total(F.max, "last_at"))


# --- queries --------------------------------------------------------------------------------------

_CHANNEL = "CASE order_no % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'mall' ELSE 'market' END"
_INCOMING = f"SELECT {_CHANNEL} AS channel, order_no, line_no, shipped_at AS ordered_at, item, {_OPTION} AS option, CASE WHEN item % 97 = 0 THEN 0 ELSE quantity END AS quantity, amount FROM {{order_line}}"
_MAPPED = f"SELECT channel, item, option, sku, active AND (channel <> 'market' OR item % 2 = 0) AS active FROM ({_MAPPING}) CROSS JOIN (SELECT 'shop' AS channel UNION ALL SELECT 'mall' UNION ALL SELECT 'market') AS c"
_STOCK = "SELECT concat('S', CAST(sku_id AS STRING)) AS sku, quantity + 40 AS quantity FROM {sku} WHERE sku_id % 101 <> 0"


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    incoming = spark.sql(_INCOMING, order_line=view(spark, sf_dir, "order_line"))
    return incoming, incoming.filter("order_no % 4 = 0"), spark.sql(_MAPPED, part=spark.read.parquet(f"{sf_dir}/part.parquet")), spark.sql(_STOCK, sku=view(spark, sf_dir, "sku"))


def _taken(spark, sf_dir) -> Ingested:
    return ingest(*_tables(spark, sf_dir))


def _settled(spark, sf_dir) -> DataFrame:
    """Lines taken while only every fifth item was mapped, settled once all mappings are there."""
    incoming, stored, mapping, skus = _tables(spark, sf_dir)
    first = ingest(incoming, stored, mapping.filter("item % 5 = 1"), skus)
    return settle(first.lines, mapping, stock_after(skus, first.movements))[1]


_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
QUERIES = {
    "order_ingest_fates": lambda s, d: _taken(s, d).fates.select(*KEY, "fate", "copies", "sku", "quantity_after", "oversold"),
    "order_ingest_orders": lambda s, d: _taken(s, d).orders,
    "order_ingest_summary": lambda s, d: _taken(s, d).summary,
    "order_ingest_alerts": lambda s, d: _taken(s, d).alerts.groupBy("type", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("pieces"), F.min("quantity_after").alias("least_after")),
    "order_ingest_incidents": lambda s, d: _taken(s, d).incidents.select("key", "type", "occurrences", _text("first_at"), _text("last_at")),
    "late_mapping_stock": lambda s, d: _settled(s, d).select("sku", "delta", "quantity_after", *KEY),
}


def _fates(where: str = "active") -> str:
    named = lambda t: t.replace("{order_line}", "order_line").replace("{part}", "part").replace("{sku}", "sku")
    return f"""{with_views('order_line', 'sku')}, inc AS ({named(_INCOMING)}), stock AS ({named(_STOCK)}), goods AS (SELECT m.*, s.quantity AS stock FROM ({named(_MAPPED)}) m LEFT JOIN stock s USING (sku) WHERE {where}),
    once AS (SELECT *, count(*) OVER (PARTITION BY channel, order_no, line_no) AS copies, row_number() OVER (PARTITION BY channel, order_no, line_no ORDER BY ordered_at, item, option NULLS FIRST, quantity, amount) AS place FROM inc),
    told AS (SELECT o.*, g.sku, g.stock, o.order_no % 4 = 0 AS known FROM once o LEFT JOIN goods g ON o.channel = g.channel AND o.item = g.item AND o.option IS NOT DISTINCT FROM g.option WHERE place = 1),
    failing AS (SELECT *, bool_or(NOT known AND (quantity <= 0 OR (sku IS NOT NULL AND stock IS NULL))) OVER (PARTITION BY channel, order_no) AS failed FROM told),
    f AS (SELECT *, CASE WHEN known THEN 'DUPLICATE' WHEN failed THEN 'FAILED' WHEN sku IS NULL THEN 'UNMAPPED' ELSE 'NEW' END AS fate FROM failing),
    fates AS (SELECT *, CASE WHEN fate = 'NEW' THEN CAST(stock - sum(quantity) OVER (PARTITION BY sku, fate ORDER BY ordered_at, channel, order_no, line_no) AS BIGINT) END AS quantity_after FROM f),
    counts AS (SELECT channel, order_no, count(*) FILTER (WHERE fate = 'NEW') AS new, sum(CASE fate WHEN 'DUPLICATE' THEN copies ELSE copies - 1 END) AS again, count(*) FILTER (WHERE fate = 'UNMAPPED') AS unmapped, count(*) FILTER (WHERE quantity_after < 0) AS oversold, bool_or(fate = 'FAILED') AS failed FROM fates GROUP BY ALL),
    by_order AS (SELECT channel, order_no, CASE WHEN failed THEN 0 ELSE new END AS new, CAST(CASE WHEN failed THEN 0 ELSE again END AS BIGINT) AS duplicates, CASE WHEN failed THEN 0 ELSE unmapped END AS unmapped, CASE WHEN failed THEN 0 ELSE oversold END AS oversold, failed FROM counts),
    alerts AS (SELECT *, unnest(CASE WHEN fate = 'UNMAPPED' THEN ['UNMAPPED_PRODUCT'] WHEN quantity_after < 0 THEN ['NEW_ORDER', 'OVERSELL'] ELSE ['NEW_ORDER'] END) AS type FROM fates WHERE fate IN ('NEW', 'UNMAPPED'))"""


SQL = {
    "order_ingest_fates": f"{_fates()} SELECT channel, order_no, line_no, fate, copies, sku, quantity_after, quantity_after < 0 AS oversold FROM fates",
    "order_ingest_orders": f"{_fates()} SELECT * FROM by_order",
    "order_ingest_summary": f"{_fates()} SELECT channel, count(*) AS orders, CAST(sum(new) AS BIGINT) AS new, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(unmapped) AS BIGINT) AS unmapped, CAST(sum(oversold) AS BIGINT) AS oversold, count(*) FILTER (WHERE failed) AS failed, CASE WHEN bool_or(failed) THEN 'PARTIAL' ELSE 'SUCCESS' END AS outcome FROM by_order GROUP BY channel",
    "order_ingest_alerts": f"{_fates()} SELECT type, channel, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS pieces, min(quantity_after) AS least_after FROM alerts GROUP BY ALL",
    "order_ingest_incidents": f"""{_fates()} SELECT CASE type WHEN 'OVERSELL' THEN 'OVERSELL:' || sku ELSE 'UNMAPPED_PRODUCT:' || channel || ':' || item || ':' || coalesce(option, '-') END AS key, type, count(*) AS occurrences, strftime(min(ordered_at), '%Y-%m-%d %H:%M') AS first_at, strftime(max(ordered_at), '%Y-%m-%d %H:%M') AS last_at
        FROM alerts WHERE type <> 'NEW_ORDER' GROUP BY 1, 2""",
    "late_mapping_stock": f"""{_fates("active AND item % 5 = 1")}, left_ AS (SELECT sku, max(stock) - sum(quantity) AS now FROM fates WHERE fate = 'NEW' GROUP BY sku),
        late AS (SELECT u.channel, u.order_no, u.line_no, u.ordered_at, u.quantity, m.sku, coalesce(l.now, s.quantity) AS stock FROM fates u JOIN ({_MAPPED.replace('{part}', 'part')}) m ON u.channel = m.channel AND u.item = m.item AND u.option IS NOT DISTINCT FROM m.option AND m.active JOIN stock s ON s.sku = m.sku LEFT JOIN left_ l ON l.sku = m.sku WHERE u.fate = 'UNMAPPED')
        SELECT sku, -quantity AS delta, CAST(stock - sum(quantity) OVER (PARTITION BY sku ORDER BY ordered_at, channel, order_no, line_no) AS BIGINT) AS quantity_after, channel, order_no, line_no FROM late""",
}
