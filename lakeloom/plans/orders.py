"""Order ingestion, late mappings, channel upkeep and rule lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import hangul_share
from lakeloom.operators.transform import last_wins
from lakeloom.sources.domain import view, with_views


def new_lines(lines: DataFrame, known: DataFrame, keys: Sequence[str] = ("order_no", "line_no")) -> DataFrame:
    """Lines that are not stored yet, each key once: what makes reading an overlap again harmless."""
    return last_wins(lines, keys, [c for c in lines.columns if c not in keys]).join(known.select(*keys), list(keys), "left_anti")


def map_lines(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Lines with the SKU of their item and option; a null option matches a null one, and lines without a mapping keep a null SKU."""
    m = mapping.filter("active").select(F.col("item").alias("m_item"), F.col("option").alias("m_option"), F.col("sku").alias("sku"))
    return lines.join(m, (lines["item"] == m["m_item"]) & lines["option"].eqNullSafe(m["m_option"]), "left").drop("m_item", "m_option")


def apply_late_mapping(stored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stored lines without a SKU get one once their mapping is there; others stay."""
    done, open_ = stored.filter("sku is not null"), stored.filter("sku is null").drop("sku")
    return done.unionByName(map_lines(open_, mapping))


def ingest_summary(lines: DataFrame) -> DataFrame:
    """One row: lines, mapped and unmapped ones, pieces, and SUCCESS or PARTIAL."""
    sums = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count("sku").alias("mapped"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("pieces"))
    return sums.withColumn("unmapped", F.col("n_lines") - F.col("mapped")).withColumn("outcome", F.when(F.col("unmapped") == 0, "SUCCESS").otherwise("PARTIAL"))


def update_counters(stored: DataFrame, new: DataFrame, key: str, counters: Sequence[str]) -> DataFrame:
    """Known keys take the new counters and keep the rest; new keys are added whole."""
    fresh = new.select(key, *[F.col(c).alias(f"__new_{c}") for c in counters])
    known = stored.join(fresh, key, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in counters else c for c in stored.columns])
    return known.unionByName(new.join(stored.select(key), key, "left_anti").select(*stored.columns))


def due(rows: DataFrame, limits: dict[str, str], now: Column) -> DataFrame:
    """Rows whose tier's time since the last refresh is over, never refreshed ones first."""
    late = F.lit(False)
    for tier, age in limits.items():
        late = late | ((F.col("tier") == tier) & (F.col("refreshed").isNull() | (F.col("refreshed") < now - F.expr(f"INTERVAL {age}"))))
    return rows.filter(late).orderBy(F.col("refreshed").asc_nulls_first(), "id")


def eligible(channels: DataFrame, least: int = 5000, share: float = 0.3) -> DataFrame:
    """Channels with visible subscribers, enough of them, and a home country or enough Hangul in the title."""
    return channels.filter(F.col("subscribers").isNotNull() & (F.col("subscribers") >= least) & (F.col("country").eqNullSafe("KR") | (hangul_share(F.col("title")) >= share)))


def reorder(rules: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rules in a wanted order, those not named behind in their old order; places are tens. The list is one that people keep by hand, so it is one group."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("name")), F.lit(0))
    w = Window.partitionBy(F.lit(0)).orderBy(F.when(place > 0, place).otherwise(F.lit(2**31)), "sort_order", "name")
    return rules.withColumn("sort_order", F.row_number().over(w) * 10)


def merge_totals(scores: DataFrame, reviews: DataFrame, most: float = 30.0) -> DataFrame:
    """Rule totals with review points (clamped to 0 to `most`); without a review the rules alone."""
    points = F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("points")))
    return scores.join(reviews.select("channel_id", points.alias("points")), "channel_id", "left").withColumn("total", F.col("total") + F.coalesce("points", F.lit(0.0)))


def purge(rows: DataFrame, column: str, before: str) -> DataFrame:
    return rows.filter(F.col(column) >= F.lit(before).cast("timestamp_ntz"))


_MAPPING = "SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE NULL END AS option, concat('S', CAST(p_partkey AS STRING)) AS sku, p_partkey % 7 <> 0 AS active FROM {part}"
_OPTION = "CASE WHEN item % 4 = 0 THEN 'A' WHEN item % 4 = 2 THEN 'B' ELSE NULL END"


def _mapping(spark, sf_dir) -> DataFrame:
    return spark.sql(_MAPPING, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _lines(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "order_line").select("order_no", "line_no", "item", F.expr(_OPTION).alias("option"), "quantity")


def _titles(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("캠핑장 이야기 "), F.substring("p_name", 1, 3))).otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("channel_id"), F.when(F.col("p_size") > 3, F.col("p_partkey") * 11).alias("subscribers"), F.when(F.col("p_size") % 2 == 0, "KR").when(F.col("p_size") % 5 == 0, "US").alias("country"), title.alias("title"))


def _tiers(spark, sf_dir) -> DataFrame:
    orders = view(spark, sf_dir, "order_head")
    return orders.select(F.col("order_no").alias("id"), F.element_at(F.array(*[F.lit(t) for t in ("HOT", "WARM", "COLD")]), (F.col("customer") % 3 + 1).cast("int")).alias("tier"), F.when(F.col("customer") % 7 != 0, F.col("ordered_at")).alias("refreshed"))


QUERIES = {
    "ingest_new_lines": lambda s, d: new_lines(_lines(s, d), _lines(s, d).filter("order_no % 3 = 0")),
    "map_null_safe": lambda s, d: map_lines(_lines(s, d), _mapping(s, d)).select("order_no", "line_no", "item", "option", "sku"),
    "late_mapping": lambda s, d: ingest_summary(apply_late_mapping(map_lines(_lines(s, d), _mapping(s, d).filter("item % 5 = 1")), _mapping(s, d))),
    "update_counters": lambda s, d: update_counters(view(s, d, "video").filter("video_id % 2 = 0").select("video_id", "channel_id", "views", "duration_seconds"), view(s, d, "video").filter("video_id % 3 = 0 or video_id % 2 <> 0").select("video_id", "channel_id", (F.col("views") + 1).alias("views"), (F.col("duration_seconds") + 5).alias("duration_seconds")), "video_id", ["views"]),
    "refresh_due": lambda s, d: due(_tiers(s, d), {"HOT": "700 DAYS", "WARM": "1100 DAYS", "COLD": "1800 DAYS"}, F.lit("2000-01-01").cast("timestamp_ntz")).select("id", "tier"),
    "eligible_channels": lambda s, d: eligible(_titles(s, d)).select("channel_id", "title"),
    "rule_order": lambda s, d: reorder(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("sort_order")), ["NATION_7", "NATION_3"]).select("name", F.col("sort_order").cast("bigint").alias("sort_order")),
    "merged_totals": lambda s, d: merge_totals(view(s, d, "channel").select("channel_id", F.lit(40.0).alias("total")), view(s, d, "channel").filter("channel_id % 2 = 0").select("channel_id", (F.col("channel_id") - 10.0).alias("points"))),
    "retention_purge": lambda s, d: purge(view(s, d, "order_head"), "ordered_at", "2000-06-01").select("order_no", "channel"),
}

_L = f"{with_views('order_line')}, l AS (SELECT order_no, line_no, item, {_OPTION} AS option, quantity FROM order_line), m AS ({_MAPPING.replace('{part}', 'part')})"
SQL = {
    "ingest_new_lines": f"{_L} SELECT order_no, line_no, item, option, quantity FROM (SELECT *, row_number() OVER (PARTITION BY order_no, line_no ORDER BY item DESC, option DESC, quantity DESC) AS n FROM l) WHERE n = 1 AND order_no % 3 <> 0",
    "map_null_safe": f"{_L} SELECT order_no, line_no, l.item, l.option, sku FROM l LEFT JOIN (SELECT * FROM m WHERE active) x ON l.item = x.item AND l.option IS NOT DISTINCT FROM x.option",
    "late_mapping": f"{_L}, j AS (SELECT l.*, sku FROM l LEFT JOIN (SELECT * FROM m WHERE active) x ON l.item = x.item AND l.option IS NOT DISTINCT FROM x.option) SELECT count(*) AS n_lines, count(sku) AS mapped, CAST(sum(quantity) AS BIGINT) AS pieces, count(*) - count(sku) AS unmapped, 'PARTIAL' AS outcome FROM j",
    "update_counters": f"{with_views('video')} SELECT video_id, channel_id, views + CASE WHEN video_id % 3 = 0 OR video_id % 2 <> 0 THEN 1 ELSE 0 END AS views, duration_seconds + CASE WHEN video_id % 2 <> 0 THEN 5 ELSE 0 END AS duration_seconds FROM video",
    "refresh_due": f"{with_views('order_head')}, t AS (SELECT order_no AS id, ['HOT', 'WARM', 'COLD'][customer % 3 + 1] AS tier, CASE WHEN customer % 7 <> 0 THEN ordered_at END AS r FROM order_head) SELECT id, tier FROM t WHERE r IS NULL OR r < TIMESTAMP '2000-01-01' - to_days(CASE tier WHEN 'HOT' THEN 700 WHEN 'WARM' THEN 1100 ELSE 1800 END)",
    "eligible_channels": """WITH t AS (SELECT p_partkey AS channel_id, CASE WHEN p_size > 3 THEN p_partkey * 11 END AS subscribers, CASE WHEN p_size % 2 = 0 THEN 'KR' WHEN p_size % 5 = 0 THEN 'US' END AS country, CASE WHEN p_partkey % 3 = 0 THEN '캠핑장 이야기 ' || substring(p_name, 1, 3) ELSE p_name END AS title, p_partkey % 3 = 0 AS hangul FROM part)
        SELECT channel_id, title FROM t WHERE subscribers >= 5000 AND (country = 'KR' OR hangul)""",
    "rule_order": "SELECT n_name AS name, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN -2 WHEN 'NATION_3' THEN -1 ELSE n_nationkey END) * 10 AS sort_order FROM nation",
    "merged_totals": f"{with_views('channel')} SELECT channel_id, CAST(CASE WHEN channel_id % 2 = 0 THEN greatest(0.0, least(30.0, channel_id - 10.0)) END AS DOUBLE) AS points, CAST(40.0 + CASE WHEN channel_id % 2 = 0 THEN greatest(0.0, least(30.0, channel_id - 10.0)) ELSE 0.0 END AS DOUBLE) AS total FROM channel",
    "retention_purge": f"{with_views('order_head')} SELECT order_no, channel FROM order_head WHERE ordered_at >= TIMESTAMP '2000-06-01'",
}
