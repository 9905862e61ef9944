"""Two-source stock reconciliation.

Two sources report quantities of their items at points in time. Items belong to units, each
member with a factor. A run takes both sources' latest snapshots in one calendar bucket, sums
units, compares them with a tolerance and promotes differences that were there in the run before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import bucket, percent_difference
from lakeloom.sources.domain import view, with_views

#: How many values a facet lists; one more is looked up to tell whether there are others.
FACET_LIMIT = 200


def latest_base(snapshots: DataFrame, left: str, right: str, granularity: str = "DAY") -> DataFrame:
    """One row: each source's latest time, the bucket, and whether both fall in the same one."""
    latest = snapshots.agg(*[F.max(F.when(F.col("source") == s, F.col("base_at"))).alias(c) for s, c in ((left, "left_at"), (right, "right_at"))])
    return latest.withColumn("bucket", bucket(F.col("left_at"), granularity)).withColumn("aligned", F.coalesce(F.col("bucket") == bucket(F.col("right_at"), granularity), F.lit(False)))


def as_of(snapshots: DataFrame, before: Column) -> DataFrame:
    """Rows of each source's latest snapshot not after a time."""
    seen = snapshots.filter(F.col("base_at") <= before)
    last = seen.groupBy("source").agg(F.max("base_at").alias("base_at"))
    return seen.join(last, ["source", "base_at"])


def unit_sums(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Quantity of each source and unit over confirmed members. Items are summed before they meet their members."""
    items = snapshots.groupBy("source", "item_ref").agg(F.sum("quantity").alias("quantity"))
    joined = items.join(members.filter("confirmed").select("source", "item_ref", "unit_id", "factor"), ["source", "item_ref"])
    return joined.groupBy("source", "unit_id").agg(F.sum(F.col("quantity") * F.col("factor")).alias("quantity"))


def unmatched(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Items of a source that belong to no unit."""
    items = snapshots.groupBy("source", "item_ref").agg(F.sum("quantity").alias("quantity"))
    return items.join(members.filter("confirmed").select("source", "item_ref"), ["source", "item_ref"], "left_anti")


def compare(sums: DataFrame, left: str, right: str, tolerance: int = 0) -> DataFrame:
    """Units whose sums differ by more than the tolerance; a missing side is 0."""
    sides = sums.groupBy("unit_id").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("quantity"))), F.lit(0)).alias(c) for s, c in ((left, "left_quantity"), (right, "right_quantity"))])
    delta = F.col("left_quantity") - F.col("right_quantity")
    return sides.withColumn("delta", delta).filter(F.abs("delta") > tolerance).withColumn("diff_type", F.when(F.col("delta") > 0, "LEFT_MORE").otherwise("RIGHT_MORE"))


def reconcile(snapshots: DataFrame, members: DataFrame, left: str, right: str, tolerance: int = 0) -> DataFrame:
    """Differences of units, and items without a unit as UNMATCHED_LEFT or UNMATCHED_RIGHT."""
    diffs = compare(unit_sums(snapshots, members), left, right, tolerance).select("unit_id", F.lit(None).cast("bigint").alias("item_ref"), "left_quantity", "right_quantity", "delta", "diff_type")
    side = F.col("source") == left
    none = lambda c: F.when(c, F.col("quantity")).otherwise(0)
    loose = unmatched(snapshots.filter(F.col("source").isin(left, right)), members).select(F.lit(None).cast("bigint").alias("unit_id"), "item_ref", none(side).alias("left_quantity"), none(~side).alias("right_quantity"), F.when(side, F.col("quantity")).otherwise(-F.col("quantity")).alias("delta"), F.when(side, "UNMATCHED_LEFT").otherwise("UNMATCHED_RIGHT").alias("diff_type"))
    return diffs.unionByName(loose)


def promote(diffs: DataFrame, previous: DataFrame) -> DataFrame:
    """States of a run's differences: CONFIRMED if the run before had the same unit and direction, IGNORED if it was ignored there, else OBSERVING."""
    was = previous.select("unit_id", "diff_type", F.col("state").alias("was"), F.col("first_seen").alias("since"))
    state = F.when(F.col("was").isNull(), "OBSERVING").when(F.col("was") == "IGNORED", "IGNORED").otherwise("CONFIRMED")
    return diffs.join(was, ["unit_id", "diff_type"], "left").withColumns({"state": state, "first_seen": F.coalesce("since", "run")}).drop("was", "since")


def alerts(diffs: DataFrame, threshold: int | None) -> DataFrame:
    """Confirmed differences of at least the threshold; none without one."""
    return diffs.filter(F.lit(False) if threshold is None else (F.col("state") == "CONFIRMED") & (F.abs("delta") >= threshold))


def facet(df: DataFrame, field: str, limit: int = FACET_LIMIT) -> DataFrame:
    """A field's values by quantity: the report lists the first `limit`, and one more if there are others."""
    return df.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"), "value").limit(limit + 1)


def latest_values(snapshots: DataFrame, field: str, label: str | None = None, limit: int = FACET_LIMIT) -> DataFrame:
    """Each source's values of a field in its latest snapshot, by quantity: the first `limit` of a source, and one more if there are others.

    Null is '' and a value of its own; `label` names the column that tells what a value is called. Values are summed before they are ranked,
    and Spark keeps so many rows of a source on the map side.
    """
    latest = snapshots.groupBy("source").agg(F.max("base_at").alias("base_at"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = (F.max(text(label)) if label else F.lit("")).alias("label")
    sums = snapshots.join(latest, ["source", "base_at"], "left_semi").groupBy("source", text(field).alias("value")).agg(named, F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("quantity"), "value"))
    return sums.withColumn("place", place).filter(F.col("place") <= limit + 1).withColumn("more", F.col("place") > limit).drop("place")


def unmatched_named(snapshots: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Items of a source that belong to no unit, with their greatest name ('' for none) and quantity.

    A greatest text is found by sorting, so rows of units' items go first, by a hash table of the members' keys.
    """
    loose = snapshots.join(members.filter("confirmed").select("source", "item_ref").hint("shuffle_hash"), ["source", "item_ref"], "left_anti")
    return loose.groupBy("source", "item_ref").agg(F.max(F.coalesce(name, F.lit(""))).alias("name"), F.sum("quantity").alias("quantity"))


def breakdown(snapshots: DataFrame, members: DataFrame, axis: str, left: str, right: str) -> DataFrame:
    """A unit's lines by an axis column: both sides' sums by unit and axis value, with their difference and its percentage."""
    rows = snapshots.join(members.filter("confirmed").select("source", "item_ref", "unit_id", "factor"), ["source", "item_ref"])
    total = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("quantity") * F.col("factor"))), F.lit(0))
    sides = rows.groupBy("unit_id", F.col(axis).alias("axis")).agg(total(left).alias("left_quantity"), total(right).alias("right_quantity"))
    return sides.withColumns({"delta": F.col("left_quantity") - F.col("right_quantity"), "percent": percent_difference(F.col("left_quantity"), F.col("right_quantity"))})


def breakdown_totals(lines: DataFrame) -> DataFrame:
    """A unit's totals, its differing lines, and lines that only one side has."""
    one_sided = (F.col("left_quantity") == 0) != (F.col("right_quantity") == 0)
    return lines.groupBy("unit_id").agg(F.sum("left_quantity").alias("left_total"), F.sum("right_quantity").alias("right_total"), F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("delta") != 0, 1)).alias("n_differing"), F.count(F.when(one_sided, 1)).alias("n_orphans"))


def members_with_stock(members: DataFrame, snapshots: DataFrame, keep: Column) -> DataFrame:
    """All members with their stock under a filter: the filter holds before the join, so members without such stock stay, with a null quantity."""
    stock = snapshots.filter(keep).groupBy("source", "item_ref").agg(F.sum("quantity").alias("quantity"))
    return members.join(stock, ["source", "item_ref"], "left")


def attach(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after changes (source, item_ref, unit_id): an item moves to its new unit, a null unit takes it out, a new one is added unconfirmed."""
    moved = members.join(changes.select("source", "item_ref", F.col("unit_id").alias("to"), F.lit(True).alias("changed")), ["source", "item_ref"], "full_outer")
    unit = F.when(F.col("changed"), F.col("to")).otherwise(F.col("unit_id"))
    return moved.select("source", "item_ref", unit.alias("unit_id"), F.coalesce("factor", F.lit(1)).alias("factor"), F.coalesce("confirmed", F.lit(False)).alias("confirmed")).filter("unit_id is not null")


def merge_units(members: DataFrame, into: int, others: list[int]) -> DataFrame:
    return members.withColumn("unit_id", F.when(F.col("unit_id").isin(*others), F.lit(into)).otherwise(F.col("unit_id")))


LEFT, RIGHT, TOLERANCE = "erp", "wms", 50
AT = "1998-01-01 00:00:00"
_EARLIER = "1997-01-01 00:00:00"


def _slice(spark, sf_dir, at: str = AT) -> DataFrame:
    return view(spark, sf_dir, "snapshot").filter(F.col("base_at") == F.lit(at).cast("timestamp_ntz"))


def _named(spark, sf_dir) -> DataFrame:
    """Snapshots with item names that differ by lot, and are missing for some."""
    return view(spark, sf_dir, "snapshot").withColumn("item_name", F.expr(_ITEM_NAME))


_ITEM_NAME = "CASE WHEN item_ref % 6 <> 0 THEN concat('Item ', lot_code, CAST(item_ref AS STRING)) END"


def _promotion(spark, sf_dir):
    members = view(spark, sf_dir, "member")
    run = lambda at, n: compare(unit_sums(_slice(spark, sf_dir, at), members), LEFT, RIGHT, TOLERANCE).withColumn("run", F.lit(n))
    before = run(_EARLIER, 1).withColumns({"state": F.when(F.col("unit_id") % 10 == 0, "IGNORED").otherwise("OBSERVING"), "first_seen": F.lit(1)})
    return promote(run(AT, 2), before).select("unit_id", "diff_type", "delta", "state", "first_seen")


def _changed_members(spark, sf_dir):
    members = view(spark, sf_dir, "member")
    changes = members.filter("item_ref % 50 = 3").select("source", "item_ref", F.when(F.col("item_ref") % 100 == 3, F.lit(777)).cast("bigint").alias("unit_id"))
    return attach(merge_units(members, 5, [6, 7]), changes)


QUERIES = {
    "aligned_bucket": lambda s, d: latest_base(view(s, d, "snapshot"), LEFT, RIGHT).select(*[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("left_at", "right_at", "bucket")], "aligned"),
    "asof_snapshot": lambda s, d: as_of(view(s, d, "snapshot"), F.lit("1996-07-01").cast("timestamp_ntz")).select("source", "item_ref", "warehouse_code", "lot_code", "quantity"),
    "unit_sums": lambda s, d: unit_sums(_slice(s, d), view(s, d, "member")),
    "unmatched_anti": lambda s, d: unmatched(_slice(s, d), view(s, d, "member")),
    "reconcile_diff": lambda s, d: reconcile(_slice(s, d), view(s, d, "member"), LEFT, RIGHT, TOLERANCE),
    "diff_promotion": _promotion,
    "diff_state_counts": lambda s, d: _promotion(s, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")),
    "diff_alerts": lambda s, d: alerts(_promotion(s, d), 200),
    "value_facets": lambda s, d: facet(_slice(s, d), "item_ref"),
    "latest_values": lambda s, d: latest_values(_named(s, d), "item_ref", "item_name"),
    "unmatched_named": lambda s, d: unmatched_named(_named(s, d), view(s, d, "member"), "item_name"),
    "breakdown_by_axis": lambda s, d: breakdown(_slice(s, d), view(s, d, "member"), "lot_code", LEFT, RIGHT),
    "breakdown_totals": lambda s, d: breakdown_totals(breakdown(_slice(s, d), view(s, d, "member"), "warehouse_code", LEFT, RIGHT)),
    "filter_in_join": lambda s, d: members_with_stock(view(s, d, "member"), _slice(s, d), F.col("lot_code") == "A"),
    "unit_edit": _changed_members,
}

_V = with_views("snapshot", "member")
_ITEMS = f"""{_V}, now AS (SELECT * FROM snapshot WHERE base_at = TIMESTAMP '{AT}'), items AS (SELECT source, item_ref, sum(quantity) AS quantity FROM now GROUP BY ALL),
    sums AS (SELECT source, unit_id, CAST(sum(quantity * factor) AS BIGINT) AS quantity FROM items JOIN member USING (source, item_ref) WHERE confirmed GROUP BY ALL),
    loose AS (SELECT source, item_ref, CAST(quantity AS BIGINT) AS quantity FROM items WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.source = items.source AND m.item_ref = items.item_ref AND confirmed))"""


def _diffs(sums: str) -> str:
    return f"""SELECT unit_id, CAST(coalesce(l, 0) AS BIGINT) AS left_quantity, CAST(coalesce(r, 0) AS BIGINT) AS right_quantity, CAST(coalesce(l, 0) - coalesce(r, 0) AS BIGINT) AS delta, CASE WHEN coalesce(l, 0) > coalesce(r, 0) THEN 'LEFT_MORE' ELSE 'RIGHT_MORE' END AS diff_type
    FROM (SELECT unit_id, quantity AS l FROM {sums} WHERE source = '{LEFT}') FULL JOIN (SELECT unit_id, quantity AS r FROM {sums} WHERE source = '{RIGHT}') USING (unit_id) WHERE abs(coalesce(l, 0) - coalesce(r, 0)) > {TOLERANCE}"""


_PROMOTED = f"""{_ITEMS}, old_sums AS (SELECT source, unit_id, sum(quantity * factor) AS quantity FROM snapshot JOIN member USING (source, item_ref) WHERE confirmed AND base_at = TIMESTAMP '{_EARLIER}' GROUP BY ALL),
    before AS ({_diffs('old_sums')}), after AS ({_diffs('sums')}),
    promoted AS (SELECT a.unit_id, a.diff_type, a.delta, CASE WHEN b.unit_id IS NULL THEN 'OBSERVING' WHEN b.unit_id % 10 = 0 THEN 'IGNORED' ELSE 'CONFIRMED' END AS state, CASE WHEN b.unit_id IS NULL THEN 2 ELSE 1 END AS first_seen FROM after a LEFT JOIN before b USING (unit_id, diff_type))"""


def _axis(column: str) -> str:
    return f"""lines AS (SELECT unit_id, {column} AS axis, CAST(coalesce(sum(quantity * factor) FILTER (WHERE source = '{LEFT}'), 0) AS BIGINT) AS left_quantity, CAST(coalesce(sum(quantity * factor) FILTER (WHERE source = '{RIGHT}'), 0) AS BIGINT) AS right_quantity FROM now JOIN member USING (source, item_ref) WHERE confirmed GROUP BY ALL)"""


SQL = {
    "aligned_bucket": f"""{_V}, t AS (SELECT max(base_at) FILTER (WHERE source = 'erp') AS l, max(base_at) FILTER (WHERE source = 'wms') AS r FROM snapshot)
        SELECT strftime(l, '%Y-%m-%d %H:%M') AS left_at, strftime(r, '%Y-%m-%d %H:%M') AS right_at, strftime(date_trunc('day', l + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS bucket, date_trunc('day', l + INTERVAL 9 HOUR) = date_trunc('day', r + INTERVAL 9 HOUR) AS aligned FROM t""",
    "asof_snapshot": f"{_V} SELECT source, item_ref, warehouse_code, lot_code, quantity FROM snapshot s WHERE base_at = (SELECT max(base_at) FROM snapshot x WHERE x.source = s.source AND x.base_at <= TIMESTAMP '1996-07-01')",
    "unit_sums": f"{_ITEMS} SELECT * FROM sums",
    "unmatched_anti": f"{_ITEMS} SELECT * FROM loose",
    "reconcile_diff": f"""{_ITEMS} SELECT unit_id, NULL AS item_ref, left_quantity, right_quantity, delta, diff_type FROM ({_diffs('sums')})
        UNION ALL SELECT NULL, item_ref, CASE WHEN source = 'erp' THEN quantity ELSE 0 END, CASE WHEN source = 'erp' THEN 0 ELSE quantity END, CASE WHEN source = 'erp' THEN quantity ELSE -quantity END, CASE WHEN source = 'erp' THEN 'UNMATCHED_LEFT' ELSE 'UNMATCHED_RIGHT' END FROM loose""",
    "diff_promotion": f"{_PROMOTED} SELECT * FROM promoted",
    "diff_state_counts": f"{_PROMOTED} SELECT state, count(*) AS n FROM promoted GROUP BY state",
    "diff_alerts": f"{_PROMOTED} SELECT * FROM promoted WHERE state = 'CONFIRMED' AND abs(delta) >= 200",
    "value_facets": f"{_ITEMS} SELECT item_ref AS value, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM now GROUP BY item_ref ORDER BY 3 DESC, 1 LIMIT {FACET_LIMIT + 1}",
    "latest_values": f"""{_V}, l AS (SELECT source, max(base_at) AS base_at FROM snapshot GROUP BY 1), x AS (SELECT source, CAST(item_ref AS VARCHAR) AS value, coalesce(max({_ITEM_NAME}), '') AS label, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM snapshot JOIN l USING (source, base_at) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quantity DESC, value) AS place FROM x) SELECT * EXCLUDE (place), place > {FACET_LIMIT} AS more FROM r WHERE place <= {FACET_LIMIT + 1}""",
    "unmatched_named": f"{_V} SELECT source, item_ref, coalesce(max({_ITEM_NAME}), '') AS name, CAST(sum(quantity) AS BIGINT) AS quantity FROM snapshot ANTI JOIN (SELECT * FROM member WHERE confirmed) m USING (source, item_ref) GROUP BY 1, 2",
    "breakdown_by_axis": f"{_ITEMS}, {_axis('lot_code')} SELECT *, left_quantity - right_quantity AS delta, CASE WHEN greatest(left_quantity, right_quantity) = 0 THEN 0.0 ELSE round(100 * abs(left_quantity - right_quantity) / greatest(left_quantity, right_quantity), 1) END AS percent FROM lines",
    "breakdown_totals": f"{_ITEMS}, {_axis('warehouse_code')} SELECT unit_id, CAST(sum(left_quantity) AS BIGINT) AS left_total, CAST(sum(right_quantity) AS BIGINT) AS right_total, count(*) AS n_lines, count(*) FILTER (WHERE left_quantity <> right_quantity) AS n_differing, count(*) FILTER (WHERE (left_quantity = 0) <> (right_quantity = 0)) AS n_orphans FROM lines GROUP BY unit_id",
    "filter_in_join": f"{_ITEMS}, a AS (SELECT source, item_ref, CAST(sum(quantity) AS BIGINT) AS quantity FROM now WHERE lot_code = 'A' GROUP BY ALL) SELECT source, item_ref, unit_id, factor, confirmed, quantity FROM member LEFT JOIN a USING (source, item_ref)",
    "unit_edit": f"{_V} SELECT source, item_ref, CAST(CASE WHEN item_ref % 100 = 3 THEN 777 WHEN unit_id IN (6, 7) THEN 5 ELSE unit_id END AS BIGINT) AS unit_id, factor, confirmed FROM member WHERE item_ref % 100 <> 53",
}
