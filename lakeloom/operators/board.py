"""The match board as rows: items of two sources under their unit, their mark, or their name; and a unit's lines by an axis.

Three tables meet by source and item: stock, members of units, and marks of items that a person has set aside.
Everything about a row (kind, totals, name) is an aggregate with partial sums, so a name or unit with very
many items is no list in one task; a page's items are looked up for the few rows of that page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import bigrams, dice, normalize_name, percent_difference
from lakeloom.operators import names
from lakeloom.operators.names import LEFT, RIGHT, greedy_pairs
from lakeloom.operators.reconcile import AT
from lakeloom.session import cut_lineage
from lakeloom.sources.domain import view, with_views

PAGE = 25
#: What a row without any name is called, and the kinds that each tab shows.
NAMELESS = "이름 없음"
TABS = {
    "TODO": ("PAIRED", "LEFT_ONLY", "RIGHT_ONLY"),
    "PAIRED": ("PAIRED",),
    "ONE_SIDED": ("LEFT_ONLY", "RIGHT_ONLY"),
    "LINKED": ("LINKED",),
    "SET_ASIDE": ("SET_ASIDE",),
    "ALL": ("PAIRED", "LEFT_ONLY", "RIGHT_ONLY", "LINKED", "SET_ASIDE"),
}

_ITEM = ["source", "item_ref"]


def _blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def overlay(stock: DataFrame, members: DataFrame, marks: DataFrame) -> DataFrame:
    """Items of stock (raw_name, quantity) and of units (unit_id, factor, confirmed), with the reason of a mark.

    A member without stock stays, with a null quantity and its reference as its name; a mark on an item that is in neither
    table is left out.
    """
    held = stock.groupBy(*_ITEM).agg(F.max(F.coalesce("raw_name", F.lit(""))).alias("raw_name"), F.sum("quantity").alias("quantity"))
    both = held.join(members.select(*_ITEM, "unit_id", "factor", "confirmed"), _ITEM, "full_outer")
    reference = F.col("item_ref").cast("string")
    named = both.withColumns({"display": F.when(_blank("raw_name"), reference).otherwise(F.col("raw_name")), "factor": F.coalesce("factor", F.lit(1)), "confirmed": F.coalesce("confirmed", F.lit(False))})
    return named.join(marks.select(*_ITEM, "reason"), _ITEM, "left")


def keyed(items: DataFrame, rules: dict[str, Sequence[tuple[str, str]]] | None = None) -> DataFrame:
    """Items with the key of their row: what a person has decided (unit, mark) goes before the normalised name.

    `rules` are rules for the names of single sources; the others have the general ones. A name of which the rules leave
    nothing makes a row of its own.
    """
    token = F.concat_ws("|", "source", F.col("item_ref").cast("string"))
    normal = normalize_name(F.col("display"))
    for source, own in (rules or {}).items():
        normal = F.when(F.col("source") == source, normalize_name(F.col("display"), own)).otherwise(normal)
    key = F.when(F.col("unit_id").isNotNull(), F.concat(F.lit("U:"), F.col("unit_id").cast("string"))).when(F.col("reason").isNotNull(), F.concat(F.lit("X:"), token)).otherwise(F.concat(F.lit("N:"), F.when(_blank(normal), token).otherwise(normal)))
    return items.withColumn("key", key)


def board_rows(items: DataFrame, units: DataFrame, left: str, needle: str = "") -> DataFrame:
    """One row for each key: kind, name, whether all is confirmed, items and totals by side, their difference; with a needle, rows whose name, items' names or references hold it."""
    on_left = F.col("source") == left
    effective = F.coalesce("quantity", F.lit(0)) * F.col("factor")
    total = lambda side: F.coalesce(F.sum(F.when(side, effective)), F.lit(0))
    word = needle.strip().lower()
    hit = F.lit(True) if not word else F.lower("display").contains(word) | F.lower(F.col("item_ref").cast("string")).contains(word)
    groups = items.groupBy("key").agg(
        F.max("unit_id").alias("unit_id"), F.max("reason").alias("reason"), F.min("confirmed").alias("confirmed"), F.max(F.col("quantity").isNull()).alias("missing"), F.max(hit).alias("hit"),
        F.min(F.struct((~on_left).alias("side"), "item_ref", "display")).alias("first"),
        F.count(F.when(on_left, 1)).alias("left_items"), F.count(F.when(~on_left, 1)).alias("right_items"), total(on_left).alias("left_total"), total(~on_left).alias("right_total"),
    )
    named = groups.join(units.select("unit_id", "unit_name"), "unit_id", "left")
    linked, both = F.col("unit_id").isNotNull(), (F.col("left_items") > 0) & (F.col("right_items") > 0)
    kind = F.when(linked, "LINKED").when(F.col("reason").isNotNull(), "SET_ASIDE").when(both, "PAIRED").when(F.col("left_items") > 0, "LEFT_ONLY").otherwise("RIGHT_ONLY")
    unit = F.when(linked, F.coalesce("unit_name", F.lit(NAMELESS)))
    name = F.when(~_blank(unit), unit).otherwise(F.col("first.display"))
    found = named.withColumns({"kind": kind, "name": name, "confirmed": linked & F.col("confirmed"), "diff": F.col("left_total") - F.col("right_total"), "percent": percent_difference(F.col("left_total"), F.col("right_total"))})
    found = found.filter(F.col("hit") | F.lower("name").contains(word)) if word else found
    return found.select("key", "kind", "name", "unit_id", "reason", "confirmed", "missing", "left_items", "right_items", "left_total", "right_total", "diff", "percent")


def page(rows: DataFrame, tab: str | None = None, number: int = 0, size: int = PAGE) -> DataFrame:
    """A tab's rows by name and key, `size` of them; an unknown tab is TODO, a page before the first is the first, one after the last is empty."""
    shown = rows.filter(F.col("kind").isin(*TABS.get(tab or "", TABS["TODO"])))
    return shown.orderBy("name", "key").offset(min(max(0, number) * size, 2**31 - 1 - size)).limit(size)


def items_of(items: DataFrame, rows: DataFrame, left: str, most: int | None = None) -> DataFrame:
    """Items of a page's rows (at most `PAGE` of them, so they are broadcast) by side and reference; of very large rows the first `most` a side."""
    own = items.join(F.broadcast(rows.select("key")), "key").withColumn("side", F.when(F.col("source") == left, "left").otherwise("right"))
    if most is not None:  # a row number with a limit keeps so many on the map side
        own = own.withColumn("place", F.row_number().over(Window.partitionBy("key", "side").orderBy("item_ref"))).filter(F.col("place") <= most).drop("place")
    return own.select("key", "side", *_ITEM, "display", "quantity", (F.coalesce("quantity", F.lit(0)) * F.col("factor")).alias("effective"))


def parts(stock: DataFrame, members: DataFrame, keep: Column, axis: str | None = None) -> DataFrame:
    """Confirmed members with their stock under a filter, by axis value where one is named.

    The filter stands inside the join, so members without such stock stay; an item's name comes from all its stock, as
    it says what the item is, not how much of it there is.
    """
    value = F.coalesce(F.col(axis).cast("string"), F.lit("")) if axis else F.lit("")
    held = stock.filter(keep).groupBy(*_ITEM, value.alias("axis")).agg(F.sum("quantity").alias("quantity"))
    named = stock.groupBy(*_ITEM).agg(F.max("raw_name").alias("raw_name"))
    own = members.filter("confirmed").select("unit_id", *_ITEM, "factor").join(held, _ITEM, "left").join(named, _ITEM, "left")
    return own.select("unit_id", *_ITEM, F.coalesce("axis", F.lit("")).alias("axis"), F.when(_blank("raw_name"), F.col("item_ref").cast("string")).otherwise(F.col("raw_name")).alias("name"), "quantity", (F.coalesce("quantity", F.lit(0)) * F.col("factor")).alias("effective"))


def axis_missing(of: DataFrame, left: str, right: str) -> DataFrame:
    """For each unit and side: whether no part that is in stock has a value on the axis. Parts that are out of stock prove nothing."""
    stocked = F.col("quantity").isNotNull()
    missing = lambda s: (F.count(F.when(stocked & (F.col("source") == s), 1)) > 0) & (F.count(F.when(stocked & (F.col("source") == s) & ~_blank("axis"), 1)) == 0)
    return of.groupBy("unit_id").agg(missing(left).alias("left_missing"), missing(right).alias("right_missing"))


def lines(of: DataFrame, axis: str, left: str, right: str) -> DataFrame:
    """A unit's parts as lines: by NAME the likest names meet, each once; by FIELD the first with the first of equal axis values; by NONE nothing meets.

    `line` numbers a unit's lines: pairs first, then by label.
    """
    place = F.struct("item_ref", "axis")
    own = of.select("unit_id", "source", place.alias("part"), "name", "axis", "effective")
    own = cut_lineage(own) if axis == "NAME" else own  # both sides are needed twice, before and after they are paired
    side = lambda s, c: own.filter(F.col("source") == s).select("unit_id", F.col("part").alias(f"{c}_part"), F.col("name").alias(f"{c}_name"), F.col("axis").alias(f"{c}_axis"), F.col("effective").alias(f"{c}_quantity"))
    a, b = side(left, "left"), side(right, "right")
    if axis == "NAME":
        bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
        # Bigrams are made once for each part, not for each pair; the generator keeps them before the join.
        grams = lambda df, c: df.select("unit_id", F.explode(F.array(F.struct(F.col(f"{c}_part").alias(f"{c}_name"), bare(f"{c}_name").alias(f"{c}_bare"), bigrams(bare(f"{c}_name")).alias(f"{c}_grams")))).alias("n")).select("unit_id", "n.*")
        score = dice(F.col("left_bare"), F.col("right_bare"), (F.col("left_grams"), F.col("right_grams")))
        scored = grams(a, "left").join(grams(b, "right"), "unit_id").select("unit_id", "left_name", "right_name", score.alias("score"))
        met = greedy_pairs(scored).select("unit_id", F.col("left_name").alias("left_part"), F.col("right_name").alias("right_part"))
    elif axis == "FIELD":
        numbered = lambda df, c: df.filter(~_blank(f"{c}_axis")).select("unit_id", F.col(f"{c}_axis").alias("axis"), f"{c}_part", F.row_number().over(Window.partitionBy("unit_id", f"{c}_axis").orderBy(f"{c}_part")).alias("n"))
        met = numbered(a, "left").join(numbered(b, "right"), ["unit_id", "axis", "n"]).select("unit_id", "left_part", "right_part")
    elif axis == "NONE":
        met = a.limit(0).join(b.limit(0), "unit_id").select("unit_id", "left_part", "right_part")
    else:
        raise ValueError(f"no axis {axis}")
    joined = a.join(met, ["unit_id", "left_part"], "left").join(b, ["unit_id", "right_part"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = joined.select("unit_id", F.col("left_part.item_ref").alias("left_item"), F.col("right_part.item_ref").alias("right_item"), F.coalesce("left_name", "right_name").alias("label"), F.coalesce("left_axis", "right_axis").alias("axis"), zero("left_quantity").alias("left_quantity"), zero("right_quantity").alias("right_quantity"), (F.col("left_part").isNotNull() & F.col("right_part").isNotNull()).alias("paired"))
    order = Window.partitionBy("unit_id").orderBy(F.desc("paired"), "label", F.col("left_item").asc_nulls_last(), "right_item", "axis")
    return found.withColumn("line", F.row_number().over(order))


def _stock(spark, sf_dir) -> DataFrame:
    at = view(spark, sf_dir, "snapshot").filter(F.col("base_at") == F.lit(AT).cast("timestamp_ntz"))
    return at.join(names._names(spark, sf_dir), _ITEM)


def _items(spark, sf_dir) -> DataFrame:
    marks = names._names(spark, sf_dir).filter("item_ref % 7 = 0").select(*_ITEM, F.lit("NO_MATE").alias("reason"))
    return keyed(overlay(_stock(spark, sf_dir), view(spark, sf_dir, "member"), marks))


def _rows(spark, sf_dir, needle: str = "") -> DataFrame:
    units = view(spark, sf_dir, "member").filter("unit_id % 10 <> 0").select("unit_id", F.concat(F.lit("unit "), F.col("unit_id").cast("string")).alias("unit_name")).distinct()
    return board_rows(_items(spark, sf_dir), units, LEFT, needle)


def _parts(spark, sf_dir, axis: str | None = None) -> DataFrame:
    return parts(_stock(spark, sf_dir), view(spark, sf_dir, "member").withColumn("unit_id", F.floor(F.col("item_ref") / 8)), F.col("warehouse_code") != "3", axis)


_LINE = ("unit_id", "left_item", "right_item", "label", "left_quantity", "right_quantity", "paired", "line")

QUERIES = {
    "board_rows": lambda s, d: _rows(s, d),
    "board_page": lambda s, d: page(_rows(s, d), "TODO", 0).select("key", "kind", "name"),
    "board_search_page": lambda s, d: page(_rows(s, d, " UNIT 1"), "ALL", 1).select("key", "kind", "name"),
    "board_page_items": lambda s, d: items_of(_items(s, d), page(_rows(s, d), "LINKED", 0), LEFT),
    "breakdown_lines_field": lambda s, d: lines(_parts(s, d, "lot_code"), "FIELD", LEFT, RIGHT).select(*_LINE, "axis"),
    "breakdown_lines_none": lambda s, d: lines(_parts(s, d), "NONE", LEFT, RIGHT).select(*_LINE),
    "breakdown_lines_name": lambda s, d: lines(_parts(s, d), "NAME", LEFT, RIGHT).select(*_LINE),
    "breakdown_axis_missing": lambda s, d: axis_missing(_parts(s, d, "lot_code").withColumn("axis", F.when(F.col("item_ref") % 3 == 0, F.col("axis")).otherwise("")), LEFT, RIGHT),
}

_BASE = f"""{with_views('member', 'snapshot')}, {names._N}, stock AS (SELECT * FROM snapshot JOIN names USING (source, item_ref) WHERE base_at = TIMESTAMP '{AT}')"""
_ROWS = f"""{_BASE}, held AS (SELECT source, item_ref, max(raw_name) AS raw_name, sum(quantity) AS quantity FROM stock GROUP BY ALL),
    i AS (SELECT source, item_ref, coalesce(raw_name, CAST(item_ref AS VARCHAR)) AS display, CAST(quantity AS BIGINT) AS quantity, CAST(coalesce(quantity, 0) * coalesce(factor, 1) AS BIGINT) AS effective, unit_id, coalesce(confirmed, false) AS confirmed, CASE WHEN item_ref % 7 = 0 THEN 'NO_MATE' END AS reason FROM held FULL JOIN member USING (source, item_ref)),
    k AS (SELECT *, CASE WHEN unit_id IS NOT NULL THEN 'U:' || unit_id WHEN reason IS NOT NULL THEN 'X:' || source || '|' || item_ref WHEN {names._NORMAL.format('display')} = '' THEN 'N:' || source || '|' || item_ref ELSE 'N:' || {names._NORMAL.format('display')} END AS key FROM i),
    g AS (SELECT key, max(unit_id) AS unit_id, max(reason) AS reason, max(unit_id) IS NOT NULL AND bool_and(confirmed) AS confirmed, bool_or(quantity IS NULL) AS missing, count(*) FILTER (WHERE source = 'erp') AS left_items, count(*) FILTER (WHERE source <> 'erp') AS right_items,
      CAST(coalesce(sum(effective) FILTER (WHERE source = 'erp'), 0) AS BIGINT) AS left_total, CAST(coalesce(sum(effective) FILTER (WHERE source <> 'erp'), 0) AS BIGINT) AS right_total, arg_min(display, (source <> 'erp', item_ref)) AS first, bool_or(contains(lower(display), 'unit 1') OR contains(CAST(item_ref AS VARCHAR), 'unit 1')) AS hit FROM k GROUP BY key),
    b AS (SELECT *, CASE WHEN unit_id IS NOT NULL THEN 'LINKED' WHEN reason IS NOT NULL THEN 'SET_ASIDE' WHEN left_items > 0 AND right_items > 0 THEN 'PAIRED' WHEN left_items > 0 THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS kind,
      CASE WHEN unit_id IS NULL THEN first WHEN unit_id % 10 <> 0 THEN 'unit ' || unit_id ELSE '{NAMELESS}' END AS name, left_total - right_total AS diff, CASE WHEN greatest(abs(left_total), abs(right_total)) = 0 THEN 0.0 ELSE round(100 * abs(left_total - right_total) / greatest(abs(left_total), abs(right_total)), 1) END AS percent FROM g)"""
_PARTS = f"""{_BASE}, m AS (SELECT item_ref // 8 AS unit_id, source, item_ref, factor FROM member WHERE confirmed), named AS (SELECT source, item_ref, max(raw_name) AS raw_name FROM stock GROUP BY ALL),
    held AS (SELECT source, item_ref, {{0}} AS axis, sum(quantity) AS quantity FROM stock WHERE warehouse_code <> '3' GROUP BY ALL),
    p AS (SELECT unit_id, source, item_ref, coalesce(axis, '') AS axis, coalesce(raw_name, CAST(item_ref AS VARCHAR)) AS name, quantity, CAST(coalesce(quantity, 0) * factor AS BIGINT) AS effective FROM m LEFT JOIN held USING (source, item_ref) LEFT JOIN named USING (source, item_ref))"""
_NUMBERED = "row_number() OVER (PARTITION BY unit_id ORDER BY paired DESC, label, left_item NULLS LAST, right_item, axis) AS line"
SQL = {
    "board_rows": f"{_ROWS} SELECT key, kind, name, unit_id, reason, confirmed, missing, left_items, right_items, left_total, right_total, diff, percent FROM b",
    "board_page": f"{_ROWS} SELECT key, kind, name FROM b WHERE kind IN ('PAIRED', 'LEFT_ONLY', 'RIGHT_ONLY') ORDER BY name, key LIMIT {PAGE}",
    "board_search_page": f"{_ROWS} SELECT key, kind, name FROM b WHERE hit OR contains(lower(name), 'unit 1') ORDER BY name, key LIMIT {PAGE} OFFSET {PAGE}",
    "board_page_items": f"{_ROWS}, x AS (SELECT key FROM b WHERE kind = 'LINKED' ORDER BY name, key LIMIT {PAGE}) SELECT key, CASE source WHEN 'erp' THEN 'left' ELSE 'right' END AS side, source, item_ref, display, quantity, effective FROM k JOIN x USING (key)",
    "breakdown_lines_field": f"""{_PARTS.format('lot_code')}, n AS (SELECT *, row_number() OVER (PARTITION BY unit_id, source, axis ORDER BY item_ref) AS n, CASE axis WHEN '' THEN source || item_ref ELSE '=' || axis END AS key FROM p),
        j AS (SELECT unit_id, l.item_ref AS left_item, r.item_ref AS right_item, coalesce(l.name, r.name) AS label, coalesce(l.axis, r.axis) AS axis, coalesce(l.effective, 0) AS left_quantity, coalesce(r.effective, 0) AS right_quantity, l.item_ref IS NOT NULL AND r.item_ref IS NOT NULL AS paired
        FROM (SELECT * FROM n WHERE source = 'erp') l FULL JOIN (SELECT * FROM n WHERE source = 'wms') r USING (unit_id, key, n)) SELECT *, {_NUMBERED} FROM j""",
    "breakdown_lines_none": f"""{_PARTS.format("''")}, j AS (SELECT unit_id, CASE source WHEN 'erp' THEN item_ref END AS left_item, CASE source WHEN 'wms' THEN item_ref END AS right_item, name AS label, axis, CASE source WHEN 'erp' THEN effective ELSE 0 END AS left_quantity, CASE source WHEN 'wms' THEN effective ELSE 0 END AS right_quantity, false AS paired FROM p)
        SELECT unit_id, left_item, right_item, label, left_quantity, right_quantity, paired, {_NUMBERED} FROM j""",
    "breakdown_axis_missing": f"""{_PARTS.format('lot_code')}, x AS (SELECT unit_id, source, quantity, CASE WHEN item_ref % 3 = 0 THEN axis ELSE '' END AS axis FROM p)
        SELECT unit_id, {', '.join(f"count(*) FILTER (WHERE quantity IS NOT NULL AND source = '{s}') > 0 AND count(*) FILTER (WHERE quantity IS NOT NULL AND source = '{s}' AND axis <> '') = 0 AS {n}" for s, n in (('erp', 'left_missing'), ('wms', 'right_missing')))} FROM x GROUP BY unit_id""",
}
