"""Small listings and look-ups over the domain: headers, mappings, pending rows, presets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import NAME_PRESETS, normalize_field_name, week_start
from lakeloom.operators import names
from lakeloom.operators.transform import _orders, held_fields
from lakeloom.sources.domain import view, with_views

#: What a listing shows for a SKU that is gone.
GONE_CODE, GONE_NAME = "(삭제됨)", "-"


def optional(column: str, value) -> Column:
    """A condition that holds for all rows where no value is asked for."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def unmapped_lines(lines: DataFrame, item: int, line_no: int | None = None) -> DataFrame:
    """Lines of an item that have no SKU yet, of all its options or one."""
    return lines.filter((F.col("item") == item) & optional("line_no", line_no) & F.col("sku_id").isNull())


def unit_headers(units: DataFrame, members: DataFrame, left: str, right: str) -> DataFrame:
    """Units with their confirmed members on either side; units without any have 0."""
    confirmed = members.filter("confirmed").select("unit_id", "source")
    count = lambda s: F.count(F.when(F.col("source") == s, 1))
    return units.join(confirmed, "unit_id", "left").groupBy("unit_id").agg(count(left).alias("left_parts"), count(right).alias("right_parts"))


def mapping_list(mappings: DataFrame, skus: DataFrame) -> DataFrame:
    """Mappings with code and name of their SKU, or a placeholder."""
    named = mappings.join(skus.select("sku_id", "code", "name"), "sku_id", "left")
    return named.withColumns({"code": F.coalesce("code", F.lit(GONE_CODE)), "name": F.coalesce("name", F.lit(GONE_NAME))})


def remembered(connections: DataFrame) -> DataFrame:
    """How often each source field was connected to each target: by normalised name, blank ones left out."""
    key = normalize_field_name(F.col("field"))
    named = connections.select(key.alias("field"), "model", "target").filter((F.col("field") != "") & (F.trim("target") != ""))
    return named.groupBy("field", "model", "target").agg(F.count(F.lit(1)).alias("hits"))


def unconnected(fields: DataFrame, connections: DataFrame) -> DataFrame:
    """Source fields that no target is connected to."""
    return fields.join(connections.select("field"), "field", "left_anti")


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's values in the order in which they were first seen."""
    firsts = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return firsts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def matching(board: DataFrame, needle: str) -> DataFrame:
    """Rows of a board whose reference or name holds a word, upper and lower case alike."""
    has = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower()))
    return board.filter(has("item_ref") | has("raw_name"))


def latest_success(runs: DataFrame) -> DataFrame:
    """The last good run of all."""
    return runs.filter("ok").agg(F.max(F.struct("at", "id", "key")).alias("r")).select("r.*")


def pending(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Rows that wait, the oldest first."""
    return rows.filter("waiting").orderBy("ts", "event_id").limit(limit)


def stale(runs: DataFrame, now: dt.datetime, hours: int) -> DataFrame:
    """Runs still marked as running after so many hours become failed."""
    late = (F.col("status") == "RUNNING") & (F.col("started") < F.lit(now - dt.timedelta(hours=hours)).cast("timestamp_ntz"))
    return runs.withColumn("status", F.when(late, "FAILED").otherwise(F.col("status")))


def conversions(rules: DataFrame) -> DataFrame:
    """Unit rules in the order in which a list shows them: those of an item first, general ones last."""
    place = F.row_number().over(names.Window.partitionBy("from_unit").orderBy(F.coalesce("item_ref", F.lit("")) == "", "item_ref", "factor"))
    return rules.withColumn("place", place.cast("bigint"))


def date_range(preset: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a preset, both included; weeks start on Monday."""
    week, month = week_start(today), F.trunc(today, "month")
    last_month = F.trunc(F.add_months(today, -1), "month")
    yesterday = F.date_sub(today, 1)
    return {
        "TODAY": (today, today), "YESTERDAY": (yesterday, yesterday), "THIS_WEEK": (week, today), "LAST_WEEK": (F.date_sub(week, 7), F.date_sub(week, 1)),
        "THIS_MONTH": (month, today), "LAST_MONTH": (last_month, F.last_day(last_month)), "CUSTOM": (today, today),
    }[preset]


def allows_push(before: Column, after: Column, most: int = 50) -> Column:
    """Whether a stock change is small enough to be sent without a person's look."""
    return F.abs(after - before) <= most


#: Bucket sizes in seconds, the finest first.
GRANULARITIES = {"EXACT": 0, "TEN_MINUTES": 600, "HOUR": 3600, "DAY": 86400}


def finer(a: Column, b: Column) -> Column:
    """Whether granularity `a` is finer than `b`."""
    sizes = F.create_map(*[F.lit(x) for pair in GRANULARITIES.items() for x in pair])
    return sizes[a] < sizes[b]


def base_instant(explicit: Column, configured: Column, now: Column) -> Column:
    """An explicit day, else the configured one, else the start of today (UTC times of local days)."""
    start = lambda day: day.cast("timestamp_ntz") - F.expr("INTERVAL 9 HOURS")
    return F.coalesce(start(explicit), start(configured), F.date_trunc("day", now + F.expr("INTERVAL 9 HOURS")).cast("timestamp_ntz") - F.expr("INTERVAL 9 HOURS"))


def name_presets(rows: DataFrame, column: str = "raw_name") -> DataFrame:
    """A name as each preset leaves it."""
    return rows.withColumns({key.replace("-", "_"): F.regexp_replace(column, pattern, "") for key, pattern in NAME_PRESETS.items()})


def scoped(column: str, source: str, rules: list[tuple[str | None, str, str]]) -> Column:
    """Rules (source, pattern, replacement) one after the other; those without a source apply to all."""
    out = F.col(column)
    for only, pattern, replacement in rules:
        done = F.regexp_replace(out, pattern, replacement)
        out = done if only is None else F.when(F.col(source) == only, done).otherwise(out)
    return out


def name_suggestions(units: DataFrame, names_: DataFrame) -> DataFrame:
    """Shorter names for units (unit_id, unit_name) that have several names on a side: what the names have in common."""
    sides = names_.distinct().groupBy("unit_id", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("unit_id").agg(F.max("n").alias("most")).filter("most >= 2")
    common = names.common_start(names_.select("unit_id", "name")).select("unit_id", F.col("common").alias("suggested"))
    found = units.join(sides, "unit_id", "left_semi").join(common, "unit_id")
    return found.filter((F.col("suggested") != F.col("unit_name")) & (F.length("suggested") < F.length("unit_name")))


TAXONOMY = "array<struct<code:string,name:string,coefficient:double,seedKeywords:array<string>>>"


def taxonomy(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Categories of taxonomy bodies, one row for each seed keyword."""
    return bodies.select(F.inline(F.from_json(column, TAXONOMY))).select("code", "coefficient", F.explode("seedKeywords").alias("keyword")).distinct()


def script_value(c: Column) -> Column:
    """A script's value as text by its type: numbers without needless zeros, booleans in lower case, other text as it is."""
    number = c.rlike(r"^-?\d+(\.\d+)?$")
    plain = F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number & F.contains(c, F.lit(".")), plain).when(F.lower(c).isin("true", "false"), F.lower(c)).otherwise(c)


def _lines(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "order_line")


def _alerts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").withColumn("waiting", F.col("event_type") == "error")


def _runs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))


def _connections(spark, sf_dir) -> DataFrame:
    e = view(spark, sf_dir, "alert")
    return e.select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat_ws("_ ", "event_type", F.lit(""))).alias("field"), F.lit("stock").alias("model"), F.element_at(F.array(F.lit("quantity"), F.lit("item_ref"), F.lit(" ")), (F.col("user_id") % 3 + 1).cast("int")).alias("target"))


def _labelled(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    tail = F.when(k % 7 == 0, " (26.10.17)").when(k % 7 == 1, " [26.10.17]").when(k % 7 == 2, "_26.12.12").when(k % 7 == 3, " 70g").when(k % 7 == 4, " x12ea").when(k % 7 == 5, " 1.5 kg/box").otherwise("-a")
    return part.select(k.alias("item_ref"), F.when(k % 2 == 0, names.LEFT).otherwise(names.RIGHT).alias("source"), F.concat("p_name", tail).alias("raw_name"))


def _preset_rows(spark, sf_dir) -> DataFrame:
    days = view(spark, sf_dir, "alert").select(F.to_date("ts").alias("today")).distinct()
    out = days
    for preset in ("YESTERDAY", "THIS_WEEK", "LAST_WEEK", "THIS_MONTH", "LAST_MONTH"):
        first, last = date_range(preset, F.col("today"))
        out = out.withColumn(preset.lower(), F.concat_ws("..", F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")))
    return out.withColumn("today", F.date_format("today", "yyyy-MM-dd"))


def _suggested(spark, sf_dir) -> DataFrame:
    named = names._unit_names(spark, sf_dir).withColumn("name", F.concat(F.lit("Camp (a"), (F.col("unit_id") % 3).cast("string"), F.lit(") "), "name"))
    units = named.groupBy("unit_id").agg(F.max("name").alias("unit_name"))
    return name_suggestions(units, named)


def _guards(spark, sf_dir) -> DataFrame:
    sku = view(spark, sf_dir, "sku")
    size = F.element_at(F.array(*[F.lit(g) for g in GRANULARITIES]), (F.col("sku_id") % 4 + 1).cast("int"))
    now = F.lit(dt.datetime(2024, 2, 5, 16, 30)).cast("timestamp_ntz")
    day = lambda n, text: F.when(F.col("sku_id") % n == 0, F.lit(text).cast("date"))
    return sku.select("sku_id", allows_push(F.col("quantity"), F.col("safety_threshold")).alias("may_push"), finer(size, F.lit("HOUR")).alias("finer"), F.date_format(base_instant(day(5, "2024-01-10"), day(3, "2024-01-20"), now), "yyyy-MM-dd HH:mm").alias("base"), script_value(F.concat(F.col("quantity").cast("string"), F.lit(".50"))).alias("value"))



def _unit_rules(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(F.col("p_partkey") % 50 != 0, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).otherwise("").alias("item_ref"), F.col("p_brand").alias("from_unit"), F.col("p_size").alias("factor"))


def _taxonomies(spark, sf_dir) -> DataFrame:
    """A body of categories for each brand: types of goods with the names of their parts as seed keywords, some twice."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    seeds = part.select("p_brand", "p_type", F.explode(F.array(F.lower("p_name"), F.when(F.col("p_size") % 2 == 0, F.lower("p_name")))).alias("seed"))
    one = seeds.groupBy("p_brand", F.col("p_type").alias("code")).agg(F.collect_list("seed").alias("seedKeywords"), F.count("seed").alias("n"))
    listed = F.collect_list(F.struct("code", F.lit("x").alias("name"), (F.col("n") / 4).alias("coefficient"), "seedKeywords"))
    return one.groupBy("p_brand").agg(F.to_json(listed).alias("body"))


QUERIES = {
    "unmapped_for_item": lambda s, d: unmapped_lines(_lines(s, d), 17).select("order_no", "line_no"),
    "unmapped_for_option": lambda s, d: unmapped_lines(_lines(s, d), 17, 1).select("order_no", "line_no"),
    "unit_headers": lambda s, d: unit_headers(view(s, d, "member").select("unit_id").distinct(), view(s, d, "member"), "erp", "wms"),
    "mapping_list": lambda s, d: mapping_list(_lines(s, d).filter("sku_id is not null").select("sku_id").distinct(), view(s, d, "sku").filter("active")),
    "mapping_memory": lambda s, d: remembered(_connections(s, d)),
    "unconnected_fields": lambda s, d: unconnected(held_fields(_orders(s, d)), s.createDataFrame([("o_orderkey",), ("o_custkey",)], "field string")),
    "first_seen_items": lambda s, d: first_seen(_lines(s, d), "order_no", "item", "line_no").select("order_no", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("items")),
    "scaled_members": lambda s, d: view(s, d, "member").filter("factor <> 1").agg(F.count(F.lit(1)).alias("n")),
    "units_pending": lambda s, d: view(s, d, "member").filter("not confirmed").select("unit_id").distinct(),
    "board_search": lambda s, d: matching(names.board(names._names(s, d), view(s, d, "member"), "erp", "wms").join(names._names(s, d), ["source", "item_ref"]), "RED").select("source", "item_ref", "kind"),
    "latest_success": lambda s, d: latest_success(_runs(s, d)).select("id", "key"),
    "pending_fifo": lambda s, d: pending(_alerts(s, d)).select("event_id"),
    "alert_samples": lambda s, d: pending(_alerts(s, d), 5).select("event_id", "alert_key"),
    "run_listing": lambda s, d: _runs(s, d).orderBy(F.desc("at"), F.desc("id")).limit(50).select("id", "key", "ok"),
    "stale_runs": lambda s, d: stale(view(s, d, "alert").select("event_id", F.col("ts").alias("started"), F.when(F.col("event_id") % 6 == 0, "RUNNING").otherwise("SUCCESS").alias("status")), dt.datetime(2024, 1, 20), 6).select("event_id", "status"),
    "conversion_list": lambda s, d: conversions(_unit_rules(s, d)).select("item_ref", "from_unit", "place", F.col("factor").cast("bigint").alias("factor")),
    "date_presets": _preset_rows,
    "name_presets": lambda s, d: name_presets(_labelled(s, d)).drop("raw_name", "source"),
    "scoped_rules": lambda s, d: _labelled(s, d).select("item_ref", scoped("raw_name", "source", [("erp", r"\([^)]*\)", ""), (None, r"\s+", " "), ("wms", "_.*$", "")]).alias("name")),
    "name_suggestions": _suggested,
    "guards": _guards,
    "taxonomy_keywords": lambda s, d: taxonomy(_taxonomies(s, d)),
}

_DAY = "strftime({0}, '%Y-%m-%d') || '..' || strftime({1}, '%Y-%m-%d')"
_RULE = lambda p: f"regexp_replace(raw_name, '{p}', '', 'g')"
_LABELLED = """l AS (SELECT p_partkey AS item_ref, CASE WHEN p_partkey % 2 = 0 THEN 'erp' ELSE 'wms' END AS source, p_name || CASE p_partkey % 7 WHEN 0 THEN ' (26.10.17)' WHEN 1 THEN ' [26.10.17]' WHEN 2 THEN '_26.12.12' WHEN 3 THEN ' 70g' WHEN 4 THEN ' x12ea' WHEN 5 THEN ' 1.5 kg/box' ELSE '-a' END AS raw_name FROM part)"""

SQL = {
    "unmapped_for_item": f"{with_views('order_line')} SELECT order_no, line_no FROM order_line WHERE item = 17 AND sku_id IS NULL",
    "unmapped_for_option": f"{with_views('order_line')} SELECT order_no, line_no FROM order_line WHERE item = 17 AND line_no = 1 AND sku_id IS NULL",
    "unit_headers": f"{with_views('member')} SELECT unit_id, count(*) FILTER (WHERE confirmed AND source = 'erp') AS left_parts, count(*) FILTER (WHERE confirmed AND source = 'wms') AS right_parts FROM member GROUP BY unit_id",
    "mapping_list": f"{with_views('order_line', 'sku')} SELECT sku_id, coalesce(code, '{GONE_CODE}') AS code, coalesce(name, '{GONE_NAME}') AS name FROM (SELECT DISTINCT sku_id FROM order_line WHERE sku_id IS NOT NULL) LEFT JOIN (SELECT * FROM sku WHERE active) USING (sku_id)",
    "mapping_memory": f"{with_views('alert')} SELECT lower(event_type) AS field, 'stock' AS model, ['quantity', 'item_ref'][user_id % 3 + 1] AS target, count(*) AS hits FROM alert WHERE user_id % 3 < 2 GROUP BY ALL",
    "unconnected_fields": "SELECT 'o_orderstatus' AS field, count(*) FILTER (WHERE o_orderstatus <> 'P') AS rows FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice > 1000) FROM orders UNION ALL SELECT 'o_orderdate', count(o_orderdate) FROM orders",
    "first_seen_items": f"{with_views('order_line')}, f AS (SELECT order_no, item, min(line_no) AS seen FROM order_line GROUP BY ALL) SELECT order_no, string_agg(CAST(item AS VARCHAR), ',' ORDER BY seen, item) AS items FROM f GROUP BY order_no",
    "scaled_members": f"{with_views('member')} SELECT count(*) AS n FROM member WHERE factor <> 1",
    "units_pending": f"{with_views('member')} SELECT DISTINCT unit_id FROM member WHERE NOT confirmed",
    "board_search": f"{names._BOARD} SELECT source, item_ref, kind FROM board JOIN names USING (source, item_ref) WHERE contains(lower(raw_name), 'red') OR contains(CAST(item_ref AS VARCHAR), 'red')",
    "latest_success": f"{with_views('alert')} SELECT event_id AS id, user_id AS key FROM alert WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 1",
    "pending_fifo": f"{with_views('alert')} SELECT event_id FROM alert WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100",
    "alert_samples": f"{with_views('alert')} SELECT event_id, alert_key FROM alert WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 5",
    "run_listing": f"{with_views('alert')} SELECT event_id AS id, user_id AS key, event_type <> 'error' AS ok FROM alert ORDER BY ts DESC, event_id DESC LIMIT 50",
    "stale_runs": f"{with_views('alert')} SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN 'SUCCESS' WHEN ts < TIMESTAMP '2024-01-19 18:00:00' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM alert",
    "conversion_list": "SELECT item_ref, from_unit, row_number() OVER (PARTITION BY from_unit ORDER BY item_ref = '', item_ref, factor) AS place, CAST(factor AS BIGINT) AS factor FROM (SELECT CASE WHEN p_partkey % 50 <> 0 THEN 'P' || p_partkey ELSE '' END AS item_ref, p_brand AS from_unit, p_size AS factor FROM part)",
    "date_presets": f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS t FROM events), w AS (SELECT t, CAST(date_trunc('week', t) AS DATE) AS w, CAST(date_trunc('month', t) AS DATE) AS m, CAST(date_trunc('month', t) - INTERVAL 1 MONTH AS DATE) AS b FROM d)
        SELECT strftime(t, '%Y-%m-%d') AS today, {_DAY.format('t - 1', 't - 1')} AS yesterday, {_DAY.format('w', 't')} AS this_week, {_DAY.format('w - 7', 'w - 1')} AS last_week, {_DAY.format('m', 't')} AS this_month, {_DAY.format('b', 'm - 1')} AS last_month FROM w""",
    "name_presets": f"WITH {_LABELLED} SELECT item_ref, " + ", ".join(f"{_RULE(p)} AS {k.replace('-', '_')}" for k, p in NAME_PRESETS.items()) + " FROM l",
    "scoped_rules": f"WITH {_LABELLED}, a AS (SELECT item_ref, source, regexp_replace(CASE source WHEN 'erp' THEN regexp_replace(raw_name, '\\([^)]*\\)', '', 'g') ELSE raw_name END, '\\s+', ' ', 'g') AS x FROM l) SELECT item_ref, CASE source WHEN 'wms' THEN regexp_replace(x, '_.*$', '', 'g') ELSE x END AS name FROM a",
    "name_suggestions": names.SQL["common_name"].replace("SELECT unit_id, n, CASE WHEN length(tidy) >= 2 THEN tidy END AS common FROM t", "SELECT unit_id, unit_name, tidy AS suggested FROM t JOIN (SELECT unit_id, max(name) AS unit_name FROM (SELECT unit_id, concat('Camp (a', unit_id % 3, ') ', name) AS name FROM u) GROUP BY unit_id) USING (unit_id) WHERE length(tidy) >= 2 AND length(tidy) < length(unit_name) AND unit_id IN (SELECT unit_id FROM u GROUP BY unit_id, source HAVING count(*) >= 2)"),
    "guards": f"""{with_views('sku')} SELECT sku_id, abs(quantity - safety_threshold) <= 50 AS may_push, sku_id % 4 < 2 AS finer, CASE WHEN sku_id % 5 = 0 THEN '2024-01-09 15:00' WHEN sku_id % 3 = 0 THEN '2024-01-19 15:00' ELSE '2024-02-05 15:00' END AS base, CAST(quantity AS VARCHAR) || '.5' AS value FROM sku""",
    "taxonomy_keywords": "WITH c AS (SELECT p_brand, p_type AS code, sum(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END) / 4 AS coefficient FROM part GROUP BY ALL) SELECT DISTINCT code, coefficient, lower(p_name) AS keyword FROM c JOIN part p ON p.p_brand = c.p_brand AND p.p_type = c.code",
}
