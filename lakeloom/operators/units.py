"""Edits of units of items (split, unlink, discard), their names, and suggestions of what a source field means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import normalize_field_name
from lakeloom.operators import names
from lakeloom.operators.names import LEFT
from lakeloom.sources.domain import view, with_views

_ITEM = ["source", "item_ref"]
#: Points of an alias, of a name within the field's name, of values of the same kind, and of connections made before.
ALIAS, NAME, KIND, BEFORE, AGAIN, MOST_BEFORE, ENOUGH = 100, 60, 40, 70, 10, 95, 80
#: The longest part of a field's name that is looked up among targets.
LONGEST = 60


def still_active(units: DataFrame, members: DataFrame) -> DataFrame:
    """Units that have no member left are no longer active."""
    return units.join(members.select("unit_id").distinct().withColumn("__has", F.lit(True)), "unit_id", "left").withColumn("active", F.col("active") & F.col("__has").isNotNull()).drop("__has")


def split(members: DataFrame, units: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and units after items (source, item_ref) moved to new units (to, name). Groups name known members only; items that no group names stay, and a unit that they all left is folded."""
    wanted = groups.select(*_ITEM, "to")
    moved = members.join(wanted, _ITEM, "left").withColumn("unit_id", F.coalesce("to", "unit_id")).drop("to")
    made = groups.join(members.select(*_ITEM), _ITEM, "left_semi").groupBy(F.col("to").alias("unit_id")).agg(F.min("name").alias("name")).withColumn("active", F.lit(True))
    return moved, still_active(units.unionByName(made), moved)


def unlink(members: DataFrame, units: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and units after whole units (unit_id) were taken apart."""
    left = members.join(gone.select("unit_id"), "unit_id", "left_anti")
    return left, units.join(gone.select("unit_id", F.lit(True).alias("__gone")).distinct(), "unit_id", "left").withColumn("active", F.col("active") & F.col("__gone").isNull()).drop("__gone")


def discard_pending(members: DataFrame, units: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and units after the unconfirmed members of some units were dropped; a unit without others is folded."""
    dropped = members.filter(~F.col("confirmed")).join(of.select("unit_id"), "unit_id", "left_semi")
    left = members.join(dropped.select(*_ITEM, "unit_id"), [*_ITEM, "unit_id"], "left_anti")
    return left, still_active(units, left)


def unit_names(items: DataFrame, rule: str, left: str, least: int = 2) -> DataFrame:
    """A name for each unit from its items' (unit_id, source, item_ref, name): COMMON, FIRST_ITEM or MANUAL (none); '' if there is nothing to make it of.

    COMMON is the common start of the larger side's names (of two alike, the left), without an open bracket and marks at its end; one
    name is itself, and if too little is common the first one is taken. A group's common start is that of its least and greatest name.
    """
    side = F.when(F.col("source") == left, 0).otherwise(1).alias("side")
    if rule == "MANUAL":
        return items.select("unit_id").distinct().withColumn("name", F.lit(""))
    if rule == "FIRST_ITEM":
        first = F.min(F.struct(side, "item_ref", F.coalesce("name", F.lit("")).alias("name")))
        return items.groupBy("unit_id").agg(first["name"].alias("name"))
    if rule != "COMMON":
        raise ValueError(f"no unit name rule {rule}")
    good = F.trim(F.coalesce("name", F.lit(""))) != ""
    sides = items.groupBy("unit_id", side).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(good, F.col("name"))).alias("a"), F.max(F.when(good, F.col("name"))).alias("b"), F.min(F.when(good, F.struct("item_ref", "name")))["name"].alias("first"), F.count(F.when(good, 1)).alias("usable"))
    larger = sides.groupBy("unit_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "side", "a", "b", "first", "usable")).alias("s")).select("unit_id", "s.*")
    shorter = F.least(F.length("a"), F.length("b"))
    size = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    start = F.substring(F.col("a"), F.lit(1), F.when(shorter > 0, size).otherwise(0))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(start, r"[(\[{][^)\]}]*$", ""), r"[ ,_/.(\-]+$", ""))
    first = F.trim("first")
    name = F.when(F.col("usable") == 0, "").when(F.col("usable") == 1, first).when(F.length(tidy) >= least, tidy).otherwise(first)
    return larger.select("unit_id", name.alias("name"))


def suggested(fields: DataFrame, targets: DataFrame, history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best target of each source field with enough points, each target once, and the reasons.

    Fields (field, kind, place) and targets (target, kind, aliases, place) may belong to connectors (`by`). Points come from an alias, from the
    target's name within the field's, from values of the same kind, and from `history` (field normalised, target, hits).
    A field takes its best target, of equal ones the first; of two fields with one target the better keeps it. Every pair
    comes from a join on equal names, as kinds alone are never enough.
    """
    key = list(by)
    named = fields.withColumn("__name", normalize_field_name(F.col("field")))
    alias = targets.select("target", F.explode(F.split(F.coalesce("aliases", F.lit("")), r"\|")).alias("alias")).select("target", normalize_field_name(F.col("alias")).alias("__name")).filter("__name <> ''").distinct()
    pick = lambda joined, points, why: joined.select(*key, "field", "target", points.cast("int").alias("points"), F.lit(why).alias("why"))
    by_alias = pick(named.join(alias, "__name"), F.lit(ALIAS), "alias")
    length = F.least(F.length("__name"), F.lit(LONGEST))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("__name")), lambda i: F.transform(F.sequence(F.lit(1), F.least(length, F.length("__name") - i + 1)), lambda n: F.substring("__name", i, n))))
    inside = named.filter("__name <> ''").select(*key, "field", F.explode(F.array_distinct(parts)).alias("__part"))
    by_name = pick(inside.join(targets.select("target", normalize_field_name(F.col("target")).alias("__part")).filter("__part <> ''"), "__part"), F.lit(NAME), "name")
    times = F.least(F.lit(MOST_BEFORE), BEFORE + (F.col("hits") - 1) * AGAIN)
    by_history = pick(named.join(history.select(F.col("field").alias("__name"), "target", "hits"), "__name").join(targets.select("target"), "target", "left_semi"), times, "history")
    pairs = by_alias.unionByName(by_name).unionByName(by_history)
    met = pairs.groupBy(*key, "field", "target").agg(F.sum("points").alias("points"), F.sort_array(F.collect_set("why")).alias("why"))
    met = met.join(fields.select(*key, "field", F.col("kind").alias("__fk"), F.col("place").alias("__fp")), [*key, "field"]).join(targets.select("target", F.col("kind").alias("__tk"), F.col("place").alias("__tp")), "target")
    same = F.coalesce(F.col("__fk") == F.col("__tk"), F.lit(False))
    score = met.withColumns({"score": F.col("points") + F.when(same, KIND).otherwise(0), "why": F.when(same, F.array_append("why", F.lit("kind"))).otherwise(F.col("why"))}).filter(F.col("score") >= ENOUGH)
    best = score.groupBy(*key, "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "__tp", "target", "__fp", "why")).alias("b")).select(*key, "field", "b.*")
    return best.groupBy(*key, "target").agg(F.min(F.struct("s", "__fp", "field", "why")).alias("b")).select(*key, "target", F.col("b.field").alias("field"), (-F.col("b.s")).alias("score"), F.array_join("b.why", ",").alias("why"))


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    members = view(spark, sf_dir, "member")
    return members, members.select("unit_id").distinct().select("unit_id", F.concat(F.lit("unit "), F.col("unit_id").cast("string")).alias("name"), F.lit(True).alias("active"))


def _split(spark, sf_dir) -> DataFrame:
    """Units below 50 are split: items of even numbers to one new unit, those divisible by 3 of the others to another; then one in ten is unlinked, and pending members of every fourth are dropped."""
    members, units = _members(spark, sf_dir)
    groups = members.filter("unit_id < 50 and (item_ref % 2 = 0 or item_ref % 3 = 0)").select(*_ITEM, (F.col("unit_id") + F.when(F.col("item_ref") % 2 == 0, 1000).otherwise(2000)).alias("to"), F.lit("made").alias("name"))
    members, units = split(members, units, groups)
    members, units = unlink(members, units, units.filter("unit_id % 10 = 7").select("unit_id"))
    members, units = discard_pending(members, units, units.filter("unit_id % 4 = 1").select("unit_id"))
    counts = members.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))
    return units.join(counts, "unit_id", "left").select("unit_id", "name", "active", F.coalesce("n", F.lit(0)).alias("n"))


def _named(spark, sf_dir) -> DataFrame:
    """Items in units of twelve; every third unit has more right items than left ones, and one in five names is blank."""
    rows = names._names(spark, sf_dir).withColumn("unit_id", F.floor(F.col("item_ref") / 12)).filter("source = 'wms' or unit_id % 3 <> 0 or item_ref % 2 = 0")
    return rows.select("unit_id", "source", "item_ref", F.when(F.col("item_ref") % 5 != 0, F.concat(F.lit("Camp (a"), (F.col("unit_id") % 3).cast("string"), F.when(F.col("unit_id") % 2 == 0, ") ").otherwise(" "), "raw_name")).otherwise(" ").alias("name"))


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each brand's feed has a field for each of its parts; lines say how often such a field was connected to one of seven targets."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fields = part.select(F.col("p_brand").alias("feed"), F.concat(F.lit(" Col "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 50 == 0, " target3").otherwise("")).alias("field"), F.when(F.col("p_size") % 2 == 0, "STRING").otherwise("INTEGER").alias("kind"), F.col("p_partkey").alias("place"))
    targets = spark.range(7).select(F.concat(F.lit("target"), F.col("id").cast("string")).alias("target"), F.when(F.col("id") % 2 == 0, "STRING").otherwise("INTEGER").alias("kind"), F.concat(F.lit("x|col1"), F.col("id").cast("string")).alias("aliases"), F.col("id").alias("place"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1")
    history = lines.groupBy(F.concat(F.lit("col"), F.col("l_partkey").cast("string")).alias("field"), F.concat(F.lit("target"), (F.col("l_suppkey") % 7).cast("string")).alias("target")).agg(F.count(F.lit(1)).alias("hits"))
    return fields, targets, history


QUERIES = {
    "unit_split_unlink": _split,
    "unit_names_common": lambda s, d: unit_names(_named(s, d), "COMMON", LEFT),
    "unit_names_first": lambda s, d: unit_names(_named(s, d), "FIRST_ITEM", LEFT),
    "field_suggestions": lambda s, d: suggested(*_feeds(s, d), by=["feed"]).select("feed", "target", "field", "score"),
}

_NAMED = f"""WITH {names._N}, i AS (SELECT item_ref // 12 AS unit_id, source, item_ref, CASE WHEN item_ref % 5 <> 0 THEN 'Camp (a' || (item_ref // 12) % 3 || CASE WHEN (item_ref // 12) % 2 = 0 THEN ') ' ELSE ' ' END || raw_name ELSE ' ' END AS name FROM names WHERE source = 'wms' OR (item_ref // 12) % 3 <> 0 OR item_ref % 2 = 0)"""
SQL = {
    "unit_names_common": f"""{_NAMED}, s AS (SELECT unit_id, source, count(*) AS n FROM i GROUP BY ALL), l AS (SELECT unit_id, arg_min(source, (-n, source <> 'erp')) AS source FROM s GROUP BY unit_id),
        e AS (SELECT unit_id, min(name) FILTER (WHERE trim(name) <> '') AS a, max(name) FILTER (WHERE trim(name) <> '') AS b, arg_min(name, item_ref) FILTER (WHERE trim(name) <> '') AS first, count(*) FILTER (WHERE trim(name) <> '') AS usable FROM i JOIN l USING (unit_id, source) GROUP BY unit_id),
        t AS (SELECT *, trim(regexp_replace(regexp_replace(substring(a, 1, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: substring(a, 1, k) = substring(b, 1, k))), 0)), '[(\\[{{][^)\\]}}]*$', ''), '[ ,_/.(\\-]+$', '')) AS tidy FROM e)
        SELECT unit_id, CASE WHEN usable = 0 THEN '' WHEN usable = 1 THEN trim(first) WHEN length(tidy) >= 2 THEN tidy ELSE trim(first) END AS name FROM t""",
    "unit_names_first": f"{_NAMED} SELECT unit_id, arg_min(name, (source <> 'erp', item_ref)) AS name FROM i GROUP BY unit_id",
    "unit_split_unlink": f"""{with_views('member')}, a AS (SELECT * REPLACE (CASE WHEN unit_id < 50 AND item_ref % 2 = 0 THEN unit_id + 1000 WHEN unit_id < 50 AND item_ref % 3 = 0 THEN unit_id + 2000 ELSE unit_id END AS unit_id) FROM member),
        u AS (SELECT DISTINCT unit_id, 'unit ' || unit_id AS name FROM member UNION ALL SELECT DISTINCT unit_id, 'made' FROM a WHERE unit_id >= 1000),
        b AS (SELECT * FROM a WHERE unit_id % 10 <> 7 AND (confirmed OR unit_id % 4 <> 1)), n AS (SELECT unit_id, count(*) AS n FROM b GROUP BY unit_id),
        was AS (SELECT DISTINCT unit_id FROM a)
        SELECT unit_id, name, coalesce(n, 0) > 0 AND unit_id IN (SELECT unit_id FROM was) AS active, coalesce(n, 0) AS n FROM u LEFT JOIN n USING (unit_id)""",
    "field_suggestions": f"""WITH f AS (SELECT p_brand AS feed, ' Col ' || p_partkey || CASE WHEN p_partkey % 50 = 0 THEN ' target3' ELSE '' END AS field, 'col' || p_partkey || CASE WHEN p_partkey % 50 = 0 THEN 'target3' ELSE '' END AS name, p_size % 2 AS kind, p_partkey AS fp FROM part),
        t AS (SELECT 'target' || i AS target, i % 2 AS kind, 'col1' || i AS alias, i AS tp FROM range(7) r(i)),
        h AS (SELECT 'col' || l_partkey AS name, 'target' || l_suppkey % 7 AS target, count(*) AS hits FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
        p AS (SELECT feed, field, target, {ALIAS} AS points FROM f JOIN t ON f.name = t.alias UNION ALL SELECT feed, field, target, {NAME} FROM f JOIN t ON contains(f.name, t.target) UNION ALL SELECT feed, field, target, least({MOST_BEFORE}, {BEFORE} + (hits - 1) * {AGAIN}) FROM f JOIN h USING (name)),
        s AS (SELECT feed, field, fp, target, tp, sum(points) + CASE WHEN any_value(f.kind) = any_value(t.kind) THEN {KIND} ELSE 0 END AS score FROM p JOIN f USING (feed, field) JOIN t USING (target) GROUP BY feed, field, fp, target, tp),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, field ORDER BY score DESC, tp) AS n FROM s WHERE score >= {ENOUGH}) WHERE n = 1)
        SELECT feed, target, field, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY feed, target ORDER BY score DESC, fp) AS k FROM b) WHERE k = 1""",
}
