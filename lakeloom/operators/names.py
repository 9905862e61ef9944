"""Item names: normalisation rules and their effect, likeness, pairing, and the match board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import NAME_RULES, bigrams, changed_by, dice, normalize_name
from lakeloom.session import cut_lineage
from lakeloom.sources.domain import view, with_views

RULES = {name: (pattern, "") for name, pattern in NAME_RULES.items()}


def rule_hits(names: DataFrame, rules=RULES, column: str = "raw_name") -> DataFrame:
    """How many names each rule changes."""
    return names.select(F.explode(changed_by(F.col(column), rules)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def collisions(names: DataFrame, column: str = "raw_name", limit: int = 20) -> DataFrame:
    """Normalised names that several different names end up as, the most frequent first, and how many more there are than are listed."""
    distinct = names.select(F.col(column).alias("raw")).distinct()
    groups = distinct.groupBy(normalize_name(F.col("raw")).alias("normal")).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("example")).filter("n > 1")
    return groups.orderBy(F.desc("n"), "normal").limit(limit).withColumn("more", F.lit(max(0, groups.count() - limit)).cast("bigint"))


def source_overlap(names: DataFrame, normal) -> DataFrame:
    """Number of names that each pair of sources shares. Each name is one row with its sources, so pairs come from a few sources a name."""
    by_name = names.select(normal.alias("name"), "source").distinct().groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    left = by_name.select("sources", F.posexplode("sources").alias("i", "left"))
    pairs = left.select("left", F.explode(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))


def rule_effect(names: DataFrame, rules: Sequence[tuple[str, str]] = tuple(RULES.values())) -> DataFrame:
    """What rules bring: for each pair of sources the names shared without any rule (white space and case aside) and after the rules, and whether that is the largest overlap."""
    raw = source_overlap(names, normalize_name(F.col("raw_name"), ())).withColumnRenamed("shared", "before")
    normal = source_overlap(names, normalize_name(F.col("raw_name"), rules)).withColumnRenamed("shared", "after")
    both = raw.join(normal, ["left", "right"], "full_outer").fillna(0, ["before", "after"])
    both = cut_lineage(both)  # one row for each pair of sources
    most = both.agg(F.max("after")).first()[0]
    return both.withColumn("largest", F.col("after") == F.lit(most))


def balanced_sample(names: DataFrame, per_source: int = 6) -> DataFrame:
    """The first names of each source."""
    w = Window.partitionBy("source").orderBy("raw_name")
    return names.select("source", "raw_name").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_source).withColumn("n", F.col("n").cast("bigint"))


def rule_insight(names: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """One row for a rule list: names scanned, the largest overlap of two sources without rules and with them, what that gains, names that run together, and rules without effect."""
    listed = tuple(rules.values())
    effect = rule_effect(names, listed).agg(F.coalesce(F.max("before"), F.lit(0)).alias("before"), F.coalesce(F.max("after"), F.lit(0)).alias("after"))
    distinct = names.select("source", F.coalesce("raw_name", F.lit("")).alias("raw_name")).filter("raw_name <> ''").distinct()
    scanned = distinct.agg(F.count(F.lit(1)).alias("scanned"))
    raws = distinct.select("raw_name").distinct().groupBy(normalize_name(F.col("raw_name"), listed).alias("normal")).agg(F.count(F.lit(1)).alias("n"))
    together = raws.agg(F.count(F.when(F.col("n") > 1, 1)).alias("collisions"))
    used = rule_hits(distinct, rules).agg(F.array_sort(F.collect_list("rule")).alias("used"))
    idle = F.array_join(F.array_except(F.array(*[F.lit(r) for r in sorted(rules)]), "used"), ",") if rules else F.lit("")
    one = lambda df: df.withColumn("__one", F.lit(1))
    row = one(scanned).join(one(effect), "__one").join(one(together), "__one").join(one(used), "__one")
    return row.select("scanned", "before", "after", (F.col("after") - F.col("before")).alias("gained"), "collisions", idle.alias("idle"))


def rule_preview(names: DataFrame, rules: Sequence[tuple[int, str, str]], candidate: tuple[int, str, str] | None = None, per_source: int = 6) -> DataFrame:
    """The first names of each source as the rules (place, pattern, replacement) make them, and as they would be with a candidate among them; null without one."""
    listed = lambda some: [(p, r) for _, p, r in sorted(some, key=lambda x: x[0])]
    raw = F.col("raw_name")
    after = normalize_name(raw, listed([*rules, candidate])) if candidate else F.lit(None).cast("string")
    return balanced_sample(names, per_source).select("source", "raw_name", normalize_name(raw, listed(rules)).alias("now"), after.alias("then"))


def scored_pairs(names: DataFrame, left: str, right: str) -> DataFrame:
    """Dice likeness of all left and right names of one unit. Units hold a few names each; the join is on the unit. Bigrams are made once for each name, before it."""
    distinct = names.select("unit_id", "source", "name").distinct()
    side = lambda s, c: distinct.filter(F.col("source") == s).select("unit_id", F.explode(F.array(F.struct(F.col("name").alias(f"{c}_name"), bigrams(F.col("name")).alias(f"{c}_grams")))).alias("n")).select("unit_id", "n.*")
    pairs = side(left, "left").join(side(right, "right"), "unit_id")
    score = dice(F.col("left_name"), F.col("right_name"), (F.col("left_grams"), F.col("right_grams")))
    return pairs.select("unit_id", "left_name", "right_name", F.round(score, 6).alias("score"))


#: Pairs of a unit up to which the unit is paired in one place; larger units take rounds of joins.
SMALL_UNIT = 20_000


def greedy_pairs(scored: DataFrame, least: float | None = None) -> DataFrame:
    """One-to-one pairs within a unit: the best pair first, each name once; ties by left name, then right name.

    There is no least score unless one is asked for. A unit of at most `SMALL_UNIT` pairs is one sorted list, folded where it lies. In larger ones,
    in rounds, pairs that are the best of both of their names are taken, and all other pairs of these names go,
    until none is left.
    """
    order = F.struct((-F.col("score")).alias("s"), "left_name", "right_name")
    best = lambda c: F.min(order).over(Window.partitionBy("unit_id", c))
    everything = cut_lineage(scored if least is None else scored.filter(F.col("score") >= least))
    sizes = everything.groupBy("unit_id").agg((F.count(F.lit(1)) <= SMALL_UNIT).alias("small"))
    sized = everything.join(sizes.withColumnRenamed("unit_id", "of"), F.col("unit_id").eqNullSafe(F.col("of"))).drop("of")

    # One fold over a unit's sorted pairs.
    others = [c for c in scored.columns if c not in ("unit_id", "left_name", "right_name")]
    pair = F.struct((-F.col("score")).alias("s"), "left_name", "right_name", *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    units = sized.filter("small").groupBy("unit_id").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    used = lambda kept, x: F.exists(kept, lambda k: k["left_name"].eqNullSafe(x["left_name"]) | k["right_name"].eqNullSafe(x["right_name"]))
    kept = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda kept, x: F.when(used(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    taken = units.select("unit_id", F.explode(kept).alias("p")).select("unit_id", "p.left_name", "p.right_name", *[F.col(f"p.c{i}").alias(c) for i, c in enumerate(others)]).select(*scored.columns)
    now = cut_lineage(sized.filter("not small").select(*scored.columns))
    while not now.isEmpty():
        mine = cut_lineage(now.withColumns({"l": best("left_name"), "r": best("right_name")}).filter((order == F.col("l")) & (order == F.col("r"))).select(*scored.columns))
        taken = taken.unionByName(mine)
        for c in ("left_name", "right_name"):
            gone = mine.select(F.col("unit_id").alias("of"), F.col(c).alias("name"))
            now = now.join(gone, F.col("unit_id").eqNullSafe(F.col("of")) & F.col(c).eqNullSafe(F.col("name")), "left_anti")
        now = cut_lineage(now.select(*scored.columns))
    return taken


def best_mate(scored: DataFrame) -> DataFrame:
    """Each left name's best right name, and of those each right name's best left one."""
    mine = scored.groupBy("unit_id", "left_name").agg(F.max_by(F.struct("right_name", "score"), F.struct("score", "right_name")).alias("m")).select("unit_id", "left_name", "m.*")
    return mine.groupBy("unit_id", "right_name").agg(F.max_by(F.struct("left_name", "score"), F.struct("score", "left_name")).alias("m")).select("unit_id", "right_name", "m.*")


def pair_by_axis(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Lines of both sides meet by equal unit and axis value, the first with the first and so on; blank values never meet."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("unit_id", "source", "axis").orderBy("item_ref")))
    blank = F.coalesce(F.trim("axis"), F.lit("")) == ""
    side = lambda s, c: numbered.filter(F.col("source") == s).select("unit_id", F.when(blank, F.concat(F.lit(f"{s} "), F.col("item_ref").cast("string"))).otherwise(F.concat(F.lit("="), "axis")).alias("key"), "n", F.col("item_ref").alias(c))
    return side(left, "left_item").join(side(right, "right_item"), ["unit_id", "key", "n"], "full_outer").select("unit_id", "left_item", "right_item")


def board(items: DataFrame, members: DataFrame, left: str, right: str) -> DataFrame:
    """What each item of two sources is: LINKED to a unit, PAIRED by an equal normalised name, or on one side only."""
    known = items.join(members.filter("confirmed").select("source", "item_ref", "unit_id"), ["source", "item_ref"], "left")
    loose = known.filter("unit_id is null").withColumn("normal", normalize_name(F.col("raw_name")))
    both = loose.filter("normal <> ''").groupBy("normal").agg(F.count_distinct("source").alias("sides")).filter("sides = 2").select("normal", F.lit(True).alias("paired"))
    marked = loose.join(both, "normal", "left")
    kind = F.when(F.col("paired"), "PAIRED").when(F.col("source") == left, "LEFT_ONLY").otherwise("RIGHT_ONLY")
    return known.filter("unit_id is not null").select("source", "item_ref", F.lit("LINKED").alias("kind")).unionByName(marked.select("source", "item_ref", kind.alias("kind")))


def common_start(names: DataFrame, least: int = 2) -> DataFrame:
    """The longest common start of each unit's names, without an open bracket or loose marks at its end; null if too short.

    The common start of a group is that of its least and greatest name, so no group is gathered.
    """
    ends = names.groupBy("unit_id").agg(F.min("name").alias("a"), F.max("name").alias("b"), F.count_distinct("name").alias("n"))
    size = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    start = F.substring(F.col("a"), F.lit(1), F.when(F.least(F.length("a"), F.length("b")) > 0, size).otherwise(0))
    tidy = F.regexp_replace(F.regexp_replace(start, r"\([^)]*$", ""), r"[ ,_/.(\-]+$", "")
    return ends.select("unit_id", "n", F.when(F.length(tidy) >= least, tidy).alias("common"))


_RAW = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' (27.03.16)' WHEN 1 THEN '_26.10.17' WHEN 2 THEN ' 2026-10-17' ELSE '' END)"
LEFT, RIGHT = "erp", "wms"


def _names(spark, sf_dir) -> DataFrame:
    """Both sources' item names: the second source has other dates and some other words."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    erp = part.select(F.lit(LEFT).alias("source"), F.col("p_partkey").alias("item_ref"), F.expr(_RAW).alias("raw_name"))
    wms = part.select(F.lit(RIGHT).alias("source"), F.col("p_partkey").alias("item_ref"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' ', p_name) ELSE concat(p_name, ' (new)') END").alias("raw_name"))
    return erp.unionByName(wms)


def _unit_names(spark, sf_dir) -> DataFrame:
    return _names(spark, sf_dir).withColumn("unit_id", (F.col("item_ref") / 10).cast("bigint")).select("unit_id", "source", F.col("raw_name").alias("name"))


def _axis_rows(spark, sf_dir) -> DataFrame:
    return _names(spark, sf_dir).select("source", "item_ref", (F.col("item_ref") % 40).alias("unit_id"), F.when(F.col("item_ref") % 9 == 0, "").otherwise(F.concat(F.lit("a"), (F.col("item_ref") % (F.when(F.col("source") == LEFT, 3).otherwise(4))).cast("string"))).alias("axis"))


_PLACED = [(10 * i, pattern, "") for i, pattern in enumerate(NAME_RULES.values(), 1)]

QUERIES = {
    "name_normalize": lambda s, d: _names(s, d).select("source", "item_ref", normalize_name(F.col("raw_name")).alias("normal")),
    "rule_hits": lambda s, d: rule_hits(_names(s, d)),
    "name_collisions": lambda s, d: collisions(_names(s, d)),
    "source_overlap": lambda s, d: source_overlap(_names(s, d), normalize_name(F.col("raw_name"))),
    "rule_effect": lambda s, d: rule_effect(_names(s, d)),
    "rule_insight": lambda s, d: rule_insight(_names(s, d), RULES | {"never": ("no such thing", "")}),
    "rule_preview": lambda s, d: rule_preview(_names(s, d), _PLACED, (25, "[0-9]+", "#")),
    "balanced_sample": lambda s, d: balanced_sample(_names(s, d)),
    "dice_pairs": lambda s, d: scored_pairs(_unit_names(s, d), LEFT, RIGHT),
    "greedy_pairs": lambda s, d: greedy_pairs(scored_pairs(_unit_names(s, d), LEFT, RIGHT)),
    "best_mate": lambda s, d: best_mate(scored_pairs(_unit_names(s, d), LEFT, RIGHT)),
    "pair_by_axis": lambda s, d: pair_by_axis(_axis_rows(s, d), LEFT, RIGHT),
    "match_board": lambda s, d: board(_names(s, d), view(s, d, "member"), LEFT, RIGHT),
    "match_board_kinds": lambda s, d: board(_names(s, d), view(s, d, "member"), LEFT, RIGHT).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "common_name": lambda s, d: common_start(_unit_names(s, d).withColumn("name", F.concat(F.lit("Camp (a"), (F.col("unit_id") % 3).cast("string"), F.lit(") "), "name"))),
}

_N = f"names AS (SELECT 'erp' AS source, p_partkey AS item_ref, {_RAW} AS raw_name FROM part UNION ALL SELECT 'wms', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' ', p_name) ELSE concat(p_name, ' (new)') END FROM part)"
_NORMAL = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substring({0}, 1, 300), '\\([^)]*\\)', '', 'g'), '_\\d{{2}}[.\\-/]\\d{{2}}[.\\-/]\\d{{2}}$', '', 'g'), '\\d{{2,4}}[.\\-/]\\d{{1,2}}[.\\-/]\\d{{1,2}}', '', 'g'), '\\s+', '', 'g'))"
_BARE = "lower(regexp_replace(substring(raw_name, 1, 300), '\\s+', '', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"
_UNITS = f"WITH {_N}, u AS (SELECT DISTINCT item_ref // 10 AS unit_id, source, raw_name AS name FROM names)"
_A, _B = _GRAMS.format("l.name"), _GRAMS.format("r.name")
_SCORED = f"{_UNITS}, scored AS (SELECT unit_id, l.name AS left_name, r.name AS right_name, round(CASE WHEN l.name = r.name THEN 1.0 ELSE 2.0 * len(list_intersect({_A}, {_B})) / (len({_A}) + len({_B})) END, 6) AS score FROM u l JOIN u r USING (unit_id) WHERE l.source = 'erp' AND r.source = 'wms')"
_BOARD = f"""{with_views('member')}, {_N}, known AS (SELECT n.*, m.unit_id, {_NORMAL.format('raw_name')} AS normal FROM names n LEFT JOIN (SELECT * FROM member WHERE confirmed) m USING (source, item_ref)),
    both_sides AS (SELECT normal FROM known WHERE unit_id IS NULL AND normal <> '' GROUP BY normal HAVING count(DISTINCT source) = 2),
    board AS (SELECT source, item_ref, CASE WHEN unit_id IS NOT NULL THEN 'LINKED' WHEN normal IN (SELECT normal FROM both_sides) THEN 'PAIRED' WHEN source = 'erp' THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS kind FROM known)"""

_HITS = f"""WITH {_N}, a AS (SELECT raw_name, regexp_replace(raw_name, '\\([^)]*\\)', '', 'g') AS v1 FROM names), b AS (SELECT *, regexp_replace(v1, '_\\d{{2}}[.\\-/]\\d{{2}}[.\\-/]\\d{{2}}$', '', 'g') AS v2 FROM a), c AS (SELECT *, regexp_replace(v2, '\\d{{2,4}}[.\\-/]\\d{{1,2}}[.\\-/]\\d{{1,2}}', '', 'g') AS v3 FROM b)
        SELECT rule, count(*) AS n FROM (SELECT 'brackets' AS rule FROM c WHERE v1 <> raw_name UNION ALL SELECT 'date after underscore' FROM c WHERE v2 <> v1 UNION ALL SELECT 'date in name' FROM c WHERE v3 <> v2) GROUP BY rule"""

SQL = {
    "name_normalize": f"WITH {_N} SELECT source, item_ref, {_NORMAL.format('raw_name')} AS normal FROM names",
    "rule_hits": _HITS,
    "name_collisions": f"WITH {_N} SELECT {_NORMAL.format('raw')} AS normal, count(*) AS n, min(raw) AS example, greatest(count(*) OVER () - 20, 0) AS more FROM (SELECT DISTINCT raw_name AS raw FROM names) GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, normal LIMIT 20",
    "source_overlap": f"WITH {_N}, k AS (SELECT DISTINCT source, {_NORMAL.format('raw_name')} AS name FROM names) SELECT a.source AS left, b.source AS right, count(*) AS shared FROM k a JOIN k b ON a.name = b.name AND a.source < b.source GROUP BY 1, 2",
    "rule_effect": f"""WITH {_N}, k AS (SELECT DISTINCT source, {_NORMAL.format('raw_name')} AS name FROM names), d AS (SELECT DISTINCT source, {_BARE} AS raw_name FROM names),
        p AS (SELECT 'erp' AS left, 'wms' AS right, (SELECT count(*) FROM d a JOIN d b ON a.raw_name = b.raw_name AND a.source = 'erp' AND b.source = 'wms') AS before, (SELECT count(*) FROM k a JOIN k b ON a.name = b.name AND a.source = 'erp' AND b.source = 'wms') AS after)
        SELECT *, true AS largest FROM p WHERE before > 0 OR after > 0""",
    "rule_insight": f"""WITH {_N}, hits AS ({_HITS}), k AS (SELECT DISTINCT source, {_NORMAL.format('raw_name')} AS name FROM names), d AS (SELECT DISTINCT source, {_BARE} AS name FROM names), c AS (SELECT {_NORMAL.format('raw')} AS normal FROM (SELECT DISTINCT raw_name AS raw FROM names) GROUP BY 1 HAVING count(*) > 1),
        p AS (SELECT (SELECT count(*) FROM d a JOIN d b ON a.name = b.name AND a.source = 'erp' AND b.source = 'wms') AS before, (SELECT count(*) FROM k a JOIN k b ON a.name = b.name AND a.source = 'erp' AND b.source = 'wms') AS after)
        SELECT (SELECT count(*) FROM (SELECT DISTINCT source, raw_name FROM names)) AS scanned, before, after, after - before AS gained, (SELECT count(*) FROM c) AS collisions, (SELECT coalesce(string_agg(r, ',' ORDER BY r), '') FROM (VALUES ('brackets'), ('date after underscore'), ('date in name'), ('never')) v(r) WHERE r NOT IN (SELECT rule FROM hits)) AS idle
        FROM p""",
    "rule_preview": f"""WITH {_N}, s AS (SELECT source, raw_name, row_number() OVER (PARTITION BY source ORDER BY raw_name) AS n FROM (SELECT DISTINCT source, raw_name FROM names))
        SELECT source, raw_name, {_NORMAL.format('raw_name')} AS now, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_name, '\\([^)]*\\)', '', 'g'), '_\\d{{2}}[.\\-/]\\d{{2}}[.\\-/]\\d{{2}}$', '', 'g'), '[0-9]+', '#', 'g'), '\\d{{2,4}}[.\\-/]\\d{{1,2}}[.\\-/]\\d{{1,2}}', '', 'g'), '\\s+', '', 'g')) AS "then" FROM s WHERE n <= 6""",
    "balanced_sample": f"WITH {_N} SELECT * FROM (SELECT source, raw_name, row_number() OVER (PARTITION BY source ORDER BY raw_name) AS n FROM (SELECT DISTINCT source, raw_name FROM names)) WHERE n <= 6",
    "dice_pairs": f"{_SCORED} SELECT * FROM scored",
    "best_mate": f"""{_SCORED}, mine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, left_name ORDER BY score DESC, right_name DESC) AS n FROM scored) WHERE n = 1)
        SELECT unit_id, left_name, right_name, score FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, right_name ORDER BY score DESC, left_name DESC) AS k FROM mine) WHERE k = 1""",
    "common_name": f"""{_UNITS}, e AS (SELECT unit_id, min(name) AS a, max(name) AS b, count(DISTINCT name) AS n FROM (SELECT unit_id, concat('Camp (a', unit_id % 3, ') ', name) AS name FROM u) GROUP BY unit_id),
        t AS (SELECT unit_id, n, regexp_replace(regexp_replace(substring(a, 1, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, 1, i) = substring(b, 1, i))), 0)), '\\([^)]*$', ''), '[ ,_/.(\\-]+$', '') AS tidy FROM e)
        SELECT unit_id, n, CASE WHEN length(tidy) >= 2 THEN tidy END AS common FROM t""",
    "pair_by_axis": f"""WITH {_N}, x AS (SELECT source, item_ref, item_ref % 40 AS unit_id, CASE WHEN item_ref % 9 = 0 THEN '' ELSE 'a' || CAST(item_ref % (CASE source WHEN 'erp' THEN 3 ELSE 4 END) AS VARCHAR) END AS axis FROM names),
        k AS (SELECT *, CASE WHEN axis = '' THEN source || CAST(item_ref AS VARCHAR) ELSE axis END AS key, row_number() OVER (PARTITION BY unit_id, source, axis ORDER BY item_ref) AS n FROM x)
        SELECT unit_id, l.item_ref AS left_item, r.item_ref AS right_item FROM (SELECT * FROM k WHERE source = 'erp') l FULL JOIN (SELECT * FROM k WHERE source = 'wms') r USING (unit_id, key, n)""",
    "match_board": f"{_BOARD} SELECT * FROM board",
    "match_board_kinds": f"{_BOARD} SELECT kind, count(*) AS n FROM board GROUP BY kind",
}
