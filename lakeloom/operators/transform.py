"""Connector runs: source rows of texts become typed rows of a standard model.

Mappings are data: a source field, a target field and a transform rule. Rows that fail keep
their number, a code and a message, and do not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import default_if_empty, natural_key, normalize_field_name, number_strip, replace_code, strip_text, typed

#: Transform rules by name: a function of the source column and its parameters.
RULES: dict[str, Callable[..., Column]] = {
    "NONE": lambda c: c,
    "TRIM": strip_text,
    "UPPER": F.upper,
    "LOWER": F.lower,
    "NUMBER_STRIP": number_strip,
    "CODE_REPLACE": lambda c, **codes: replace_code(c, codes),
    "DEFAULT_IF_EMPTY": lambda c, value="": default_if_empty(c, value),
    "CONSTANT": lambda c, value="": F.lit(value) if value else c,
    "DATE_FORMAT": lambda c, pattern="yyyy-MM-dd": F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(pattern)), "yyyy-MM-dd"), c),
}


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    rule: str = "NONE"
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    required: bool = False
    default: str | None = None


def map_rows(rows: DataFrame, mappings: Sequence[Mapping], targets: Sequence[Target], number: str = "row_number", required: bool = True) -> DataFrame:
    """Typed target columns, `attributes` (JSON of source fields that no mapping uses) and `errors` (code:field, null if none).

    Texts and typed values are each worked out once for a row, in one struct that later steps read. `required` false
    leaves it to a later step to look for missing values.
    """
    by_target = {m.target: m for m in mappings}
    texts = []
    for t in targets:
        m = by_target.get(t.name)
        text = RULES[m.rule](F.col(m.source), **m.params) if m else F.lit(None).cast("string")
        texts.append(text.alias(t.name))
    blank = lambda c: F.coalesce(strip_text(c), F.lit("")) == ""
    once = lambda *columns: F.explode(F.array(F.struct(*columns)))
    used = {m.source for m in mappings} | {number}
    rest = [c for c in rows.columns if c not in used]
    attributes = (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("attributes")
    found = rows.select(number, attributes, once(*texts).alias("text"))
    found = found.select(number, "attributes", once(*[F.when(blank(F.col("text")[t.name]), F.lit(t.default)).otherwise(F.col("text")[t.name]).alias(t.name) for t in targets]).alias("text"))
    found = found.select(number, "attributes", "text", once(*[typed(F.col("text")[t.name], t.kind).alias(t.name) for t in targets]).alias("value"))
    errors = []
    for t in targets:
        missing = blank(F.col("text")[t.name])
        if t.required and required:
            errors.append(F.when(missing, F.lit(f"REQUIRED:{t.name}")))
        errors.append(F.when(~missing & F.col("value")[t.name].isNull(), F.lit(f"TYPE:{t.name}")))
    listed = F.array_join(F.array_compact(F.array(*errors)), ",")
    return found.select(number, "value.*", "attributes", F.nullif(listed, F.lit("")).alias("errors"))


def split_errors(mapped: DataFrame, number: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """Good rows, and one row for each error: row number, code, field."""
    bad = mapped.filter("errors is not null").select(number, F.explode(F.split("errors", ",")).alias("e"))
    return mapped.filter("errors is null").drop("errors"), bad.select(number, F.substring_index("e", ":", 1).alias("code"), F.substring_index("e", ":", -1).alias("field"))


def group_errors(errors: DataFrame, number: str = "row_number") -> DataFrame:
    """Errors by code and field: how many, and the first and last row."""
    return errors.groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first_row"), F.max(number).alias("last_row"))


def run_status(good: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows written and failed, and SUCCEEDED, PARTIAL or FAILED."""
    counts = good.agg(F.count(F.lit(1)).alias("written")).withColumn("k", F.lit(1)).join(errors.agg(F.count_distinct("row_number").alias("failed")).withColumn("k", F.lit(1)), "k").drop("k")
    return counts.withColumn("status", F.when(F.col("failed") == 0, "SUCCEEDED").when(F.col("written") > 0, "PARTIAL").otherwise("FAILED"))


def convert_units(rows: DataFrame, rules: DataFrame, target_unit: str) -> DataFrame:
    """Quantities in one unit: an item's own rule before the general one (item ''); the unit itself passes; without a rule the result is null."""
    own = rules.filter("item_ref <> ''").select("item_ref", F.col("from_unit").alias("unit"), F.col("factor").alias("own"))
    every = rules.filter("item_ref = ''").select(F.col("from_unit").alias("unit"), F.col("factor").alias("general"))
    factor = F.when(F.coalesce("unit", F.lit("")).isin("", target_unit), F.lit(1)).otherwise(F.coalesce("own", "general"))
    return rows.join(own, ["item_ref", "unit"], "left").join(every, "unit", "left").withColumn("converted", F.col("quantity") * factor).drop("own", "general")


def drift(columns: Sequence[str], known: Sequence[str], mapped: Sequence[str]) -> dict[str, list[str]]:
    """Added and removed fields; a removed field that a mapping uses blocks the run."""
    gone = [c for c in known if c not in columns]
    return {"added": [c for c in columns if c not in known], "removed": gone, "blocking": [c for c in gone if c in mapped]}


def held_fields(rows: DataFrame) -> DataFrame:
    """The fields that hold a value in some row (blank texts are none), and in how many `rows`: one aggregation over all."""
    held = lambda f: F.count(F.when(F.trim(F.col(f"`{f.name}`")) != "", 1)) if f.dataType.simpleString() == "string" else F.count(F.col(f"`{f.name}`"))
    counts = rows.agg(*[held(f).alias(f.name) for f in rows.schema])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("rows")) for c in rows.columns])).alias("x")).select("x.*").filter("rows > 0")


def field_drift(now: DataFrame, known: DataFrame, mapped: Sequence[str]) -> DataFrame:
    """The same for field lists that are tables with a column `field` (and `now` with `rows`)."""
    both = now.select("field", "rows", F.lit(True).alias("here")).join(known.select("field", F.lit(True).alias("there")), "field", "full_outer")
    change = F.when(F.col("here").isNull() & F.col("field").isin(*mapped), "BLOCKING").when(F.col("here").isNull(), "REMOVED").when(F.col("there").isNull(), "ADDED")
    return both.withColumn("change", change).filter("change is not null").select("field", "change", F.coalesce("rows", F.lit(0)).alias("rows"))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each natural key, the last by `order`. An aggregation, so a key's rows are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: new rows replace those of equal key, the last of several counts."""
    fresh = last_wins(new, keys, order)
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def undo(current: DataFrame, before: DataFrame, run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table before a run: without the run's rows, with what they had replaced."""
    return current.join(run.select(*keys).distinct(), list(keys), "left_anti").unionByName(before.join(run.select(*keys).distinct(), list(keys), "left_semi"))


def stage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Natural key and JSON payload of rows for a test run."""
    return rows.select(natural_key(*[F.col(k) for k in keys]).alias("natural_key"), F.to_json(F.struct(*rows.columns)).alias("payload"))


def previews(rows: DataFrame, number: str, most: int = 3) -> DataFrame:
    """Up to `most` different non-blank values of each field, in the order in which they first stand."""
    fields = [c for c in rows.columns if c != number]
    tall = rows.select(number, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("x")).select(number, "x.*")
    first = tall.filter(F.trim("value") != "").groupBy("field", "value").agg(F.min(number).alias("at"))
    # The row number lets Spark keep so many rows of a field on the map side.
    few = first.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("at", "value"))).filter(F.col("n") <= most)
    listed = few.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))
    return listed.select("field", F.array_join(F.transform("x", lambda v: v["value"]), "|").alias("samples"))


def post_script(rows: DataFrame, script: Callable[[pd.DataFrame], pd.DataFrame], handle: str = "row_number") -> DataFrame:
    """A user's function over batches of rows; what it returns replaces the columns it returns, by row handle.

    Rows that it leaves out stay as they are; handles that it makes up are ignored.
    """
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = script(batch.copy()).drop_duplicates(handle, keep="last").set_index(handle)
            out = batch.set_index(handle)
            done = done.loc[done.index.intersection(out.index)]
            for c in done.columns.intersection(out.columns):
                out.loc[done.index, c] = done[c]
            yield out.reset_index()[batch.columns]

    return rows.mapInPandas(run, schema)


def suggestions(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """The best target of each source field and its score: 100 for an alias, 60 for a similar name, 40 for values of the target's type; from 80 on, each target once."""
    alias = targets.select("target", F.explode(F.split("aliases", r"\|")).alias("alias"))
    name = normalize_field_name(F.col("field"))
    named = fields.withColumn("name", name)
    by_alias = named.join(alias, F.col("name") == normalize_field_name(F.col("alias"))).select("field", "target", F.lit(100).alias("points"))
    by_part = named.join(targets, F.contains("name", normalize_field_name(F.col("target")))).select("field", "target", F.lit(60).alias("points"))
    by_kind = named.join(targets, named["kind"] == targets["kind"]).select("field", "target", F.lit(40).alias("points"))
    scores = by_alias.distinct().unionByName(by_part).unionByName(by_kind).groupBy("field", "target").agg(F.sum("points").alias("score")).filter("score >= 80")
    best = scores.groupBy("field").agg(F.max_by(F.struct("target", "score"), F.struct("score", "target")).alias("b")).select("field", "b.*")
    return best.groupBy("target").agg(F.max_by(F.struct("field", "score"), F.struct("score", "field")).alias("b")).select("target", "b.*")


# --- queries --------------------------------------------------------------------------------------

MAPPINGS = (
    Mapping("code", "item_ref", "TRIM"),
    Mapping("qty", "quantity", "NUMBER_STRIP"),
    Mapping("day", "base_at"),
    Mapping("flag", "active", "CODE_REPLACE", {"A": "yes", "N": "no"}),
    Mapping("house", "warehouse", "DEFAULT_IF_EMPTY", {"value": "main"}),
)
TARGETS = (Target("item_ref", "STRING", True), Target("quantity", "INTEGER", True), Target("base_at", "DATE"), Target("active", "BOOLEAN", default="no"), Target("warehouse", "STRING"))

_SOURCE = """SELECT l_orderkey * 8 + l_linenumber AS row_number, concat(' P', CAST(l_partkey AS STRING), ' ') AS code,
    CASE WHEN l_partkey % 23 = 0 THEN 'none' WHEN l_partkey % 29 = 0 THEN '' ELSE concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), ' EA') END AS qty,
    CASE WHEN l_partkey % 19 = 0 THEN '2026-8-1' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS day, l_returnflag AS flag, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat('W', CAST(l_suppkey % 3 AS STRING)) END AS house,
    l_linestatus AS extra FROM {lineitem}"""
_BARE = _SOURCE.replace("{lineitem}", "lineitem")
_MAPPED = f"""WITH src AS ({_BARE}), m AS (SELECT *, trim(code) AS item_ref, regexp_replace(qty, '[^0-9.\\-]', '', 'g') AS q FROM src),
    mapped AS (SELECT extra, row_number, item_ref, TRY_CAST(CASE WHEN q = '' THEN NULL ELSE q END AS BIGINT) AS quantity, CASE WHEN regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(day AS DATE) END AS base_at,
    CASE flag WHEN 'A' THEN true WHEN 'N' THEN false END AS active, CASE WHEN trim(house) = '' THEN 'main' ELSE house END AS warehouse,
    list_filter([CASE WHEN q = '' THEN 'REQUIRED:quantity' END, CASE WHEN NOT regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'TYPE:base_at' END, CASE WHEN flag NOT IN ('A', 'N') THEN 'TYPE:active' END], lambda x: x IS NOT NULL) AS errors FROM m),
    bad AS (SELECT row_number, unnest(errors) AS e FROM mapped)"""


def _source(spark, sf_dir) -> DataFrame:
    return spark.sql(_SOURCE, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _mapped(spark, sf_dir) -> DataFrame:
    return map_rows(_source(spark, sf_dir), MAPPINGS, TARGETS)


def _tables(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"), "l_shipdate")
    return last_wins(lines.filter("l_partkey % 3 <> 0"), KEYS, ORDER), lines.filter("l_partkey % 3 = 0")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as they might come: a field that is blank in some rows, one without a value in some, and one without any."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.withColumns({"o_orderstatus": F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")), "o_orderpriority": F.lit("")})


KEYS, ORDER = ("l_orderkey", "l_linenumber"), ("l_shipdate", "l_partkey", "quantity")
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate FROM lineitem), pick AS (SELECT l_orderkey, l_linenumber, l_partkey, quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey % 3 = 0 ORDER BY l_shipdate DESC, l_partkey DESC, quantity DESC) AS n FROM lines) WHERE n = 1)"
_PICKED = "l_orderkey, l_linenumber, l_partkey, quantity"


def _rules(spark) -> DataFrame:
    return spark.createDataFrame([("", "BOX", 12), ("P10", "BOX", 6), ("P11", "BOX", 24), ("", "SET", 3)], "item_ref string, from_unit string, factor int")


def _units(spark, sf_dir) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_ref"), F.element_at(F.array(*[F.lit(x) for x in ("EA", "BOX", "SET", "", "BAG")]), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("unit"), F.col("l_quantity").cast("bigint").alias("quantity"))


def _scripted(spark, sf_dir) -> DataFrame:
    rows = split_errors(_mapped(spark, sf_dir))[0].groupBy("row_number").agg(F.min("item_ref").alias("item_ref"), F.min("quantity").alias("quantity"))

    def double_odd(df: pd.DataFrame) -> pd.DataFrame:
        odd = df[df["quantity"] % 2 == 1]
        return odd.assign(quantity=odd["quantity"] * 2)[["row_number", "quantity"]]

    return post_script(rows, double_odd)


QUERIES = {
    "transform_typed": lambda s, d: split_errors(_mapped(s, d))[0].select("row_number", "item_ref", "quantity", F.date_format("base_at", "yyyy-MM-dd").alias("base_at"), "active", "warehouse", F.get_json_object("attributes", "$.extra").alias("extra")),
    "row_errors": lambda s, d: split_errors(_mapped(s, d))[1],
    "row_errors_grouped": lambda s, d: group_errors(split_errors(_mapped(s, d))[1]),
    "run_status": lambda s, d: run_status(*split_errors(_mapped(s, d))),
    "unit_conversion_priority": lambda s, d: convert_units(_units(s, d), _rules(s), "EA"),
    "schema_drift": lambda s, d: field_drift(held_fields(_orders(s, d)), s.createDataFrame([("o_orderkey",), ("o_custkey",), ("o_clerk",), ("o_orderpriority",)], "field string"), ("o_clerk",)),
    "upsert_last_wins": lambda s, d: merge(*_tables(s, d), KEYS, ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "quantity"),
    "run_undo": lambda s, d: undo(merge(*_tables(s, d), KEYS, ORDER), *_tables(s, d), KEYS).select("l_orderkey", "l_linenumber", "l_partkey", "quantity"),
    "staged_rows": lambda s, d: stage(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), ("n_nationkey", "n_name")),
    "field_previews": lambda s, d: previews(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey"),
    "post_script": _scripted,
    "known_keys_anti": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").join(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"),
}

SQL = {
    "transform_typed": f"{_MAPPED} SELECT row_number, item_ref, quantity, strftime(base_at, '%Y-%m-%d') AS base_at, active, warehouse, extra FROM mapped WHERE len(errors) = 0",
    "row_errors": f"{_MAPPED} SELECT row_number, split_part(e, ':', 1) AS code, split_part(e, ':', 2) AS field FROM bad",
    "row_errors_grouped": f"{_MAPPED} SELECT split_part(e, ':', 1) AS code, split_part(e, ':', 2) AS field, count(*) AS n, min(row_number) AS first_row, max(row_number) AS last_row FROM bad GROUP BY 1, 2",
    "run_status": f"{_MAPPED} SELECT (SELECT count(*) FROM mapped WHERE len(errors) = 0) AS written, (SELECT count(DISTINCT row_number) FROM bad) AS failed, 'PARTIAL' AS status",
    "unit_conversion_priority": """WITH u AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS item_ref, ['EA', 'BOX', 'SET', '', 'BAG'][l_suppkey % 5 + 1] AS unit, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
        SELECT item_ref, unit, quantity, quantity * CASE WHEN unit IN ('', 'EA') THEN 1 WHEN unit = 'BOX' THEN CASE item_ref WHEN 'P10' THEN 6 WHEN 'P11' THEN 24 ELSE 12 END WHEN unit = 'SET' THEN 3 END AS converted FROM u""",
    "schema_drift": """SELECT 'o_clerk' AS field, 'BLOCKING' AS change, 0 AS rows UNION ALL SELECT 'o_orderpriority', 'REMOVED', 0 UNION ALL SELECT 'o_orderstatus', 'ADDED', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders
        UNION ALL SELECT 'o_totalprice', 'ADDED', count(*) FILTER (WHERE o_totalprice > 1000) FROM orders UNION ALL SELECT 'o_orderdate', 'ADDED', count(o_orderdate) FROM orders""",
    "upsert_last_wins": f"WITH {_LINES} SELECT {_PICKED} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 3 = 0 DESC) AS n FROM pick) WHERE n = 1",
    "run_undo": f"WITH {_LINES} SELECT {_PICKED} FROM pick WHERE l_partkey % 3 <> 0",
    "staged_rows": """SELECT CAST(n_nationkey AS VARCHAR) || chr(31) || n_name AS natural_key, '{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"}' AS payload FROM nation""",
    "field_previews": """WITH t AS (SELECT p_partkey, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part),
        f AS (SELECT field, value, min(p_partkey) AS first_at FROM t GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_at, value) AS n FROM f)
        SELECT field, string_agg(value, '|' ORDER BY n) AS samples FROM k WHERE n <= 3 GROUP BY field""",
    "post_script": f"{_MAPPED} SELECT row_number, min(item_ref) AS item_ref, CASE WHEN min(quantity) % 2 = 1 THEN min(quantity) * 2 ELSE min(quantity) END AS quantity FROM mapped WHERE len(errors) = 0 GROUP BY row_number",
    "known_keys_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
}
