"""A connector run from source rows to sinks and status: drift gate, mapping, units, scripts, required fields, one write.

Good and bad rows leave in one write, dealt to a folder each, and the run's counts are observed while
they pass; nothing is mapped twice. Scripts see rows in chunks cut by row number over the whole table, so
what they return does not depend on batches or partitions.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeloom.functions.columns import strip_text
from lakeloom.operators.transform import _BARE, MAPPINGS, TARGETS, Mapping, Target, _source, convert_units, drift, map_rows
from lakeloom.session import cut_lineage, shared_folder

#: Rows that a script sees at once, and the seconds that it has for them.
CHUNK, SECONDS = 500, 30.0
#: Chunks that go to Python together; a script sees them one at a time.
TOGETHER = 20
HANDLE = "_row"


@dataclass(frozen=True)
class Script:
    """A user's function from a table to rows of changes; `_row` in both tells which row is meant."""

    name: str
    call: Callable[[pd.DataFrame], pd.DataFrame]
    seconds: float = SECONDS
    enabled: bool = True


def chunked(rows: DataFrame, number: str, size: int = CHUNK) -> DataFrame:
    """`rows` with `chunk`: each `size` rows in order of their number. Running counts of sorted ranges, so no task sees all rows."""
    ranges = cut_lineage(rows.repartitionByRange(number).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", before.alias("__before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(number)) - 1
    return ranges.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn("chunk", F.floor((F.col("__place") + F.col("__before")) / size)).drop("__part", "__place", "__before")


@contextmanager
def _limit(seconds: float) -> Iterator[None]:
    """Raise in a worker's own thread once the time is over."""

    def ring(*_) -> None:
        raise TimeoutError(f"over {seconds:g} s")

    old = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def scripted(rows: DataFrame, scripts: Sequence[Script], number: str = "row_number", size: int = CHUNK) -> DataFrame:
    """Rows after all enabled scripts, in their order, with `script_error` (null if none).

    A script returns the columns that it changes; others stay, rows that it leaves out stay, unknown handles and columns are
    ignored, and of a handle that stands twice the last counts. Where one fails, takes too long or returns a
    value that does not fit its column, its whole chunk keeps the values from before the first script, with the error.
    """
    active = [s for s in scripts if s.enabled]
    error = F.lit(None).cast("string")
    if not active:
        return rows.withColumn("script_error", error)
    names = rows.columns
    types = {f.name: to_arrow_type(f.dataType) for f in rows.schema}

    def patched(table: pd.DataFrame, script: Script) -> pd.DataFrame:
        with _limit(script.seconds):
            done = script.call(table.rename(columns={number: HANDLE}).copy())
        if done is None or not len(done):
            return table
        if HANDLE not in done.columns:
            raise ValueError(f"no column {HANDLE}")
        places: dict = {}
        for i, n in enumerate(table[number]):
            places.setdefault(n, []).append(i)
        last = {n: j for j, (n, there) in enumerate(zip(done[HANDLE], done[HANDLE].notna(), strict=True)) if there and n in places}
        done = done.iloc[list(last.values())]
        to = [i for n in last for i in places[n]]
        of = [j for j, n in enumerate(last) for _ in places[n]]
        changes = {}
        for c in done.columns.intersection(table.columns.drop(number)):
            pa.array(done[c], types[c], from_pandas=True)  # raises if a value does not fit
            changes[c] = table[c].to_numpy(copy=True)
            changes[c][to] = done[c].astype(object).to_numpy()[of]
        return table.assign(**changes)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        now, failed = table, None
        for script in active:
            try:
                now = patched(now, script)
            except Exception as e:  # whatever a user's code raises belongs to its chunk
                now, failed = table, f"SCRIPT:{script.name}: {type(e).__name__}: {e}"[:500]
                break
        return now.assign(script_error=failed)

    def run_all(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(number, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(table["chunk"])) + 1).tolist(), len(table)]
        objects = table[names].astype(object).reset_index(drop=True)
        return pd.concat([run(objects.iloc[a:b].reset_index(drop=True)) for a, b in pairwise(cuts)], ignore_index=True)

    schema = rows.withColumn("script_error", error).schema
    # A group costs as much as a chunk's scripts, so several chunks that follow one another are one.
    return chunked(rows, number, size).groupBy(F.floor(F.col("chunk") / TOGETHER)).applyInPandas(run_all, schema)


@dataclass(frozen=True)
class Run:
    """What a run left: its tables, and its counts and status."""

    good: DataFrame | None
    bad: DataFrame | None
    status: dict


@dataclass(frozen=True)
class Plan:
    """How a source's rows become a model's: fields known when the mapping was made, mappings, targets, units and scripts."""

    known: Sequence[str]
    mappings: Sequence[Mapping]
    targets: Sequence[Target]
    scripts: Sequence[Script] = ()
    unit: str | None = None
    fixed: dict[str, str] = field(default_factory=dict)


def outcomes(rows: DataFrame, plan: Plan, unit_rules: DataFrame | None = None, number: str = "row_number") -> DataFrame:
    """Every source row with its typed values, `attributes` and `errors` (null: good). Required fields are looked for after the scripts."""
    mapped = map_rows(rows, plan.mappings, plan.targets, number, required=False)
    if plan.unit and unit_rules is not None:
        mapped = convert_units(mapped, unit_rules, plan.unit)
        lost = F.col("quantity").isNotNull() & F.col("converted").isNull()
        mapped = mapped.withColumn("errors", F.coalesce("errors", F.when(lost, "UNIT:unit"))).withColumn("quantity", F.when(lost, F.col("quantity")).otherwise(F.col("converted")).cast(mapped.schema["quantity"].dataType)).drop("converted")
    if any(s.enabled for s in plan.scripts):
        mapped = cut_lineage(mapped)
        fine = scripted(mapped.filter("errors is null").drop("errors"), plan.scripts, number)
        fine = fine.withColumnRenamed("script_error", "errors").select(*mapped.columns)
        mapped = fine.unionByName(mapped.filter("errors is not null"))
    missing = [F.when(F.coalesce(strip_text(F.col(t.name).cast("string")), F.lit("")) == "", F.lit(f"REQUIRED:{t.name}")) for t in plan.targets if t.required]
    found = F.nullif(F.array_join(F.array_compact(F.array(*missing)), ","), F.lit("")) if missing else F.lit(None).cast("string")
    with_fixed = mapped.withColumns({c: F.lit(v) for c, v in plan.fixed.items()}) if plan.fixed else mapped
    return with_fixed.withColumn("errors", F.coalesce("errors", found))


def execute(rows: DataFrame, plan: Plan, unit_rules: DataFrame | None = None, number: str = "row_number") -> Run:
    """Run a connector. BLOCKED if a mapped field is gone; else rows are written once, and the status is SUCCEEDED, PARTIAL or FAILED."""
    change = drift([c for c in rows.columns if c != number], plan.known, [m.source for m in plan.mappings])
    if change["blocking"]:
        return Run(None, None, {"status": "BLOCKED", "total": 0, "written": 0, "failed": 0, "blocking": change["blocking"], "added": change["added"]})
    spark = rows.sparkSession
    path, seen = shared_folder(spark), Observation("run")
    done = outcomes(rows, plan, unit_rules, number)
    watched = done.observe(seen, F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("errors").isNull(), 1)).alias("written"))
    watched.withColumn("ok", F.col("errors").isNull()).write.partitionBy("ok").parquet(path)
    counts = seen.get
    failed = counts["total"] - counts["written"]
    status = "SUCCEEDED" if not failed else "PARTIAL" if counts["written"] else "FAILED"
    table = spark.read.schema(T.StructType([*done.schema.fields, T.StructField("ok", T.BooleanType())])).parquet(path)
    bad = table.filter("not ok").select(number, F.explode(F.when(F.col("errors").startswith("SCRIPT:"), F.array("errors")).otherwise(F.split("errors", ","))).alias("e"))
    bad = bad.select(number, F.substring_index("e", ":", 1).alias("code"), F.regexp_extract("e", "^[A-Z]+:([^:]*)", 1).alias("field"), F.col("e").alias("message"))
    return Run(table.filter("ok").drop("ok", "errors"), bad, {"status": status, "total": counts["total"], "written": counts["written"], "failed": failed, "blocking": [], "added": change["added"]})


def error_groups(bad: DataFrame, rows: DataFrame, number: str = "row_number") -> DataFrame:
    """Errors by code and field: how many, the first row with its message and, as a sample, the source row itself."""
    first = F.min(F.struct(number, "message")).alias("first")
    groups = bad.groupBy("code", "field").agg(F.count(F.lit(1)).alias("n"), first).select("code", "field", "n", F.col(f"first.{number}").alias(number), F.col("first.message").alias("message"))
    sample = rows.select(number, F.to_json(F.struct(*[c for c in rows.columns if c != number])).alias("sample"))
    return sample.join(F.broadcast(groups), number).select("code", "field", "n", number, "message", "sample")  # a group for each code and field of the model


def _double_odd(table: pd.DataFrame) -> pd.DataFrame:
    odd = table[pd.to_numeric(table["quantity"]) % 2 == 1]
    return odd.assign(quantity=odd["quantity"] * 2)[[HANDLE, "quantity"]]


def _drop_name(table: pd.DataFrame) -> pd.DataFrame:
    return table[pd.to_numeric(table["quantity"]) == 4].assign(item_ref=None)[[HANDLE, "item_ref"]]


def _plan(*scripts: Script) -> Plan:
    return Plan(("code", "qty", "day", "flag", "house", "extra"), MAPPINGS, TARGETS, scripts)


def _lines(spark, sf_dir) -> DataFrame:
    """Source rows, one for each number, as this table's keys repeat."""
    return _source(spark, sf_dir).groupBy("row_number").agg(*[F.min(c).alias(c) for c in ("code", "qty", "day", "flag", "house", "extra")])


def _ran(spark, sf_dir) -> Run:
    return execute(_lines(spark, sf_dir), _plan(Script("double", _double_odd), Script("nameless", _drop_name), Script("off", _double_odd, enabled=False)))


QUERIES = {
    "connector_run_rows": lambda s, d: _ran(s, d).good.select("row_number", "item_ref", "quantity", F.date_format("base_at", "yyyy-MM-dd").alias("base_at"), "active", "warehouse"),
    "connector_error_groups": lambda s, d: error_groups(_ran(s, d).bad, _lines(s, d)).withColumn("sample", F.get_json_object("sample", "$.code")),
    "connector_run_errors": lambda s, d: _ran(s, d).bad.select("row_number", "code", "field"),
    "connector_run_status": lambda s, d: s.createDataFrame([(r := _ran(s, d).status) and (r["status"], r["total"], r["written"], r["failed"])], "status string, total long, written long, failed long"),
}

_RAN = f"""WITH src AS (SELECT row_number, min(code) AS code, min(qty) AS qty, min(day) AS day, min(flag) AS flag, min(house) AS house FROM ({_BARE}) GROUP BY row_number),
    m AS (SELECT row_number, trim(code) AS item_ref, TRY_CAST(nullif(regexp_replace(qty, '[^0-9.\\-]', '', 'g'), '') AS BIGINT) AS q, CASE WHEN regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN day END AS base_at, CASE flag WHEN 'A' THEN true WHEN 'N' THEN false END AS active, CASE WHEN trim(house) = '' THEN 'main' ELSE house END AS warehouse FROM src),
    t AS (SELECT *, list_filter([CASE WHEN base_at IS NULL THEN 'TYPE:base_at' END, CASE WHEN active IS NULL THEN 'TYPE:active' END], lambda x: x IS NOT NULL) AS typed FROM m),
    s AS (SELECT * REPLACE (CASE WHEN len(typed) = 0 AND q % 2 = 1 THEN q * 2 ELSE q END AS q) FROM t),
    n AS (SELECT * REPLACE (CASE WHEN len(typed) = 0 AND q = 4 THEN NULL ELSE item_ref END AS item_ref) FROM s),
    r AS (SELECT *, CASE WHEN len(typed) > 0 THEN typed ELSE list_filter([CASE WHEN item_ref IS NULL THEN 'REQUIRED:item_ref' END, CASE WHEN q IS NULL THEN 'REQUIRED:quantity' END], lambda x: x IS NOT NULL) END AS errors FROM n)"""
SQL = {
    "connector_run_rows": f"{_RAN} SELECT row_number, item_ref, q AS quantity, base_at, active, warehouse FROM r WHERE len(errors) = 0",
    "connector_error_groups": f"""{_RAN}, e AS (SELECT row_number, unnest(errors) AS e FROM r) SELECT split_part(e, ':', 1) AS code, split_part(e, ':', 2) AS field, count(*) AS n, min(row_number) AS row_number, e AS message, arg_min(code, row_number) AS sample FROM e JOIN src USING (row_number) GROUP BY e""",
    "connector_run_errors": f"{_RAN} SELECT row_number, split_part(e, ':', 1) AS code, split_part(e, ':', 2) AS field FROM (SELECT row_number, unnest(errors) AS e FROM r)",
    "connector_run_status": f"{_RAN} SELECT 'PARTIAL' AS status, count(*) AS total, count(*) FILTER (WHERE len(errors) = 0) AS written, count(*) FILTER (WHERE len(errors) > 0) AS failed FROM r",
}
