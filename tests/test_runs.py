"""Connector runs: status, errors and scripts on small tables, and one scan of the source."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.columns import compiles
from lakeloom.operators import runs
from lakeloom.operators.runs import HANDLE, Plan, Script, execute, scripted
from lakeloom.operators.transform import Mapping, Target

TARGETS = (Target("item_ref", "STRING", True), Target("quantity", "INTEGER", True), Target("unit", "STRING"))
MAPPINGS = (Mapping("code", "item_ref", "TRIM"), Mapping("qty", "quantity"), Mapping("u", "unit"))
SCHEMA = "row_number long, code string, qty string, u string, extra string"


def plan(*scripts, known=("code", "qty", "u", "extra"), **more):
    return Plan(known, MAPPINGS, TARGETS, scripts, **more)


def source(spark, rows):
    return spark.createDataFrame([(n, *r, "x") for n, r in enumerate(rows, 1)], SCHEMA)


def test_statuses(spark):
    good, bad = ("a", "1", "EA"), ("b", "many", "EA")
    status = lambda *rows: execute(source(spark, rows), plan()).status
    assert status(good, good)["status"] == "SUCCEEDED"
    assert status(bad)["status"] == "FAILED"
    assert status()["status"] == "SUCCEEDED"
    done = execute(source(spark, [good, bad, ("", "2", None)]), plan())
    assert done.status == {"status": "PARTIAL", "total": 3, "written": 1, "failed": 2, "blocking": [], "added": []}
    assert sorted((r.row_number, r.code, r.field) for r in done.bad.collect()) == [(2, "TYPE", "quantity"), (3, "REQUIRED", "item_ref")]
    assert [(r.item_ref, r.quantity, r.attributes) for r in done.good.collect()] == [("a", 1, '{"extra":"x"}')]


def test_a_field_that_is_gone_blocks_only_if_it_is_mapped(spark):
    rows = source(spark, [("a", "1", "EA")])
    blocked = execute(rows.drop("u"), plan())
    assert blocked.status["status"] == "BLOCKED" and blocked.status["blocking"] == ["u"] and blocked.good is None
    assert execute(rows.drop("extra").withColumn("new", F.lit(1)), plan()).status["status"] == "SUCCEEDED"
    assert execute(rows.withColumn("new", F.lit(1)), plan()).status["added"] == ["new"]


def test_the_source_is_read_once(spark, tmp_path):
    """What the accumulator counts is rows that leave the source: each once, for both sinks, the counts and the status."""
    path = str(tmp_path / "src")
    source(spark, [("a", "1", "EA"), ("b", "x", "EA")] * 50).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.read.parquet(path)
    done = execute(rows.mapInPandas(count, rows.schema), plan())
    assert done.good.count() == 50 and done.bad.count() == 50 and done.status["failed"] == 50
    assert seen.value == 100


def test_units(spark):
    rules = spark.createDataFrame([("", "BOX", 12), ("a", "BOX", 6)], "item_ref string, from_unit string, factor int")
    done = execute(source(spark, [("a", "2", "BOX"), ("b", "2", "BOX"), ("c", "2", "EA"), ("d", "2", ""), ("e", "2", "BAG"), ("f", "x", "BAG")]), plan(unit="EA"), rules)
    assert {r.item_ref: r.quantity for r in done.good.collect()} == {"a": 12, "b": 24, "c": 2, "d": 2}
    assert sorted((r.row_number, r.code, r.field) for r in done.bad.collect()) == [(5, "UNIT", "unit"), (6, "TYPE", "quantity")]


def test_required_is_looked_for_after_the_scripts(spark):
    def fill(t):
        return pd.DataFrame({HANDLE: t[HANDLE], "item_ref": t["item_ref"].fillna("made"), "quantity": t["quantity"].where(t["quantity"] != 9, None)})

    done = execute(source(spark, [(None, "1", None), ("b", "9", None)]), plan(Script("fill", fill)))
    assert [(r.row_number, r.item_ref) for r in done.good.collect()] == [(1, "made")]
    assert [(r.row_number, r.code, r.field) for r in done.bad.collect()] == [(2, "REQUIRED", "quantity")]


def numbered(spark, many, parts):
    return spark.range(many).select((F.col("id") * 3).alias("row_number"), F.concat(F.lit("i"), "id").alias("item_ref"), (F.col("id") % 7).cast("int").alias("quantity")).repartition(parts)


def test_chunks_do_not_depend_on_batches_or_partitions(spark):
    """A script that writes each chunk's sum and size into its rows tells the chunks."""

    def told(t):
        return t.assign(quantity=int(t["quantity"].sum()) * 1000 + len(t), item_ref=f"{t[HANDLE].min()}-{t[HANDLE].max()}")

    results = []
    for parts, batch in ((1, "10000"), (7, "10"), (3, "100")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        results.append(sorted(map(tuple, scripted(numbered(spark, 1234, parts), [Script("told", told)]).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1] == results[2]
    assert {r[1] for r in results[0]} == {"0-1497", "1500-2997", "3000-3699"}
    assert {r[2] % 1000 for r in results[0]} == {500, 234}


def test_a_failure_stays_in_its_chunk(spark):
    def fails(t):
        if 999 in set(t[HANDLE]):
            raise KeyError("no such thing")
        return t.assign(quantity=100)

    def slow(t):
        if 0 in set(t[HANDLE]):
            time.sleep(30)
        return t[[HANDLE]]

    def odd(t):
        return t.assign(quantity="text") if 2001 in set(t[HANDLE]) else t

    got = {r.row_number: r for r in scripted(numbered(spark, 1000, 4), [Script("fails", fails), Script("slow", slow, seconds=0.5), Script("odd", odd), Script("off", fails, enabled=False)], size=200).collect()}
    assert len(got) == 1000
    assert got[999].script_error.startswith("SCRIPT:fails: KeyError") and got[999].quantity == 333 % 7
    assert got[3].script_error.startswith("SCRIPT:slow: TimeoutError") and got[3].quantity == 1
    assert got[2001].script_error.startswith("SCRIPT:odd: ") and got[2001].quantity == 667 % 7
    assert got[2997].script_error is None and got[2997].quantity == 100


def test_what_a_script_may_return(spark):
    rows = numbered(spark, 4, 2)
    first = lambda *rows: lambda t: pd.DataFrame(list(rows), columns=[HANDLE, "quantity", "stranger"])
    got = {r.row_number: (r.quantity, r.script_error) for r in scripted(rows, [Script("patch", first((3, 70, "x"), (3, 71, "x"), (99, 5, "x"), (None, 6, "x"))), Script("none", lambda t: None), Script("empty", lambda t: t.head(0))]).collect()}
    assert got == {0: (0, None), 3: (71, None), 6: (2, None), 9: (3, None)}
    lost = scripted(rows, [Script("lost", lambda t: t.drop(columns=[HANDLE]))]).first()
    assert "no column _row" in lost.script_error
    assert scripted(rows.limit(0), [Script("patch", first((3, 1, "x")))]).collect() == []


def test_scripts_run_in_order(spark):
    add = lambda k: lambda t: t.assign(quantity=t["quantity"] * 10 + k)[[HANDLE, "quantity"]]
    got = scripted(numbered(spark, 3, 2), [Script("a", add(1)), Script("b", add(2))])
    assert {r.row_number: r.quantity for r in got.collect()} == {0: 12, 3: 112, 6: 212}


@pytest.mark.parametrize("pattern", ["((a+))+b", "(a|aa)*b", "(a{1,9})+b", "(a+)+", "(a|a)*", r"(\d+[.-]?)+", "(.*)*x", "(x+x+)+y", "(a*)*", "(?:a?){20}a", r"^(\w+\s?)*$", "(?i)(a|A)+", "(a|b|ab)*c", r"(?=(a+)+b)c", r"(\w|\d)+", '(?:[^"]|\\\\.)*', "(ab|ab)*", r"(.+)\1+\1+x", "x" * 500, "(", "(?<n"])
def test_patterns_that_run_away_or_do_not_compile(pattern):
    assert not compiles(pattern)


@pytest.mark.parametrize("pattern", ["(ab+c)+", "(a|b)*", r"\([^)]*\)", r"_\d{2}[.\-/]\d{2}[.\-/]\d{2}$", r"\d{2,4}[.\-/]\d{1,2}[.\-/]\d{1,2}", r"\s+", "(a?b)*", "([a-z]+,)*", "a{1,3}b{2}", "(한글|한)+", "(ab|a)(bc|c)", "(ab)*?c", r"[\w\d.-]+@", "(?:red|green|blue)+", ".*x.*", "", "^$"])
def test_patterns_that_are_fine(pattern):
    assert compiles(pattern)


def test_the_query_counts_what_it_writes(spark, sf_dir):
    done = runs._ran(spark, sf_dir)
    assert done.good.count() == done.status["written"] and done.bad.select("row_number").distinct().count() == done.status["failed"]
