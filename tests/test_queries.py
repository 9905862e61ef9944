"""Every commerce query against its SQL, and those without SQL against plain Python."""

import datetime as dt
import random

import pytest

from lakeloom import catalog
from lakeloom.operators import names
from lakeloom.plans import ledger

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"greedy_pairs", "breakdown_lines_name"}


def test_greedy_pairs_take_the_best_first(spark, sf_dir):
    scored = names.scored_pairs(names._unit_names(spark, sf_dir), "erp", "wms")
    got = {(r.unit_id, r.left_name, r.right_name) for r in names.greedy_pairs(scored).collect()}
    wanted, used = set(), set()
    for r in sorted(scored.collect(), key=lambda r: (-r.score, r.left_name, r.right_name)):
        left, right = (r.unit_id, "l", r.left_name), (r.unit_id, "r", r.right_name)
        if left not in used and right not in used:
            used |= {left, right}
            wanted.add((r.unit_id, r.left_name, r.right_name))
    assert got == wanted


def test_suppression_with_one_busy_key(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [("busy" if i % 2 else rng.choice(["a", "b", "", None]), i, start + dt.timedelta(minutes=rng.randrange(60 * 24 * 20))) for i in range(30_000)] + [("late", 30_001, None)]
    got = {(r.key, r.id) for r in ledger.suppress(spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz"), 6).collect()}
    wanted, last = set(), {}
    for key, i, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        if key not in last or ts - last[key] >= dt.timedelta(hours=6):
            last[key] = ts
            wanted.add((key, i))
    assert got == wanted


def test_common_start_of_a_unit(spark):
    rows = [(1, "Camp tent (27.03) red"), (1, "Camp tent (27.04) blue"), (2, "ab"), (2, "xy"), (3, "lone")]
    got = {r.unit_id: r.common for r in names.common_start(spark.createDataFrame(rows, "unit_id int, name string")).collect()}
    assert got == {1: "Camp tent", 2: None, 3: "lone"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["unit_id", "item_ref", "left_quantity", "right_quantity", "delta", "diff_type"]
