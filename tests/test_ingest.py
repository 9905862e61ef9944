"""Order ingest against a plain loop over orders: duplicates, failing orders, stock that falls below 0, late mappings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import ingest as ing

LINE = "channel string, order_no long, line_no int, ordered_at timestamp_ntz, item long, option string, quantity long, amount long, sku_id string, fate int"
START = dt.datetime(2024, 1, 1)


def _batch(seed: int, n: int = 400):
    rng = random.Random(seed)
    rows = []
    for order in range(n):
        at = START + dt.timedelta(minutes=37 * order)
        for line in range(rng.randrange(1, 4)):
            quantity = rng.choice([1, 2, 3, 5]) if rng.random() > 0.02 else rng.choice([0, -1, None])
            item = 1 if rng.random() < 0.4 else rng.randrange(2, 12)  # one item holds most rows
            row = ("shop", order, line, at, item, rng.choice(["A", None]), quantity, 10, "x", 0)
            rows += [row] * (2 if rng.random() < 0.1 else 1)
    return rows


def _mapping(items):
    return [("shop", i, o, f"S{i}{o or ''}", True) for i in items for o in ("A", None)] + [("shop", 99, None, "S1", False)]


def _tables(spark, mapping, stock):
    return spark.createDataFrame(mapping, "channel string, item long, option string, sku string, active boolean"), spark.createDataFrame(stock, "sku string, quantity long")


def _loop(rows, stored, mapping, stock):
    """The same, one order after the other."""
    table = {(c, i, o): s for c, i, o, s, active in mapping if active}
    stock, taken, moves, failed, results = dict(stock), set(stored), [], set(), {}
    for order in sorted({r[1] for r in rows}):
        lines = [r for r in rows if r[1] == order]
        fresh = {r[2]: r for r in lines if r[:3] not in taken}
        skus = {k: table.get((r[0], r[4], r[5])) for k, r in fresh.items()}
        if any(not r[6] or r[6] <= 0 or (skus[k] and skus[k] not in stock) for k, r in fresh.items()):
            failed.add(order)
            results[order] = (0, 0, 0, 0, True)
            continue
        oversold = 0
        for k, r in sorted(fresh.items()):
            taken.add(r[:3])
            if skus[k]:
                stock[skus[k]] -= r[6]
                oversold += stock[skus[k]] < 0
                moves.append((order, k, skus[k], stock[skus[k]]))
        results[order] = (sum(s is not None for s in skus.values()), len(lines) - len(fresh), sum(s is None for s in skus.values()), oversold, False)
    return stock, moves, results


@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_loop_over_orders(spark, seed):
    rows = _batch(seed)
    mapping, stock = _mapping(range(1, 9)), {f"S{i}{o}": 60 for i in range(1, 8) for o in ("A", "")} | {"S8": 0}  # S8A is gone
    stored = [r for r in rows if r[1] % 7 == 0]
    m, s = _tables(spark, mapping, list(stock.items()))
    got = ing.ingest(spark.createDataFrame(rows, LINE), spark.createDataFrame(stored, LINE), m, s)
    left, moves, results = _loop(rows, {r[:3] for r in stored}, mapping, stock)
    assert {(r.order_no, r.line_no, r.sku, r.quantity_after) for r in got.movements.collect()} == set(moves)
    assert {r.order_no: (r.new, r.duplicates, r.unmapped, r.oversold, r.failed) for r in got.orders.collect()} == results
    assert {r.sku: r.quantity for r in ing.stock_after(s, got.movements).collect()} == left
    total = got.summary.first()
    assert (total.orders, total.failed, total.outcome) == (len(results), sum(r[-1] for r in results.values()), "PARTIAL")
    assert total.new == len(moves) and got.alerts.filter("type = 'OVERSELL'").count() == sum(r[3] for r in results.values())


def test_reading_a_batch_again_changes_nothing(spark):
    rows = [r for r in _batch(3, 60) if r[6] and r[6] > 0]
    m, s = _tables(spark, _mapping(range(1, 12)), [(f"S{i}{o}", 5) for i in range(1, 12) for o in ("A", "")])
    batch = spark.createDataFrame(rows, LINE)
    first = ing.ingest(batch, batch.limit(0), m, s)
    again = ing.ingest(batch, first.lines, m, s)
    assert first.summary.first().outcome == "SUCCESS" and first.lines.count() == len({r[:3] for r in rows})
    assert again.movements.count() == again.alerts.count() == again.incidents.count() == 0
    assert again.summary.first().duplicates == len(rows)


def test_late_mappings_take_stock_once(spark):
    rows = [r for r in _batch(4, 80) if r[6] and r[6] > 0]
    stock = [(f"S{i}{o}", 20) for i in range(1, 12) for o in ("A", "")]
    few, s = _tables(spark, _mapping([2]), stock)
    every, _ = _tables(spark, _mapping(range(1, 12)), stock)
    batch = spark.createDataFrame(rows, LINE)
    first = ing.ingest(batch, batch.limit(0), few, s)
    now = ing.stock_after(s, first.movements)
    lines, late = ing.settle(first.lines, every, now)
    assert lines.filter("not stock_applied or sku is null").isEmpty() and lines.count() == first.lines.count()
    end = {r.sku: r.quantity for r in ing.stock_after(now, late).collect()}
    sold = {}
    for r in {r[:3]: r for r in rows}.values():
        sold[f"S{r[4]}{r[5] or ''}"] = sold.get(f"S{r[4]}{r[5] or ''}", 0) + r[6]
    assert end == {k: q - sold.get(k, 0) for k, q in stock}
    assert ing.settle(lines, every, now)[1].isEmpty()


def test_odd_rows_fail_alone(spark):
    good = ("shop", 1, 0, START, 1, None, 2, 10, "x", 0)
    rows = [good, (None, 1, 0, START, 1, None, 2, 10, "x", 0), ("shop", None, 0, START, 1, None, 2, 10, "x", 0), ("shop", 2, 0, None, 1, None, 2, 10, "x", 0), ("shop", 3, 0, START, None, None, 2, 10, "x", 0)]
    m, s = _tables(spark, _mapping([1]), [("S1", 1)])
    got = ing.ingest(spark.createDataFrame(rows, LINE), spark.createDataFrame([], LINE), m, s)
    assert {(r.channel, r.order_no): r.fate for r in got.fates.collect()} == {("shop", 1): "NEW", (None, 1): "FAILED", ("shop", None): "FAILED", ("shop", 2): "FAILED", ("shop", 3): "UNMAPPED"}
    assert {r.key: r.occurrences for r in got.incidents.collect()} == {"OVERSELL:S1": 1, "UNMAPPED_PRODUCT:shop:-:-": 1}
    folded = ing.fold_incidents(got.incidents.filter(F.col("type") == "OVERSELL"), got.incidents)
    assert {r.key: r.occurrences for r in folded.collect()} == {"OVERSELL:S1": 2, "UNMAPPED_PRODUCT:shop:-:-": 1}
    empty = spark.createDataFrame([], LINE)
    assert ing.ingest(empty, empty, m, s).summary.isEmpty()
