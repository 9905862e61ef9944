"""Streams that come in several batches and out of order, against the batch forms and plain Python."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import ledger
from lakeloom.streaming import ordered, resume
from lakeloom.streaming.alerts import drain

SCHEMA = "key string, id long, ts timestamp, cents long, resolves boolean"
START = dt.datetime(2024, 1, 1, 12)
PLACES = itertools.count()


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream with one batch for each list of rows."""

    def make(*batches, schema=SCHEMA):
        place = str(tmp_path / f"in{next(PLACES)}")
        add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        for rows in batches:
            add(rows)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place), add

    return make


def row(key, i, minutes, cents=1, resolves=False):
    return key, i, START + dt.timedelta(minutes=minutes), cents, resolves


def made(seed, many, hours, keys="abc"):
    """Rows in the order in which they come: up to five minutes late. Half of all have one key."""
    rng = random.Random(seed)
    rows = [row("busy" if rng.random() < 0.5 else rng.choice(keys), i, rng.uniform(0, hours * 60), rng.randint(1, 9), rng.random() < 0.2) for i in range(many)]
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, 5)))


def split(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


FAR = [row("end", 10**6, 60 * 24 * 60)]  # moves the watermark past all others


def brute_held(rows, minutes, quiet):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted(r[2] for r in rows if r[0] == key)
        cents = {}
        for r in rows:
            if r[0] == key:
                cents[r[2]] = cents.get(r[2], 0) + r[3]
        while own:
            at = own[0] + dt.timedelta(minutes=minutes)
            while quiet and (lambda m: m >= quiet[0] or m < quiet[1])((at + dt.timedelta(hours=9)).hour * 60 + (at + dt.timedelta(hours=9)).minute):
                at = (at + dt.timedelta(minutes=1)).replace(second=0, microsecond=0)
            taken = [t for t in own if t <= at]
            out.append((key, own[0], at, len(taken), sum(cents[t] for t in set(taken))))
            own = own[len(taken) :]
    return sorted(out)


@pytest.mark.parametrize("quiet", [None, (23 * 60, 7 * 60)])
def test_held_batches_of_stream_batch_and_plain_python(spark, stream_of, quiet):
    rows = made(1, 600, 60)
    wanted = brute_held(rows, 30, quiet)
    batch = ledger.held_batches(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 30, quiet)
    assert sorted(map(tuple, batch.collect())) == wanted
    stream, _ = stream_of(*split(rows, 4), FAR)
    got = drain(ordered.held(stream, 30, quiet)).filter("key <> 'end'").selectExpr("key", "cast(oldest as timestamp_ntz)", "cast(sent as timestamp_ntz)", "n", "cents")
    assert sorted(map(tuple, got.collect())) == wanted


def test_a_late_event_moves_the_start_of_a_batch(stream_of):
    """The second batch brings an event from before the first one's, still within the watermark; the last but one too late (a batch drops what the one before it had passed)."""
    stream, _ = stream_of([row("a", 1, 10)], [row("a", 2, 4), row("b", 3, 30)], [row("b", 5, 31)], [row("a", 4, 1)], FAR)
    got = drain(ordered.held(stream, 15)).filter("key = 'a'").collect()
    assert [(r.oldest, r.sent, r.n) for r in got] == [(START + dt.timedelta(minutes=4), START + dt.timedelta(minutes=19), 2)]


def test_suppression_with_state_that_ends(spark, stream_of):
    rows = made(2, 800, 72)
    stream, _ = stream_of(*split(rows, 3), FAR)
    got = sorted((r.key, r.id) for r in drain(ordered.suppressed(stream, 5)).filter("key <> 'end'").collect())
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("key", "id", "cast(ts as timestamp_ntz) as ts")
    assert got == sorted((r.key, r.id) for r in ledger.suppress(frame, 5).collect())


def test_incidents_of_a_stream(stream_of):
    rows = made(3, 700, 48)
    stream, _ = stream_of(*split(rows, 3), FAR)
    got = {(r.key, r.first_id): (r.occurrences, r.resolved, r.last_id) for r in ordered.latest(drain(ordered.incidents(stream))).filter("key <> 'end'").collect()}
    wanted, open_ = {}, {}
    for key, i, _, _, resolves in sorted(rows, key=lambda r: r[2]):
        if not resolves:
            open_.setdefault(key, i)
        if key in open_:
            n, _, last = wanted.get((key, open_[key]), (0, False, 0))
            wanted[(key, open_[key])] = (n + (not resolves), resolves, max(last, i))
        if resolves:
            open_.pop(key, None)
    assert got == wanted


class Refused(Exception):
    pass


def test_a_failed_batch_is_read_again(spark, stream_of, tmp_path):
    """The second of three batches fails after its rows are written: nothing of it shows, and the next call loses and doubles nothing."""
    batches = [[row("a", 10 * b + i, b) for i in range(3)] for b in range(3)]
    stream, add = stream_of(*batches)
    place = str(tmp_path / "place")
    fails = {1}

    def check(rows, number):
        if number in fails:
            raise Refused

    with pytest.raises(Exception, match="Refused"):
        resume.collect(stream, place, check)
    seen = lambda: sorted(r.id for r in resume.committed(spark, place).collect())
    assert seen() == [0, 1, 2] and [r.batch for r in resume.commits(spark, place).collect()] == [0]
    fails.clear()
    assert resume.collect(stream, place, check) == 2
    assert seen() == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    assert resume.collect(stream, place, check) == 0
    add([row("a", 99, 9)])
    assert resume.collect(stream, place, check) == 1
    assert seen()[-1] == 99 and len(seen()) == 10
    assert sorted((r.batch, r.rows) for r in resume.commits(spark, place).collect()) == [(0, 3), (1, 3), (2, 3), (3, 1)]


def test_a_late_mapping_reaches_each_line_once(spark, stream_of, tmp_path):
    lines, add_line = stream_of([(1, 1, "x"), (1, 2, "y")], [(2, 1, "x"), (1, 1, "x")], schema="o int, l int, item string")
    maps, add_map = stream_of([("x", 7)], schema="item string, sku int")
    place = str(tmp_path / "late")
    run = lambda: sorted(map(tuple, resume.match_late(lines, maps, place, ["o", "l"], "item", "sku").collect()))
    first = [(1, 1, "x", 7), (2, 1, "x", 7)]
    assert run() == first
    assert run() == first
    add_line([(3, 1, "x"), (3, 2, "z"), (1, 1, "x")])
    add_map([("y", 8)])
    assert run() == sorted([*first, (1, 2, "y", 8), (3, 1, "x", 7)])
    add_map([("z", None), ("z", 9)])
    assert run() == sorted([*first, (1, 2, "y", 8), (3, 1, "x", 7), (3, 2, "z", 9)])


def test_a_batch_of_mappings_that_runs_twice(spark, stream_of, tmp_path):
    """Without its line in the log of commits, the batch is run again over what it had written."""
    lines, _ = stream_of([(1, 1, "x"), (1, 2, "x")], schema="o int, l int, item string")
    maps, _ = stream_of([("x", 7)], schema="item string, sku int")
    place = tmp_path / "twice"
    run = lambda: sorted(map(tuple, resume.match_late(lines, maps, str(place), ["o", "l"], "item", "sku").collect()))
    assert run() == [(1, 1, "x", 7), (1, 2, "x", 7)]
    for name in ("lines", "mappings"):
        for f in (place / "cursor" / name / "commits").iterdir():
            if f.name.lstrip(".").split(".")[0] == "0":
                f.unlink()
    assert run() == [(1, 1, "x", 7), (1, 2, "x", 7)]


def test_a_refused_call_spends_nothing(spark):
    """In the middle of the day a dear call is refused; cheaper ones after it are paid. Searches have a budget of their own."""
    costs = [(30, False), (20, True), (40, False), (10, True), (25, False), (5, False), (3, True)]
    calls = [("a", i, START + dt.timedelta(minutes=i), c, s) for i, (c, s) in enumerate(costs)] + [("a", 50, START + dt.timedelta(days=1), 60, False), ("b", 60, START, 61, False), (None, 61, START, 1, None), ("a", 70, None, 1, False)]
    got = {r.id: (r.paid, r.used, r.searched) for r in ledger.within_budgets(spark.createDataFrame(calls, "owner string, id long, ts timestamp, cost int, search boolean"), 60, 25).collect()}
    assert [got[i] for i in range(7)] == [(True, 30, 0), (True, 50, 20), (False, 50, 20), (False, 50, 20), (False, 50, 20), (True, 55, 20), (True, 58, 23)]
    assert got[50] == (True, 60, 0) and got[60] == (False, 0, 0) and got[61] == (True, 1, 0) and 70 not in got
