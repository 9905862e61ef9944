"""Channels and messages as their platforms give them, and stock that runs low, against stated values and plain loops."""

import datetime as dt
import random

from lakeloom.plans import stock_alerts as sa
from lakeloom.plans import upstream as up

DAY = dt.datetime(2024, 3, 1)
CHANNEL = "channel_id long, subscribers long, dormant boolean, refreshed timestamp_ntz"
ANSWER = "channel_id long, ts timestamp_ntz, id long, subscribers long"


def hours(n: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=n)


def test_a_channel_without_an_answer_goes_dormant(spark):
    channels = spark.createDataFrame([(1, 10, False, None), (2, 20, False, DAY), (3, 30, False, None), (4, 40, True, DAY)], CHANNEL)
    asked = spark.createDataFrame([(1,), (2,), (2,), (4,)], "channel_id long")
    answers = spark.createDataFrame([(1, hours(2), 2, 12), (1, hours(1), 1, 11), (3, hours(1), 3, 99)], ANSWER)
    got = {r.channel_id: (r.subscribers, r.dormant, r.refreshed) for r in up.refreshed(channels, asked, answers).collect()}
    assert got == {1: (12, False, hours(2)), 2: (20, True, DAY), 3: (30, False, None), 4: (40, True, DAY)}
    assert up.refreshed(channels, asked.limit(0), answers).exceptAll(channels).isEmpty()


def test_one_snapshot_a_day_however_often_it_runs(spark):
    answers = spark.createDataFrame([(1, hours(23), 2, 12), (1, hours(3), 1, 11), (1, hours(24), 3, 13), (2, hours(5), 4, 7)], ANSWER)
    first = up.captured(spark.createDataFrame([(2, DAY.date(), 5)], "channel_id long, day date, subscribers long"), answers)
    assert {(r.channel_id, r.day.day, r.subscribers) for r in first.collect()} == {(1, 1, 11), (1, 2, 13), (2, 1, 5)}
    later = spark.createDataFrame([(1, hours(25), 9, 99), (2, hours(30), 10, 8)], ANSWER)
    again = up.captured(first, answers.unionByName(later))
    assert {(r.channel_id, r.day.day, r.subscribers) for r in again.collect()} == {(1, 1, 11), (1, 2, 13), (2, 1, 5), (2, 2, 8)}


def test_videos_of_unknown_length_are_left_out(spark):
    schema = "video_id long, title string, duration_seconds int, views long, likes long, comments long, paid boolean"
    stored = spark.createDataFrame([(1, "a", 60, 5, 1, 1, False), (2, "b", 70, 6, 1, 1, False)], schema)
    now = spark.createDataFrame([(1, "A", 61, 9, 2, 3, True), (2, "B", -1, 9, 9, 9, True), (3, "c", None, 1, 1, 1, True), (4, "d", 0, 1, 0, 0, False)], schema)
    assert {tuple(r) for r in up.videos_after(stored, now).collect()} == {(1, "a", 60, 9, 2, 3, True), (2, "b", 70, 6, 1, 1, False), (4, "d", 0, 1, 0, 0, False)}


def test_messages_like_a_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["busy", "busy", "busy", "a", "b", None]), hours(rng.randrange(500)), i, rng.choice(["fail"] * 12 + ["fatal", "retry", "retry"] + ["ok"] * (i % 40 == 0))) for i in range(5_000)]
    wanted = {}
    for key, _, _, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        status, attempts, ignored = wanted.get(key, ("PENDING", 0, 0))
        if status == "FAILED" and kind == "retry":
            wanted[key] = ("PENDING", 0, ignored)
        elif status == "PENDING" and kind == "ok":
            wanted[key] = ("SENT", attempts, ignored)
        elif status == "PENDING" and kind in ("fail", "fatal"):
            wanted[key] = ("FAILED" if kind == "fatal" or attempts == 4 else "PENDING", attempts + 1, ignored)
        else:
            wanted[key] = (status, attempts, ignored + 1)
    got = up.delivery(spark.createDataFrame(rows, "key string, at timestamp_ntz, id long, kind string"))
    assert {r.key: (r.status, r.attempts, r.ignored) for r in got.collect()} == wanted
    assert up.delivery(spark.createDataFrame([], "key long, at timestamp_ntz, id long, kind string")).isEmpty()


def test_a_failed_message_is_sent_after_a_retry_by_hand(spark):
    kinds = ["retry", "fail", "fail", "fail", "fail", "fail", "ok", "retry", "ok", "fail"]  # refused, five failures, too late, back, sent, too late
    rows = [(1, hours(i), i, k) for i, k in enumerate(kinds)]
    made = lambda n: up.delivery(spark.createDataFrame(rows[:n], "key long, at timestamp_ntz, id long, kind string")).first()
    assert tuple(made(5)) == (1, "PENDING", 4, 1)
    assert tuple(made(7)) == (1, "FAILED", 5, 2)
    assert tuple(made(8)) == (1, "PENDING", 0, 2)
    assert tuple(made(10)) == (1, "SENT", 0, 3)


def test_stock_that_runs_low_is_told_again_after_the_interval(spark):
    moves = [(1, 20, "INITIAL", hours(-24), 0)] + [(1, -4, "SALE", hours(24 * d + 5), d) for d in range(1, 9)] + [(1, 3, "RESTOCK", hours(24 * 5 + 6), 50)]
    movements = spark.createDataFrame(moves, "sku_id long, delta long, reason string, created_at timestamp_ntz, movement_id long")
    skus = spark.createDataFrame([(1, "S1", 10, True), (2, "S2", 10, True)], "sku_id long, code string, safety_threshold long, active boolean")
    found = sa.days_below(movements, skus)
    assert {(r.day.day - 1, r.quantity, round(r.average, 3)) for r in found.collect()} == {(3, 8, 1.714), (4, 4, 2.286), (5, 3, 2.857), (6, -1, 3.429), (7, -5, 4.0), (8, -9, 4.0)}
    sent = lambda h: sorted((r.ts.day - 2, r.key, r.quantity) for r in sa.stock_alerts(found, h).collect())
    assert sent(48) == [(3, "LOW_STOCK:S1", 8), (5, "LOW_STOCK:S1", 3), (6, "OUT_OF_STOCK:S1", -1), (8, "OUT_OF_STOCK:S1", -9)]
    assert sent(24 * 30) == [(3, "LOW_STOCK:S1", 8), (6, "OUT_OF_STOCK:S1", -1)]
    assert sa.days_below(movements, skus.withColumn("active", skus.active & (skus.sku_id == 2))).isEmpty()
