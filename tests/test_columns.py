import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import columns as c
from lakeloom.operators import filters as f
from lakeloom.operators import transform as t
from lakeloom.operators.reconcile import compare, latest_values, promote
from lakeloom.plans import upkeep
from lakeloom.plans.scoring import Rubric, metrics, rule_score
from lakeloom.plans.trends import growth


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("x", "wanted"),
    [(0.08, 2.0), (-1.0, 0.0), (9.9, 14.0), (0.115, 3.5)],
)
def test_curve_is_clamped(spark, x, wanted):
    assert one(spark, c.curve(F.lit(x), Rubric().vsr)) == pytest.approx(wanted)


def test_grades(spark):
    assert [one(spark, c.grade(F.lit(float(x)))) for x in (85, 84.9, 70, 55, 40, 39.9)] == list("SAABCD")


@pytest.mark.parametrize("token", ["어제", "오늘+", "2026-13-01", "오늘+100000", "2026-1-1"])
def test_bad_date_tokens(token):
    with pytest.raises(ValueError):
        c.relative_date(token, dt.date(2026, 8, 1))


def test_date_tokens():
    today = dt.date(2026, 8, 1)
    assert c.relative_date("오늘-1", today) == dt.date(2026, 7, 31)
    assert c.relative_date("today", today) == today
    assert c.relative_date("2026-02-03", today) == dt.date(2026, 2, 3)


def test_dice(spark):
    pairs = [("night", "nacht", 0.25), ("same", "same", 1.0), ("", "", 0.0), ("a", "b", 0.0), ("ab", "cd", 0.0), (None, "x", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, w double")
    assert all(r.got == pytest.approx(r.w) for r in rows.withColumn("got", c.dice(F.col("a"), F.col("b"))).collect())


def test_names_lose_lots(spark):
    rows = spark.createDataFrame([("클래식 850g (27.03.16)",), ("C850P_27.03.16",), ("Tent 2026-10-17",), (None,), ("  ",)], "x string")
    assert [r[0] for r in rows.select(c.normalize_name(F.col("x"))).collect()] == ["클래식850g", "c850p", "tent", "", ""]


def test_bad_patterns_are_left_out(spark):
    assert one(spark, c.normalize_name(F.lit("A b"), [("(", ""), ("(a+)+", ""), ("b", "c")])) == "ac"


def test_keywords(spark):
    assert sorted(one(spark, c.keywords(F.lit("캠핑장에서 리뷰 텐트를 2026 A")))) == sorted(["캠핑장", "텐트", "캠핑장 리뷰", "리뷰 텐트"])
    assert one(spark, c.keywords(F.lit(None).cast("string"))) == []


def test_types(spark):
    cases = [("12", "INTEGER", 12), ("1.5", "INTEGER", None), ("x", "DECIMAL", None), ("1.5", "DECIMAL", Decimal("1.5")), ("예", "BOOLEAN", True), ("No", "BOOLEAN", False), ("maybe", "BOOLEAN", None), ("2026-08-12", "DATE", dt.date(2026, 8, 12)), ("2026-8-1", "DATE", None), ("2026-08-12T01:02", "DATE", dt.date(2026, 8, 12))]
    assert [one(spark, c.typed(F.lit(x), kind)) for x, kind, _ in cases] == [w for *_, w in cases]


def test_small_text_functions(spark):
    assert one(spark, c.iso_seconds(F.lit("PT1H2M3S"))) == 3723
    assert one(spark, c.iso_seconds(F.lit("P"))) == -1
    assert one(spark, c.split_pipes(F.lit(" a | | b"))) == ["a", "b"]
    assert one(spark, c.natural_key(F.lit(""), F.lit(None))) is None
    assert one(spark, c.vtt_text(F.lit("WEBVTT\n\n00:01 --> 00:02\n<b>hi</b>\nhi\nyou"))) == "hi you"
    assert one(spark, c.grounded(F.lit("Good  TENT"), F.lit("a good tent")))
    assert not one(spark, c.grounded(F.lit("good"), F.lit("a good tent")))
    assert one(spark, c.mask_secrets(F.create_map(F.lit("api_token"), F.lit("x"), F.lit("n"), F.lit("y")))) == {"api_token": "****", "n": "y"}
    assert one(spark, c.in_quiet_hours(F.lit(30), 1380, 420))


def test_filters_refuse_what_does_not_fit():
    for field, operator, values in [("quantity", "CONTAINS", ("1",)), ("lot_code", "BETWEEN", ("a", "b")), ("nothing", "EQ", (1,)), ("quantity", "BETWEEN", (1,)), ("quantity", "EQ", ("x",)), ("attributes.a'b", "EQ", ("1",)), ("lot_code", "MATCHES", ("(",)), ("lot_code", "LIKE", ("a",))]:
        with pytest.raises(ValueError):
            f.Condition(field, operator, values).column(dt.date(2026, 1, 1))


def test_filters_keep_nulls_out(spark):
    rows = spark.createDataFrame([("A",), (None,), ("",)], "lot_code string")
    kept = lambda *a: [r[0] for r in f.apply_filter(rows, f.of_rows([a]), dt.date(2026, 1, 1)).collect()]
    assert kept("lot_code", "NOT_IN", ("A",)) == [""]
    assert kept("lot_code", "NE", ("A",)) == [""]
    assert kept("lot_code", "IS_EMPTY", ()) == [None, ""]


def test_one_bad_row_of_three(spark):
    rows = spark.createDataFrame([(1, "A-001", "10"), (2, "A-002", "없음"), (3, "A-003", "7")], "row_number int, code string, qty string")
    mapped = t.map_rows(rows, [t.Mapping("code", "item_ref"), t.Mapping("qty", "quantity")], [t.Target("item_ref", "STRING", True), t.Target("quantity", "INTEGER", True)])
    good, errors = t.split_errors(mapped)
    assert t.run_status(good, errors).first().asDict() == {"written": 2, "failed": 1, "status": "PARTIAL"}
    assert [tuple(r) for r in errors.collect()] == [(2, "TYPE", "quantity")]


def test_drift_blocks_only_mapped_fields():
    assert t.drift(["a", "n"], ["a", "b", "c"], ["b"]) == {"added": ["n"], "removed": ["b", "c"], "blocking": ["b"]}


def test_undo_brings_back_what_was_there(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    merged = t.merge(old, new, ["k"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, t.undo(merged, old, new, ["k"]).collect())) == [(1, "a"), (2, "b")]


def test_suggestions(spark):
    fields = spark.createDataFrame([("QTY", "INTEGER"), ("item name", "STRING")], "field string, kind string")
    targets = spark.createDataFrame([("quantity", "INTEGER", "qty|stock"), ("name", "STRING", "title")], "target string, kind string, aliases string")
    assert sorted(map(tuple, t.suggestions(fields, targets).collect())) == [("name", "item name", 100), ("quantity", "QTY", 140)]


def test_tolerance_and_promotion(spark):
    sums = spark.createDataFrame([("erp", 1, 100), ("wms", 1, 80), ("erp", 2, 5), ("wms", 2, 5)], "source string, unit_id int, quantity bigint")
    first = compare(sums, "erp", "wms", 10).withColumn("run", F.lit(1))
    none = first.limit(0).withColumns({"state": F.lit(""), "first_seen": F.lit(0)})
    run1 = promote(first, none)
    assert [(r.unit_id, r.delta, r.state, r.first_seen) for r in run1.collect()] == [(1, 20, "OBSERVING", 1)]
    run2 = promote(first.withColumn("run", F.lit(2)), run1)
    assert [(r.state, r.first_seen) for r in run2.collect()] == [("CONFIRMED", 1)]


def test_channel_measures(spark):
    at = dt.datetime(2026, 8, 1)
    videos = [(1, i, at - dt.timedelta(days=i + 1), 300, 8000 + 1000 * i, (8000 + 1000 * i) / 20, (8000 + 1000 * i) / 100, False) for i in range(5)]
    rows = spark.createDataFrame(videos, "channel_id int, video_id int, published_at timestamp_ntz, duration_seconds int, views bigint, likes double, comments double, paid boolean")
    channels = spark.createDataFrame([(1, 50_000), (2, 10)], "channel_id int, subscribers int")
    m = {r.channel_id: r for r in metrics(channels, rows, at).collect()}
    assert (m[1].median_views, m[1].vsr, round(m[1].engagement_rate, 6)) == (10_000, 0.2, 0.08)
    assert (m[2].n_videos, m[2].trend_ratio, m[2].days_since) == (0, 1.0, 2**63 - 1)


def test_perfect_channel_and_crash(spark):
    good = spark.createDataFrame([(30_000.0, 0.6, 1.6, 1.0, 0.9, 0.09, 20, 3, 0.2)], "median_views double, vsr double, trend_ratio double, peak_ratio double, crash_ratio double, engagement_rate double, uploads_90d int, days_since int, cv double")
    assert rule_score(good, 10_000, 50_000).first().total == pytest.approx(70.0)
    crashed = rule_score(good.withColumn("crash_ratio", F.lit(0.4)), 10_000, 50_000).first()
    assert (round(crashed.total, 6), crashed.crash) == (67.0, True)


def test_growth_of_a_keyword(spark):
    counts = spark.createDataFrame([(dt.date(2026, 8, 3), "_all", "텐트", 3), (dt.date(2026, 8, 10), "_all", "텐트", 6)], "week date, category string, keyword string, frequency bigint")
    last = growth(counts).orderBy(F.desc("week")).first()
    assert (last.previous, last.growth, last.is_new) == (3, 2.0, False)


def test_times_with_and_without_a_zone(spark):
    texts = {
        "2024-02-29T10:00:00Z": 1709200800,
        "2024-02-29T10:00Z": 1709200800,
        "2024-02-29T10:00:00+09:00": 1709168400,
        "2024-02-29T10:00:00.5": 1709168400,
        "2024-02-29T10:00": 1709168400,
        "2024-02-29": 1709132400,
        "2024-02-30": None,
        "2024-02-29 10:00:00": None,
        "2024-2-9": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", F.unix_seconds(c.parse_time(F.col("t"), "Asia/Seoul")).alias("s")).collect()}
    assert got == texts


def test_sinks_by_mode(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "k string, v int, n int")
    old = spark.createDataFrame([("a", 9, 0), ("c", 7, 0)], "k string, v int, n int")
    assert sorted(tuple(r) for r in upkeep.sink("LIVE")(old, rows, ["k"], ["n"]).collect()) == [("a", 2, 2), ("b", 5, 1), ("c", 7, 0)]
    assert sorted(r.payload for r in upkeep.sink("TEST")(old, rows, ["k"], ["n"]).collect()) == ['{"k":"a","v":2,"n":2}', '{"k":"b","v":5,"n":1}']
    with pytest.raises(ValueError):
        upkeep.sink("DRAFT")


def test_outbox_holds_back_recent_keys(spark):
    sent = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 10)), ("y", dt.datetime(2024, 1, 1, 2)), (None, dt.datetime(2024, 1, 1, 10))], "dedupe_key string, created_at timestamp_ntz")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), (" ", 4), (None, 5), (None, 6)], "dedupe_key string, id int")
    got = upkeep.enqueued(sent, new, dt.datetime(2024, 1, 1, 12), 6, ["id"]).collect()
    assert sorted(r.payload for r in got) == ['{"id":2}', '{"id":4}', '{"id":5}', '{"id":6}']


def test_fields_have_types_and_labels():
    assert len(f.LABELS) == 24 and all(f.field_type(name) for name in f.LABELS)
    assert f.label("unit_cost") == "단가" and f.label("attributes.shelf") == "shelf" and f.label("code") == "code"
    for wrong in ("no such field", "attributes.a'b", 'attributes.a"', "attributes.a`", "attributes.a\\"):
        with pytest.raises(ValueError):
            f.label(wrong)


def test_values_of_the_latest_snapshot_by_source(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [("a", old, "W9", "gone", 99), ("a", new, "W1", None, 5), ("a", new, "W1", "North", 6), ("a", new, "W2", "South", 11), ("a", new, None, None, 1), ("b", old, "W1", "Other", 2)]
    table = spark.createDataFrame(rows, "source string, base_at timestamp_ntz, code string, name string, quantity long")
    all_ = [("a", "", "", 1, 1, False), ("a", "W1", "North", 2, 11, False), ("a", "W2", "South", 1, 11, False), ("b", "W1", "Other", 1, 2, False)]
    assert sorted(tuple(r) for r in latest_values(table, "code", "name").collect()) == all_
    assert sorted((r.source, r.value, r.more) for r in latest_values(table, "code", limit=1).collect()) == [("a", "W1", False), ("a", "W2", True), ("b", "W1", False)]
