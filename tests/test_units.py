"""Edits of units, names by rule, suggestions, reviews and prices: stated cases."""

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.columns import grounded
from lakeloom.operators import names, runs, units
from lakeloom.plans import ledger, reviews
from lakeloom.plans.scoring import all_campaigns, campaign_scores, rule_score

MEMBERS = "unit_id int, source string, item_ref string, confirmed boolean"
UNITS = "unit_id int, name string, active boolean"


@pytest.fixture
def three(spark):
    members = [(1, "erp", "a", True), (1, "wms", "a", True), (1, "erp", "b", False), (2, "erp", "c", False), (3, "wms", "d", True)]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame([(1, "one", True), (2, "two", True), (3, "three", True)], UNITS)


def shown(pair):
    members, of = pair
    return {(r.source, r.item_ref): r.unit_id for r in members.collect()}, {r.unit_id: r.active for r in of.collect()}


def test_split(spark, three):
    groups = spark.createDataFrame([("erp", "a", 10, "left"), ("wms", "a", 11, "right"), ("erp", "nowhere", 12, "none")], "source string, item_ref string, to int, name string")
    items, active = shown(units.split(*three, groups))
    assert items == {("erp", "a"): 10, ("wms", "a"): 11, ("erp", "b"): 1, ("erp", "c"): 2, ("wms", "d"): 3}
    assert active == {1: True, 2: True, 3: True, 10: True, 11: True}
    _, active = shown(units.split(*three, groups.filter("item_ref = 'a'").unionByName(spark.createDataFrame([("erp", "b", 10, "left")], groups.schema))))
    assert active == {1: False, 2: True, 3: True, 10: True, 11: True}


def test_unlink_and_discard(spark, three):
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "unit_id int")
    items, active = shown(units.unlink(*three, of(1, 9)))
    assert set(items) == {("erp", "c"), ("wms", "d")} and active == {1: False, 2: True, 3: True}
    items, active = shown(units.discard_pending(*three, of(1, 2)))
    assert set(items) == {("erp", "a"), ("wms", "a"), ("wms", "d")} and active == {1: True, 2: False, 3: True}


@pytest.mark.parametrize(
    ("rule", "left", "right", "wanted"),
    [
        ("COMMON", ["Camp tent red", "Camp tent blue"], ["x"], "Camp tent"),
        ("COMMON", ["x"], ["Choco bar (27.03)", "Choco bar (27.04)"], "Choco bar"),
        ("COMMON", ["Lamp A"], ["Other"], "Lamp A"),
        ("COMMON", ["", " "], ["y"], ""),
        ("COMMON", ["ab", "xy"], [], "ab"),
        ("COMMON", [" solo ", ""], ["z"], "solo"),
        ("FIRST_ITEM", [], ["r1", "r2"], "r1"),
        ("FIRST_ITEM", ["l1"], ["r1"], "l1"),
        ("MANUAL", ["l1"], ["r1"], ""),
    ],
)
def test_unit_names(spark, rule, left, right, wanted):
    rows = [(1, s, f"{i}", n) for s, of in (("erp", left), ("wms", right)) for i, n in enumerate(of)]
    assert [r.name for r in units.unit_names(spark.createDataFrame(rows, "unit_id int, source string, item_ref string, name string"), rule, "erp").collect()] == [wanted]


def test_an_unknown_name_rule(spark):
    with pytest.raises(ValueError):
        units.unit_names(spark.createDataFrame([], "unit_id int, source string, item_ref string, name string"), "LONGEST", "erp")


FIELDS, TARGETS, HISTORY = "field string, kind string, place int", "target string, kind string, aliases string, place int", "field string, target string, hits long"


def suggest(spark, fields, targets, history=()):
    found = units.suggested(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(targets, TARGETS), spark.createDataFrame(list(history), HISTORY))
    return sorted((r.target, r.field, r.score, r.why) for r in found.collect())


def test_suggestions_by_source_of_points(spark):
    targets = [("quantity", "INTEGER", "qty|stock", 1), ("name", "STRING", None, 2), ("maker", "STRING", "", 3)]
    assert suggest(spark, [("Q T Y", "STRING", 1)], targets) == [("quantity", "Q T Y", 100, "alias")]
    assert suggest(spark, [("item_name", "STRING", 1)], targets) == [("name", "item_name", 100, "name,kind")]
    assert suggest(spark, [("item_name", "INTEGER", 1)], targets) == []
    assert suggest(spark, [("odd", "STRING", 1)], targets, [("odd", "maker", 1)]) == [("maker", "odd", 110, "history,kind")]
    assert suggest(spark, [("odd", "DATE", 1)], targets, [("odd", "maker", 1)]) == []
    assert suggest(spark, [("odd", "DATE", 1)], targets, [("odd", "maker", 2)]) == [("maker", "odd", 80, "history")]
    assert suggest(spark, [("odd", "DATE", 1)], targets, [("odd", "maker", 50), ("odd", "gone", 90)]) == [("maker", "odd", 95, "history")]


def test_a_target_takes_the_better_field_and_ties_go_by_place(spark):
    targets = [("b", "X", "k1|k2", 2), ("a", "X", "k2|k1", 1)]
    assert suggest(spark, [("k1", "X", 2), ("k2", "X", 1)], targets) == [("a", "k2", 140, "alias,kind")]
    assert suggest(spark, [("k1", "Y", 1), ("k2", "X", 2)], [("t", "X", "k1|k2", 1)]) == [("t", "k2", 140, "alias,kind")]


SCORES = "channel_id int, rule_total double, ai_total double, hash string, grade string"


def test_a_review_of_the_same_input_is_skipped(spark):
    review = spark.createDataFrame([(1, 20.005, ["b", "a"]), (2, 30.0, ["x"])], "channel_id int, points double, materials array<string>")
    first = reviews.apply_reviews(spark.createDataFrame([(1, 50.0, None, None, "C"), (2, 56.0, 1.0, "old", "B"), (3, 40.0, None, None, "C")], SCORES), review)
    got = {r.channel_id: (r.ai_total, r.total, r.grade, r.applied) for r in first.collect()}
    assert got == {1: (20.01, 70.01, "A", True), 2: (30.0, 86.0, "S", True), 3: (None, 40.0, "C", False)}
    other = review.withColumn("points", F.lit(1.0)).withColumn("materials", F.reverse("materials"))
    again = reviews.apply_reviews(first.select("channel_id", "rule_total", "ai_total", "hash", "grade"), other)
    assert {r.channel_id: (r.ai_total, r.total, r.grade, r.applied) for r in again.collect()} == {i: (*v[:3], False) for i, v in got.items()}


def test_a_quoted_price_goes_before_the_estimate(spark):
    rows = spark.createDataFrame([(1, 80.0, 1000, 2.0, 500, None), (2, 90.0, 1000, 2.0, 400, 333), (3, 70.0, 1000, 0.5, 0, 50), (4, 60.0, 10, None, 5, None)], "channel_id int, total double, price int, cpv double, median_views int, quoted int")
    got = [(r.channel_id, r.price, r.estimated, r.cpv) for r in reviews.priced(rows).collect()]
    assert got == [(2, 333, False, 0.83), (1, 1000, True, 2.0), (3, 50, False, 0.5), (4, 10, True, None)]
    assert [r.channel_id for r in reviews.priced(rows, "cpv").collect()] == [3, 2, 1, 4]
    with pytest.raises(ValueError):
        reviews.priced(rows, "name")


def test_full_scores_agree_with_those_of_one_campaign(spark, sf_dir):
    from lakeloom.plans import scoring

    m = scoring._metrics(spark, sf_dir)
    campaigns = spark.createDataFrame([(f"c{i}", 1000 * i + 1, 5000 * i + 9, 700 * i) for i in range(7)], "campaign string, reach_min int, reach_max int, subscriber_min int")
    found = {(r.campaign, r.channel_id): (round(r.total, 6), r.grade, r.reason) for r in all_campaigns(m, campaigns).collect()}
    assert len(found) == 7 * m.count()
    for c in campaigns.collect():
        alone = scoring.hard_filter(rule_score(m, c.reach_min, c.reach_max), c.subscriber_min)
        for r in alone.collect():
            assert found[(c.campaign, r.channel_id)] == (round(r.total, 6), r.grade, r.reason)
    assert campaign_scores(m, campaigns).count() == m.join(campaigns, m["subscribers"] >= campaigns["subscriber_min"]).count()


def test_many_campaigns_are_dealt_into_rows(spark, sf_dir, monkeypatch):
    from lakeloom.plans import scoring

    monkeypatch.setattr(scoring, "CAMPAIGNS", 3)
    m = scoring._metrics(spark, sf_dir)
    campaigns = spark.range(20).select(F.concat(F.lit("c"), "id").alias("campaign"), F.lit(1).alias("reach_min"), F.lit(9).alias("reach_max"), F.lit(0).alias("subscriber_min"))
    assert all_campaigns(m, campaigns).select("campaign", "channel_id").distinct().count() == 20 * m.count()


def test_effect_of_rules(spark):
    rows = [("a", "Tent (1)"), ("b", "tent"), ("b", "Lamp"), ("c", "Lamp"), ("c", "lamp (x)"), ("c", "TENT")]
    got = {(r.left, r.right): (r.before, r.after, r.largest) for r in names.rule_effect(spark.createDataFrame(rows, "source string, raw_name string")).collect()}
    assert got == {("a", "b"): (0, 1, False), ("a", "c"): (0, 1, False), ("b", "c"): (2, 2, True)}  # without rules, white space and case still count for nothing


def test_insight_and_preview_of_rules(spark):
    rows = spark.createDataFrame([("a", "Tent (1)"), ("a", "Tent (2)"), ("b", "tent"), ("b", "Lamp"), ("b", ""), ("b", None), ("b", "Lamp")], "source string, raw_name string")
    rules = {"brackets": (r"\([^)]*\)", ""), "idle": ("zzz", ""), "broken": ("(", "")}
    assert tuple(names.rule_insight(rows, rules).first()) == (4, 0, 1, 1, 1, "broken,idle")
    assert tuple(names.rule_insight(rows.limit(0), rules).first()) == (0, 0, 0, 0, 0, "brackets,broken,idle")
    placed = [(20, "1", "one"), (10, r"\(", "")]
    got = {r.raw_name: (r.now, r.then) for r in names.rule_preview(rows.filter("source = 'a'"), placed, (15, "[0-9]", "#")).collect()}
    assert got == {"Tent (1)": ("tentone)", "tent#)"), "Tent (2)": ("tent2)", "tent#)")}
    assert {r.then for r in names.rule_preview(rows, placed).collect()} == {None}


def test_quotes_in_full_width_signs(spark):
    row = spark.range(1).select(grounded(F.lit("ＧＯＯＤ　ｔｅｎｔ！"), F.lit("a very good tent! indeed")).alias("x"), grounded(F.lit("good cup"), F.lit("good tent")).alias("y")).first()
    assert row.x and not row.y


def test_error_groups_show_the_first_row(spark):
    bad = spark.createDataFrame([(3, "TYPE", "q", "m3"), (2, "TYPE", "q", "m2"), (5, "REQUIRED", "q", "m5")], "row_number long, code string, field string, message string")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_number long, qty string")
    assert sorted(map(tuple, runs.error_groups(bad, rows).collect())) == [("REQUIRED", "q", 1, 5, "m5", '{"qty":"t5"}'), ("TYPE", "q", 2, 2, "m2", '{"qty":"t2"}')]


def test_quiet_hours_put_a_time_off():
    import datetime as dt

    at = lambda h, m=0, d=2: dt.datetime(2024, 1, d, h, m)
    night = (23 * 60, 7 * 60)
    assert ledger.after_quiet(at(13, 59), night) == at(13, 59)
    assert ledger.after_quiet(at(14), night) == at(22)  # 23:00 in Seoul is 14:00 UTC
    assert ledger.after_quiet(at(21, 59), night) == at(22)
    assert ledger.after_quiet(at(22), night) == at(22)
    assert ledger.after_quiet(at(3), (12 * 60, 13 * 60)) == at(4)
    assert ledger.after_quiet(at(3), None) == at(3)
