"""Channel scoring: measures over a channel's latest videos, points, grades, price and rising index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import curve, grade, ratio, reach_points, whole_days
from lakeloom.sources.domain import view, with_views

Curve = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class Rubric:
    """The default scoring settings."""

    shorts_seconds: int = 60
    window: int = 50
    enough: int = 20
    comment_weight: int = 3
    max_days: int = 90
    min_videos: int = 5
    reach: float = 14.0
    vsr: Curve = ((0.0, 0.0), (0.08, 2.0), (0.15, 5.0), (0.3, 9.0), (0.5, 14.0))
    trend: Curve = ((0.0, 0.0), (0.7, 1.5), (0.9, 3.0), (1.2, 4.5), (1.5, 6.0))
    peak: Curve = ((0.0, 0.0), (0.3, 1.0), (0.5, 2.5), (0.8, 4.0), (1.0, 5.0))
    crash_below: float = 0.5
    crash: Curve = ((0.5, 0.0), (0.8, 3.0))
    engagement: Curve = ((0.0, 0.0), (0.015, 2.5), (0.03, 5.0), (0.05, 8.5), (0.08, 12.0))
    uploads_points: float = 5.0
    uploads_target: int = 12
    recency: Curve = ((0.0, 3.0), (7.0, 3.0), (14.0, 2.25), (30.0, 1.5), (60.0, 0.75), (90.0, 0.0))
    stability: Curve = ((0.0, 8.0), (0.4, 8.0), (0.8, 5.0), (1.5, 2.0), (3.0, 0.0))
    heat: Curve = ((1.0, 0.0), (1.5, 30.0))
    accel: Curve = ((1.0, 0.0), (2.0, 25.0))
    velocity: Curve = ((1.0, 0.0), (3.0, 20.0))
    burst: Curve = ((1.0, 0.0), (2.0, 15.0))
    untapped_points: float = 10.0
    untapped_paid: float = 0.05
    untapped_subscribers: int = 100_000
    rising_from: float = 70.0
    coefficient: float = 25.0
    coefficients: dict[str, float] = field(default_factory=dict)
    grades: tuple[float, float, float, float] = (85, 70, 55, 40)


def latest_videos(videos: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Each channel's latest long videos, numbered from 0 (the newest).

    A row number of at most `window` lets Spark keep only so many rows of a channel on the map
    side before the shuffle (a window group limit), so a channel with very many videos is no hot key.
    """
    w = Window.partitionBy("channel_id").orderBy(F.desc("published_at"), F.desc("video_id"))
    long = videos.filter(F.col("duration_seconds") > rubric.shorts_seconds)
    numbered = long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rubric.window)
    return numbered.withColumn("rank", F.col("rank") - 1)


def metrics(channels: DataFrame, videos: DataFrame, now: dt.datetime, rubric: Rubric = Rubric()) -> DataFrame:
    """The thirteen measures of every channel; a channel without long videos has the neutral ones."""
    at = F.lit(now).cast("timestamp_ntz")
    v = F.col("views").cast("double")
    rank = F.col("rank")
    days = F.greatest(whole_days(F.col("published_at"), at), F.lit(1))
    middle = lambda value, low=0, high=10**6: F.percentile(F.when((rank >= low) & (rank < high), value), 0.5)
    share = lambda x: F.when(v > 0, x / F.when(v > 0, v))
    frame = Window.partitionBy("channel_id").orderBy("rank").rowsBetween(0, 4)
    rows = latest_videos(videos, rubric).withColumn("five", F.when(F.count(F.lit(1)).over(frame) == 5, F.percentile(v, 0.5).over(frame)))
    sums = rows.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_videos"),
        middle(v).alias("median_views"),
        F.percentile(v, 0.25).alias("q1"),
        F.percentile(v, 0.75).alias("q3"),
        middle(share(F.col("likes") + rubric.comment_weight * F.col("comments"))).alias("er"),
        middle(v, 0, 10).alias("v10"), middle(v, 10, 20).alias("v20"), middle(v, 0, 5).alias("v5"), middle(v, 5, 20).alias("v15"),
        F.max("five").alias("best5"),
        F.count(F.when(whole_days(F.col("published_at"), at) <= 90, 1)).alias("uploads_90d"),
        F.min(whole_days(F.col("published_at"), at)).alias("days_since"),
        F.avg(F.col("paid").cast("double")).alias("paid_ratio"),
        middle(v / days, 0, 5).alias("s5"), middle(v / days, 5, 20).alias("s15"),
        middle(share(F.col("comments")), 0, 5).alias("c5"), middle(share(F.col("comments"))).alias("c_all"),
    )
    enough = F.col("n_videos") >= rubric.enough
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    when = lambda a, b: F.when(enough, ratio(zero(F.col(a)), zero(F.col(b)))).otherwise(1.0)
    joined = channels.join(sums, "channel_id", "left")
    median = zero(F.col("median_views"))
    return joined.select(
        *channels.columns,
        F.coalesce("n_videos", F.lit(0)).alias("n_videos"),
        median.alias("median_views"),
        F.when(F.col("subscribers") > 0, median / F.col("subscribers")).otherwise(0.0).alias("vsr"),
        zero(F.col("er")).alias("engagement_rate"),
        F.when(median > 0, (F.col("q3") - F.col("q1")) / F.when(median > 0, median)).otherwise(0.0).alias("cv"),
        when("v10", "v20").alias("trend_ratio"),
        when("v5", "best5").alias("peak_ratio"),
        when("v5", "v15").alias("crash_ratio"),
        F.coalesce("uploads_90d", F.lit(0)).alias("uploads_90d"),
        F.coalesce("days_since", F.lit(2**63 - 1)).alias("days_since"),
        zero(F.col("paid_ratio")).alias("paid_ratio"),
        when("s5", "s15").alias("velocity_ratio"),
        when("c5", "c_all").alias("burst_ratio"),
    )


def rule_score(m: DataFrame, reach_min: float, reach_max: float, rubric: Rubric = Rubric()) -> DataFrame:
    """Points by rule (70 at most) and the CRASH badge."""
    crashed = F.col("crash_ratio") < rubric.crash_below
    momentum = curve(F.col("trend_ratio"), rubric.trend) + curve(F.col("peak_ratio"), rubric.peak) + F.when(crashed, 0.0).otherwise(curve(F.col("crash_ratio"), rubric.crash))
    activity = rubric.uploads_points * F.least(F.lit(1.0), F.col("uploads_90d") / rubric.uploads_target) + curve(F.col("days_since").cast("double"), rubric.recency)
    parts = {
        "reach": reach_points(F.col("median_views"), reach_min, reach_max, rubric.reach), "vsr_points": curve(F.col("vsr"), rubric.vsr), "momentum": momentum,
        "engagement": curve(F.col("engagement_rate"), rubric.engagement), "activity": activity, "stability": curve(F.col("cv"), rubric.stability),
    }
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    return m.withColumns(parts).withColumn("total", total).withColumns({"grade": grade(F.col("total"), *rubric.grades), "crash": crashed})


def rising_index(m: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Points of a channel that grows faster than its audience (100 at most), and whether that makes a badge."""
    untapped = F.when((F.col("paid_ratio") <= rubric.untapped_paid) & (F.col("subscribers") < rubric.untapped_subscribers), rubric.untapped_points).otherwise(0.0)
    total = curve(F.col("vsr"), rubric.heat) + curve(F.col("trend_ratio"), rubric.accel) + curve(F.col("velocity_ratio"), rubric.velocity) + curve(F.col("burst_ratio"), rubric.burst) + untapped
    return m.withColumn("rising", total).withColumn("badge", F.col("rising") >= rubric.rising_from)


def hard_filter(m: DataFrame, subscriber_min: int | Column, rubric: Rubric = Rubric()) -> DataFrame:
    """The first reason for which a channel is no candidate; null if there is none."""
    reason = F.when(F.col("excluded"), "MANUALLY_EXCLUDED").when(F.col("days_since") > rubric.max_days, "INACTIVE").when(F.col("n_videos") < rubric.min_videos, "INSUFFICIENT_VIDEOS").when(F.col("subscribers") < subscriber_min, "BELOW_SUBSCRIBER_MIN")
    return m.withColumn("reason", reason)


def cost_per_view(m: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Estimated price from subscribers and category, and price for a view of the median video."""
    factor = F.lit(rubric.coefficient)
    for category, value in rubric.coefficients.items():
        factor = F.when(F.col("category") == category, value).otherwise(factor)
    price = F.round(F.col("subscribers") * factor).cast("bigint")
    return m.withColumn("price", price).withColumn("cpv", F.when(F.col("median_views") > 0, F.col("price") / F.when(F.col("median_views") > 0, F.col("median_views"))).otherwise(0.0))


def campaign_scores(m: DataFrame, campaigns: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Totals of all channels in all campaigns: the campaigns are a short list inside each channel's row."""
    listed = campaigns.agg(F.collect_list(F.struct("campaign", "reach_min", "reach_max", "subscriber_min")).alias("c"))
    both = m.withColumn("k", F.lit(1)).join(F.broadcast(listed.withColumn("k", F.lit(1))), "k").drop("k").select(*m.columns, F.explode("c").alias("c")).select(*m.columns, "c.*")
    reach = reach_points(F.col("median_views"), F.col("reach_min"), F.col("reach_max"), rubric.reach)
    fits = F.col("subscribers") >= F.col("subscriber_min")
    return both.filter(fits).select("campaign", "channel_id", reach.alias("reach"))


#: Campaigns that one row of the spread list holds.
CAMPAIGNS = 500
_RULE = ("reach", "vsr_points", "momentum", "engagement", "activity", "stability")
_RISING = {"heat": "vsr", "accel": "trend_ratio", "velocity": "velocity_ratio", "burst": "burst_ratio"}


def all_campaigns(m: DataFrame, campaigns: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """Score of every channel in every campaign: points, grade, badges, price, the first reason against it, and the points as JSON.

    A channel that fails keeps its row, as the reason is what people ask for. What does not depend on the campaign is worked
    out once for each channel. Campaigns are dealt into rows of about `CAMPAIGNS`; a channel has a row for each
    of these, meets it by its number and spreads it, so no side is gathered whole, and neither is all compared with all before
    the result, which has a row for each pair.
    """
    rising = rising_index(m, rubric)
    once = cost_per_view(rule_score(rising, 1, 1, rubric).drop("reach", "total", "grade"), rubric)
    number = max(1, -(-campaigns.count() // CAMPAIGNS))
    part = F.pmod(F.xxhash64("campaign"), F.lit(number)).cast("int")
    listed = campaigns.groupBy(part.alias("__part")).agg(F.collect_list(F.struct("campaign", "reach_min", "reach_max", "subscriber_min")).alias("__c"))
    dealt = once.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    pairs = dealt.join(listed, "__part").withColumn("__c", F.explode("__c")).select(*once.columns, "__c.*")
    scored = pairs.withColumn("reach", reach_points(F.col("median_views"), F.col("reach_min"), F.col("reach_max"), rubric.reach))
    scored = scored.withColumn("total", sum((F.col(p) for p in _RULE), F.lit(0.0)))
    failed = hard_filter(scored.withColumn("grade", grade(F.col("total"), *rubric.grades)), F.col("subscriber_min"), rubric)
    parts = F.struct(*[F.round(p, 6).alias(p) for p in _RULE])
    rise = F.struct(*[F.round(curve(F.col(c), getattr(rubric, n)), 6).alias(n) for n, c in _RISING.items()])
    breakdown = F.to_json(F.struct(parts.alias("rule"), F.struct(F.round("rising", 6).alias("total"), rise.alias("breakdown")).alias("rising")))
    badges = F.array_join(F.array_compact(F.array(F.when(F.col("crash"), "CRASH"), F.when(F.col("badge"), "RISING"))), ",")
    return failed.select("campaign", "channel_id", "total", "grade", badges.alias("badges"), "price", "cpv", "reason", breakdown.alias("breakdown"))


def top_scores(scored: DataFrame, n: int = 10, by: str = "total") -> DataFrame:
    """The best channels by total, or the cheapest by price for a view; failed ones left out."""
    order = [F.desc("total"), "channel_id"] if by == "total" else ["cpv", "channel_id"]
    return scored.filter("reason is null").orderBy(*order).limit(n)


NOW = dt.datetime(2024, 2, 5)


def _metrics(spark, sf_dir) -> DataFrame:
    return metrics(view(spark, sf_dir, "channel"), view(spark, sf_dir, "video"), NOW)


_RATIOS = ("vsr", "engagement_rate", "cv", "trend_ratio", "peak_ratio", "crash_ratio", "paid_ratio", "velocity_ratio", "burst_ratio")


def _rounded(df: DataFrame, *columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def _scored(spark, sf_dir) -> DataFrame:
    return cost_per_view(hard_filter(rule_score(_metrics(spark, sf_dir), 20_000, 60_000), 20_000))


_POINTS = ("reach", "vsr_points", "momentum", "engagement", "activity", "stability", "total")
_RUBRIC = Rubric()


def _sql_curve(x: str, points: Curve) -> str:
    steps = " ".join(f"WHEN {x} <= {x1} THEN {y0} + ({y1} - {y0}) * ({x} - {x0}) / ({x1} - {x0})" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
    return f"(CASE WHEN {x} <= {points[0][0]} THEN CAST({points[0][1]} AS DOUBLE) {steps} ELSE {points[-1][1]} END)"


def _days(c: str) -> str:
    return f"CAST(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch({c}))) / 86400) AS BIGINT)"


def _part(value: str, low: int = 0, high: int = 10**6) -> str:
    return f"coalesce(quantile_cont({value}, 0.5) FILTER (WHERE r >= {low} AND r < {high}), 0)"


_SHARE = "CASE WHEN v > 0 THEN {0} / v END"
_SPEED = f"v / greatest(1, {_days('published_at')})"
_SQL_METRICS = f"""{with_views('video', 'channel')}, l AS (SELECT *, CAST(views AS DOUBLE) AS v, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id DESC) - 1 AS r FROM video WHERE duration_seconds > 60 QUALIFY r < 50),
    f AS (SELECT channel_id, max(m) AS best5 FROM (SELECT channel_id, quantile_cont(v, 0.5) OVER w AS m, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY channel_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 GROUP BY channel_id),
    a AS (SELECT channel_id, count(*) AS n_videos, quantile_cont(v, 0.5) AS median_views, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, {_part(_SHARE.format('(likes + 3 * comments)'))} AS er,
      {_part('v', 0, 10)} AS v10, {_part('v', 10, 20)} AS v20, {_part('v', 0, 5)} AS v5, {_part('v', 5, 20)} AS v15, count(*) FILTER (WHERE {_days('published_at')} <= 90) AS uploads_90d, min({_days('published_at')}) AS days_since,
      avg(CAST(paid AS INTEGER)) AS paid_ratio, {_part(_SPEED, 0, 5)} AS s5, {_part(_SPEED, 5, 20)} AS s15, {_part(_SHARE.format('comments'), 0, 5)} AS c5, {_part(_SHARE.format('comments'))} AS c_all FROM l GROUP BY channel_id),
    m AS (SELECT channel.*, coalesce(n_videos, 0) AS n_videos, coalesce(median_views, 0.0) AS median_views, coalesce(median_views, 0.0) / subscribers AS vsr, coalesce(er, 0.0) AS engagement_rate, CASE WHEN median_views > 0 THEN (q3 - q1) / median_views ELSE 0.0 END AS cv,
      {', '.join(f"CASE WHEN n_videos >= 20 AND {b} > 0 THEN {a} / {b} ELSE 1.0 END AS {n}" for n, a, b in (('trend_ratio', 'v10', 'v20'), ('peak_ratio', 'v5', 'best5'), ('crash_ratio', 'v5', 'v15'), ('velocity_ratio', 's5', 's15'), ('burst_ratio', 'c5', 'c_all')))},
      coalesce(uploads_90d, 0) AS uploads_90d, coalesce(days_since, 9223372036854775807) AS days_since, coalesce(paid_ratio, 0.0) AS paid_ratio FROM channel LEFT JOIN a USING (channel_id) LEFT JOIN f USING (channel_id))"""
_REACH = "(CASE WHEN median_views <= 0 THEN 0.0 ELSE 14.0 * greatest(0.0, 1 + log10(CASE WHEN median_views < {0} THEN median_views / {0} WHEN median_views > {1} THEN {1} / median_views ELSE 1.0 END)) END)"
_R = _RUBRIC
_SQL_SCORED = f"""{_SQL_METRICS}, p AS (SELECT *, {_REACH.format(20000, 60000)} AS reach, {_sql_curve('vsr', _R.vsr)} AS vsr_points,
      {_sql_curve('trend_ratio', _R.trend)} + {_sql_curve('peak_ratio', _R.peak)} + CASE WHEN crash_ratio < 0.5 THEN 0.0 ELSE {_sql_curve('crash_ratio', _R.crash)} END AS momentum, {_sql_curve('engagement_rate', _R.engagement)} AS engagement,
      5.0 * least(1.0, uploads_90d / 12) + {_sql_curve('CAST(days_since AS DOUBLE)', _R.recency)} AS activity, {_sql_curve('cv', _R.stability)} AS stability, crash_ratio < 0.5 AS crash FROM m),
    t AS (SELECT *, reach + vsr_points + momentum + engagement + activity + stability AS total, CASE WHEN excluded THEN 'MANUALLY_EXCLUDED' WHEN days_since > 90 THEN 'INACTIVE' WHEN n_videos < 5 THEN 'INSUFFICIENT_VIDEOS' WHEN subscribers < 20000 THEN 'BELOW_SUBSCRIBER_MIN' END AS reason,
      CAST(subscribers * 25 AS BIGINT) AS price, CASE WHEN median_views > 0 THEN subscribers * 25 / median_views ELSE 0.0 END AS cpv FROM p)"""


def _campaigns(spark) -> DataFrame:
    return spark.createDataFrame([("spring", 10_000, 50_000, 5_000), ("summer", 40_000, 90_000, 60_000), ("wide", 1_000, 900_000, 0)], "campaign string, reach_min int, reach_max int, subscriber_min int")


_JSON = {"json_reach": "rule.reach", "json_activity": "rule.activity", "json_rising": "rising.total", "json_heat": "rising.breakdown.heat"}

QUERIES = {
    "latest_n_videos": lambda s, d: latest_videos(view(s, d, "video")).select("channel_id", "video_id", F.col("rank").cast("bigint").alias("rank")),
    "channel_metrics": lambda s, d: (m := _metrics(s, d)).select("channel_id", "n_videos", "median_views", "uploads_90d", "days_since", *_rounded(m, *_RATIOS)),
    "rule_score": lambda s, d: (m := _scored(s, d)).select("channel_id", *_rounded(m, *_POINTS), "grade", "crash"),
    "rising_index": lambda s, d: (m := rising_index(_metrics(s, d))).select("channel_id", *_rounded(m, "rising"), "badge"),
    "hard_filter": lambda s, d: _scored(s, d).select("channel_id", "reason"),
    "grade_cpv": lambda s, d: (m := _scored(s, d)).select("channel_id", "price", *_rounded(m, "cpv"), "grade"),
    "top_scores": lambda s, d: (m := top_scores(_scored(s, d), 15)).select("channel_id", *_rounded(m, "total")),
    "cheapest_views": lambda s, d: (m := top_scores(_scored(s, d).filter("cpv > 0"), 15, "cpv")).select("channel_id", *_rounded(m, "cpv")),
    "campaign_full_scores": lambda s, d: (m := all_campaigns(_metrics(s, d), _campaigns(s))).select("campaign", "channel_id", *_rounded(m, "total", "cpv"), "grade", "badges", "price", "reason", *[F.get_json_object("breakdown", f"$.{p}").cast("double").alias(n) for n, p in _JSON.items()]),
    "campaign_scores": lambda s, d: (m := campaign_scores(_metrics(s, d), _campaigns(s))).select("campaign", "channel_id", *_rounded(m, "reach")),
}

_SQL_FULL = f"""{_SQL_METRICS}, c(campaign, low, high, least) AS (VALUES ('spring', 10000, 50000, 5000), ('summer', 40000, 90000, 60000), ('wide', 1000, 900000, 0)),
    p AS (SELECT *, {_REACH.format('low', 'high')} AS reach, {_sql_curve('vsr', _R.vsr)} AS vsr_points, {_sql_curve('vsr', _R.heat)} AS heat,
      {_sql_curve('trend_ratio', _R.trend)} + {_sql_curve('peak_ratio', _R.peak)} + CASE WHEN crash_ratio < 0.5 THEN 0.0 ELSE {_sql_curve('crash_ratio', _R.crash)} END AS momentum, {_sql_curve('engagement_rate', _R.engagement)} AS engagement,
      5.0 * least(1.0, uploads_90d / 12) + {_sql_curve('CAST(days_since AS DOUBLE)', _R.recency)} AS activity, {_sql_curve('cv', _R.stability)} AS stability, crash_ratio < 0.5 AS crash,
      {_sql_curve('vsr', _R.heat)} + {_sql_curve('trend_ratio', _R.accel)} + {_sql_curve('velocity_ratio', _R.velocity)} + {_sql_curve('burst_ratio', _R.burst)} + CASE WHEN paid_ratio <= 0.05 AND subscribers < 100000 THEN 10.0 ELSE 0.0 END AS rising FROM m, c),
    t AS (SELECT *, reach + vsr_points + momentum + engagement + activity + stability AS total, CASE WHEN excluded THEN 'MANUALLY_EXCLUDED' WHEN days_since > 90 THEN 'INACTIVE' WHEN n_videos < 5 THEN 'INSUFFICIENT_VIDEOS' WHEN subscribers < least THEN 'BELOW_SUBSCRIBER_MIN' END AS reason,
      CAST(subscribers * 25 AS BIGINT) AS price, CASE WHEN median_views > 0 THEN subscribers * 25 / median_views ELSE 0.0 END AS cpv FROM p)"""
_round = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
SQL = {
    "latest_n_videos": f"{_SQL_METRICS} SELECT channel_id, video_id, r AS rank FROM l",
    "channel_metrics": f"{_SQL_METRICS} SELECT channel_id, n_videos, median_views, uploads_90d, days_since, {_round(*_RATIOS)} FROM m",
    "rule_score": f"{_SQL_SCORED} SELECT channel_id, {_round(*_POINTS)}, CASE WHEN total >= 85 THEN 'S' WHEN total >= 70 THEN 'A' WHEN total >= 55 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS grade, crash FROM t",
    "rising_index": f"{_SQL_METRICS}, x AS (SELECT channel_id, {_sql_curve('vsr', _R.heat)} + {_sql_curve('trend_ratio', _R.accel)} + {_sql_curve('velocity_ratio', _R.velocity)} + {_sql_curve('burst_ratio', _R.burst)} + CASE WHEN paid_ratio <= 0.05 AND subscribers < 100000 THEN 10.0 ELSE 0.0 END AS rising FROM m) SELECT channel_id, {_round('rising')}, rising >= 70 AS badge FROM x",
    "hard_filter": f"{_SQL_SCORED} SELECT channel_id, reason FROM t",
    "grade_cpv": f"{_SQL_SCORED} SELECT channel_id, price, {_round('cpv')}, CASE WHEN total >= 85 THEN 'S' WHEN total >= 70 THEN 'A' WHEN total >= 55 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS grade FROM t",
    "top_scores": f"{_SQL_SCORED} SELECT channel_id, {_round('total')} FROM t WHERE reason IS NULL ORDER BY t.total DESC, channel_id LIMIT 15",
    "cheapest_views": f"{_SQL_SCORED} SELECT channel_id, {_round('cpv')} FROM t WHERE reason IS NULL AND cpv > 0 ORDER BY t.cpv, channel_id LIMIT 15",
    "campaign_full_scores": f"""{_SQL_FULL} SELECT campaign, channel_id, {_round('total', 'cpv')}, CASE WHEN total >= 85 THEN 'S' WHEN total >= 70 THEN 'A' WHEN total >= 55 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS grade,
        concat_ws(',', CASE WHEN crash THEN 'CRASH' END, CASE WHEN rising >= 70 THEN 'RISING' END) AS badges, price, reason, round(reach, 6) AS json_reach, round(activity, 6) AS json_activity, round(rising, 6) AS json_rising, round(heat, 6) AS json_heat FROM t""",
    "campaign_scores": f"{_SQL_METRICS} SELECT campaign, channel_id, round(CASE campaign WHEN 'spring' THEN {_REACH.format(10000, 50000)} WHEN 'summer' THEN {_REACH.format(40000, 90000)} ELSE {_REACH.format(1000, 900000)} END, 6) AS reach FROM m, (VALUES ('spring', 5000), ('summer', 60000), ('wide', 0)) AS c(campaign, least) WHERE subscribers >= least",
}
