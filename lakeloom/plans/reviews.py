"""Channel reviews: typed records from JSON, evidence checked against the sources, decisions, and the grade table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import grade, grounded, input_hash
from lakeloom.plans import scoring
from lakeloom.sources.domain import view, with_views

_EVIDENCE = "array<struct<source:string,quote:string>>"
_ITEM = f"struct<score:double,reasons:array<string>,evidence:{_EVIDENCE}>"
REVIEW = f"struct<risks:array<struct<claim:string,basis:string,evidence:{_EVIDENCE},severity:string>>,brandSafety:{_ITEM},campaignFit:{_ITEM},audienceQuality:{_ITEM},verdict:struct<headline:string,recommend:string,conditions:array<string>>,confidence:string>"

#: Full points of the three items, and the share of them that an item without evidence gets.
POINTS = {"brandSafety": 10.0, "campaignFit": 12.0, "audienceQuality": 8.0}
NEUTRAL = 0.6


def _word(c: Column, default: str) -> Column:
    return F.upper(F.coalesce(c, F.lit(default)))


def typed_reviews(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Review bodies as records: absent lists are empty, absent numbers 0, absent words their defaults, words in upper case."""
    r = F.from_json(column, REVIEW)
    evidence = lambda c: F.transform(F.coalesce(c, F.array().cast(_EVIDENCE)), lambda e: F.struct(_word(e["source"], "comment").alias("source"), F.coalesce(e["quote"], F.lit("")).alias("quote")))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    item = lambda n: F.struct(F.coalesce(r[n]["score"], F.lit(0.0)).alias("score"), texts(r[n]["reasons"]).alias("reasons"), evidence(r[n]["evidence"]).alias("evidence")).alias(n)
    one = lambda x: F.struct(F.coalesce(x["claim"], F.lit("")).alias("claim"), _word(x["basis"], "inferred").alias("basis"), evidence(x["evidence"]).alias("evidence"), _word(x["severity"], "low").alias("severity"))
    risks = F.coalesce(F.transform(r["risks"], one), F.transform(F.array().cast("array<struct<claim:string,basis:string,evidence:" + _EVIDENCE + ",severity:string>>"), one))
    verdict = F.struct(F.coalesce(r["verdict"]["headline"], F.lit("")).alias("headline"), _word(r["verdict"]["recommend"], "hold").alias("recommend"), texts(r["verdict"]["conditions"]).alias("conditions"))
    return bodies.select(*[c for c in bodies.columns if c != column], risks.alias("risks"), *[item(n) for n in POINTS], verdict.alias("verdict"), _word(r["confidence"], "medium").alias("confidence"))


def checked_reviews(reviews: DataFrame, sources: tuple[Column, ...], has_transcript: Column) -> DataFrame:
    """Reviews with only the evidence that stands in the sources.

    Risks without evidence go; an item without evidence gets a neutral score, others are held between 0
    and full points; a conditional verdict without conditions is HOLD; high confidence needs a
    transcript; a high risk beside full points for safety makes it LOW.
    """
    kept = lambda c: F.filter(c, lambda e: grounded(e["quote"], *sources))
    risks = F.filter(F.transform("risks", lambda r: r.withField("evidence", kept(r["evidence"]))), lambda r: F.size(r["evidence"]) > 0)
    item = lambda n: F.struct(F.when(F.size(kept(F.col(n)["evidence"])) == 0, NEUTRAL * POINTS[n]).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(POINTS[n]), F.col(n)["score"]))).alias("score"), (F.size(kept(F.col(n)["evidence"])) == 0).alias("unverified"))
    checked = reviews.withColumns({"risks": risks, **{n: item(n) for n in POINTS}})
    bare = (F.col("verdict.recommend") == "CONDITIONAL") & (F.size("verdict.conditions") == 0)
    sure = F.when((F.col("confidence") == "HIGH") & ~has_transcript, "MEDIUM").otherwise(F.col("confidence"))
    clash = F.exists("risks", lambda r: r["severity"] == "HIGH") & (F.col("brandSafety.score") >= POINTS["brandSafety"])
    return checked.withColumns({"recommend": F.when(bare, "HOLD").otherwise(F.col("verdict.recommend")), "confidence": F.when(clash, "LOW").otherwise(sure)})


def whole_medians(videos: DataFrame, newest: int = 50, shorts: int = 60) -> DataFrame:
    """Median views of each channel's newest long videos; of two middle ones the mean, rounded down."""
    w = Window.partitionBy("channel_id").orderBy(F.desc("published_at"), F.desc("video_id"))
    latest = videos.filter(F.col("duration_seconds") > shorts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= newest)
    return latest.groupBy("channel_id").agg(F.floor(F.percentile("views", 0.5)).alias("median_views"))


def grade_table(top: DataFrame, decisions: DataFrame, medians: DataFrame) -> DataFrame:
    """The best channels with people's decisions and whole medians (0 without long videos)."""
    return top.join(decisions, "channel_id", "left").join(medians, "channel_id", "left").withColumn("median_views", F.coalesce("median_views", F.lit(0).cast("bigint")))


def apply_reviews(scores: DataFrame, reviews: DataFrame, rubric: scoring.Rubric = scoring.Rubric()) -> DataFrame:
    """Scores (channel_id, rule_total, ai_total, hash, grade) after reviews (channel_id, points, materials).

    A review whose input is the same as when the score was last reviewed is not applied again: the hash of ids and of the
    materials in any order tells. Else the review's points are rounded to two places, and the grade is made
    of both totals.
    """
    fresh = reviews.withColumn("__hash", input_hash([F.col("channel_id")], F.col("materials"))).select("channel_id", "points", "__hash")
    joined = scores.join(fresh, "channel_id", "left")
    new = F.col("__hash").isNotNull() & ~F.col("__hash").eqNullSafe(F.col("hash"))
    points = F.when(new, F.round(F.col("points").cast("decimal(20,8)"), 2).cast("double")).otherwise(F.col("ai_total"))
    total = F.col("rule_total") + F.coalesce("ai_total", F.lit(0.0))
    merged = joined.withColumn("ai_total", points).withColumn("total", total)
    graded = F.when(new, grade(F.col("total"), *rubric.grades)).otherwise(F.col("grade"))
    return merged.select("channel_id", "rule_total", "ai_total", "total", graded.alias("grade"), F.when(new, F.col("__hash")).otherwise(F.col("hash")).alias("hash"), new.alias("applied"))


def priced(rows: DataFrame, order: str = "total") -> DataFrame:
    """Rows of the grade table with the price that counts: the one quoted, else the estimate, which says so. Best first by total, or by price for a view."""
    estimated = F.col("quoted").isNull()
    exact = F.round((F.col("quoted") / F.when(F.col("median_views") != 0, F.col("median_views"))).cast("decimal(30,10)"), 2).cast("double")
    shown = rows.withColumns({"estimated": estimated, "price": F.coalesce("quoted", "price"), "cpv": F.when(estimated | (F.col("median_views") == 0), F.col("cpv")).otherwise(exact)})
    keys = {"total": [F.desc("total"), "channel_id"], "cpv": [F.col("cpv").asc_nulls_last(), "channel_id"]}
    if order not in keys:
        raise ValueError(f"no order {order}")
    return shown.orderBy(*keys[order])


def already_scored(rising: DataFrame, scored: DataFrame, n: int = 500) -> DataFrame:
    """Rising channels, and whether they are among the best `n` candidates."""
    best = scoring.top_scores(scored, n).select("channel_id", F.lit(True).alias("scored"))
    return rising.filter("badge").join(best, "channel_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


def arbitrage(subscribers: Column, median_views: Column) -> tuple[Column, Column]:
    """Views to be expected of an audience, and how many times as many there are; 0 without an audience."""
    expected = F.when(subscribers > 0, F.pow(subscribers.cast("double"), F.lit(0.85)) * 1.125).otherwise(0.0)
    return expected, F.when(subscribers > 0, median_views / F.when(subscribers > 0, expected)).otherwise(0.0)


def _bodies(spark, sf_dir) -> DataFrame:
    """Review bodies made from events: some without lists, some with quotes that stand nowhere."""
    e = view(spark, sf_dir, "alert").select("event_id", "event_type", "user_id", "value")
    k = F.col("event_id")
    quote = F.when(k % 3 == 0, "words nobody said").otherwise(F.concat(F.lit("seen a "), "event_type", F.lit(" by user")))
    evidence = F.array(F.struct(F.lit("transcript").alias("source"), quote.alias("quote")))
    item = lambda score: F.struct(score.alias("score"), F.array(F.lit("why")).alias("reasons"), F.when(k % 5 != 0, evidence).alias("evidence"))
    risk = F.struct(F.lit("claim").alias("claim"), evidence.alias("evidence"), F.when(k % 2 == 0, "high").alias("severity"))
    verdict = F.struct(F.lit("so so").alias("headline"), F.when(k % 4 == 0, "conditional").when(k % 4 == 1, "recommend").alias("recommend"), F.when(k % 8 == 0, F.array(F.lit("ask"))).alias("conditions"))
    body = F.to_json(F.struct(F.when(k % 7 != 0, F.array(risk)).alias("risks"), item(F.col("user_id") % 15 * 1.0).alias("brandSafety"), item(F.col("user_id") % 5 * 1.0 - 1.0).alias("campaignFit"), verdict.alias("verdict"), F.when(k % 3 != 2, "high").alias("confidence")))
    return e.select("event_id", F.concat(F.lit("I have  SEEN a "), "event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("source"), body.alias("body"))


def _review_rows(spark, sf_dir) -> DataFrame:
    r = typed_reviews(_bodies(spark, sf_dir))
    return r.select("event_id", F.size("risks").cast("bigint").alias("risks"), F.coalesce(F.get("risks", F.lit(0))["severity"], F.lit("")).alias("severity"), F.coalesce(F.get("risks", F.lit(0))["basis"], F.lit("")).alias("basis"), F.col("brandSafety.score").alias("safety"), F.size("brandSafety.evidence").cast("bigint").alias("evidence"), F.col("audienceQuality.score").alias("audience"), F.col("verdict.recommend").alias("recommend"), F.size("verdict.conditions").cast("bigint").alias("conditions"), "confidence")


def _checked_rows(spark, sf_dir) -> DataFrame:
    r = checked_reviews(typed_reviews(_bodies(spark, sf_dir)), (F.col("source"),), F.col("event_id") % 2 == 0)
    return r.select("event_id", F.size("risks").cast("bigint").alias("risks"), F.col("brandSafety.score").alias("safety"), F.col("brandSafety.unverified").alias("unverified"), F.col("campaignFit.score").alias("fit"), F.round("audienceQuality.score", 6).alias("audience"), "recommend", "confidence")


def _decisions(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "channel").filter("channel_id % 4 <> 0")
    return c.select("channel_id", F.element_at(F.array(F.lit("APPROVED"), F.lit("REJECTED"), F.lit("HOLD")), (F.col("channel_id") % 3 + 1).cast("int")).alias("decision"))


def _arbitrage(spark, sf_dir) -> DataFrame:
    m = view(spark, sf_dir, "channel").join(whole_medians(view(spark, sf_dir, "video")), "channel_id")
    expected, ratio = arbitrage(F.col("subscribers"), F.col("median_views"))
    return m.select("channel_id", F.round(expected, 4).alias("expected"), F.round(ratio, 6).alias("ratio"))


def _scores(spark, sf_dir) -> DataFrame:
    """Scores of channels, two of three reviewed before, half of those with the materials of today."""
    c = view(spark, sf_dir, "channel")
    seen = input_hash([F.col("channel_id")], F.array(F.lit("b"), F.lit("a"), F.when(F.col("channel_id") % 2 == 0, F.lit("old")).otherwise("c")))
    before = F.col("channel_id") % 3 != 0
    return c.select("channel_id", (F.col("channel_id") % 70 + 0.25).alias("rule_total"), F.when(before, 12.5).alias("ai_total"), F.when(before, seen).alias("hash"), F.lit("D").alias("grade"))


def _reviewed(spark, sf_dir) -> DataFrame:
    reviews = view(spark, sf_dir, "channel").filter("channel_id % 7 <> 0").select("channel_id", (F.col("channel_id") % 30 + 0.125).alias("points"), F.array(F.lit("a"), F.lit("c"), F.lit("b")).alias("materials"))
    return apply_reviews(_scores(spark, sf_dir), reviews).select("channel_id", "rule_total", "ai_total", "total", "grade", "applied")


def _priced(spark, sf_dir) -> DataFrame:
    rows = scoring._scored(spark, sf_dir).select("channel_id", F.round("total", 6).alias("total"), "price", F.round("cpv", 6).alias("cpv"))
    known = rows.join(whole_medians(view(spark, sf_dir, "video")), "channel_id", "left").withColumn("median_views", F.coalesce("median_views", F.lit(0).cast("bigint")))
    return priced(known.withColumn("quoted", F.when(F.col("channel_id") % 3 == 0, F.col("channel_id") * 1000)), "cpv").limit(50).select("channel_id", "price", "estimated", "cpv")


QUERIES = {
    "reviews_applied": _reviewed,
    "quoted_prices": _priced,
    "review_records": _review_rows,
    "review_checks": _checked_rows,
    "review_decisions": lambda s, d: _decisions(s, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n")),
    "whole_medians": lambda s, d: whole_medians(view(s, d, "video")),
    "grade_table": lambda s, d: grade_table(scoring.top_scores(scoring._scored(s, d), 15).select("channel_id", F.round("total", 6).alias("total"), "price"), _decisions(s, d), whole_medians(view(s, d, "video"))),
    "rising_scored": lambda s, d: already_scored(scoring.rising_index(scoring._metrics(s, d)), scoring._scored(s, d)).select("channel_id", "scored"),
    "active_signals": lambda s, d: scoring.rising_index(scoring._metrics(s, d)).filter("badge").orderBy(F.desc("rising"), "channel_id").limit(20).select("channel_id", F.round("rising", 6).alias("rising")),
    "arbitrage_ratio": _arbitrage,
}

_REVIEW_SQL = f"{with_views('alert')}, e AS (SELECT event_id, user_id, event_id % 3 = 0 OR event_id % 5 = 0 AS none, event_id % 7 <> 0 AS risky FROM alert)"
_MEDIANS = "med AS (SELECT channel_id, CAST(floor(median(views)) AS BIGINT) AS median_views FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id DESC) AS n FROM video WHERE duration_seconds > 60) WHERE n <= 50 GROUP BY channel_id)"
_DECIDED = "(SELECT channel_id, ['APPROVED', 'REJECTED', 'HOLD'][channel_id % 3 + 1] AS decision FROM channel WHERE channel_id % 4 <> 0)"
_RISING = scoring.SQL["rising_index"]

SQL = {
    "reviews_applied": f"""{with_views('channel')}, a AS (SELECT channel_id, channel_id % 70 + 0.25 AS rule_total, channel_id % 7 <> 0 AND NOT (channel_id % 3 <> 0 AND channel_id % 2 <> 0) AS applied FROM channel),
        b AS (SELECT *, CASE WHEN applied THEN channel_id % 30 + 0.13 WHEN channel_id % 3 <> 0 THEN 12.5 END AS ai_total FROM a), c AS (SELECT *, rule_total + coalesce(ai_total, 0) AS total FROM b)
        SELECT channel_id, CAST(rule_total AS DOUBLE) AS rule_total, CAST(ai_total AS DOUBLE) AS ai_total, CAST(total AS DOUBLE) AS total, CASE WHEN NOT applied THEN 'D' WHEN total >= 85 THEN 'S' WHEN total >= 70 THEN 'A' WHEN total >= 55 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS grade, applied FROM c""",
    "quoted_prices": f"""{with_views('video', 'channel')}, {_MEDIANS}, s AS ({scoring._SQL_SCORED} SELECT channel_id, price, round(cpv, 6) AS cpv FROM t), x AS (SELECT channel_id, channel_id % 3 <> 0 AS estimated, CASE WHEN channel_id % 3 = 0 THEN channel_id * 1000 ELSE price END AS price,
        CASE WHEN channel_id % 3 <> 0 OR coalesce(median_views, 0) = 0 THEN cpv ELSE CAST(round(CAST(channel_id * 1000 / median_views AS DECIMAL(30, 10)), 2) AS DOUBLE) END AS cpv FROM s LEFT JOIN med USING (channel_id)) SELECT channel_id, price, estimated, cpv FROM x ORDER BY cpv NULLS LAST, channel_id LIMIT 50""",
    "review_records": f"""{_REVIEW_SQL} SELECT event_id, CASE WHEN risky THEN 1::BIGINT ELSE 0 END AS risks, CASE WHEN NOT risky THEN '' WHEN event_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN risky THEN 'INFERRED' ELSE '' END AS basis, CAST(user_id % 15 AS DOUBLE) AS safety, CASE WHEN event_id % 5 <> 0 THEN 1::BIGINT ELSE 0 END AS evidence, 0.0::DOUBLE AS audience,
        CASE event_id % 4 WHEN 0 THEN 'CONDITIONAL' WHEN 1 THEN 'RECOMMEND' ELSE 'HOLD' END AS recommend, CASE WHEN event_id % 8 = 0 THEN 1::BIGINT ELSE 0 END AS conditions, CASE WHEN event_id % 3 <> 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM e""",
    "review_checks": f"""{_REVIEW_SQL}, c AS (SELECT *, CASE WHEN none THEN 6.0 ELSE least(10.0, user_id % 15) END AS safety, risky AND event_id % 3 <> 0 AS risk FROM e)
        SELECT event_id, CASE WHEN risk THEN 1::BIGINT ELSE 0 END AS risks, CAST(safety AS DOUBLE) AS safety, none AS unverified, CAST(CASE WHEN none THEN 7.2 ELSE greatest(0, user_id % 5 - 1) END AS DOUBLE) AS fit, 4.8::DOUBLE AS audience,
        CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'CONDITIONAL' ELSE 'HOLD' END WHEN 1 THEN 'RECOMMEND' ELSE 'HOLD' END AS recommend,
        CASE WHEN risk AND event_id % 2 = 0 AND safety >= 10 THEN 'LOW' WHEN event_id % 3 <> 2 AND event_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM c""",
    "review_decisions": f"{with_views('channel')} SELECT decision, count(*) AS n FROM {_DECIDED} GROUP BY decision",
    "whole_medians": f"{with_views('video')}, {_MEDIANS} SELECT * FROM med",
    "grade_table": f"{with_views('video', 'channel')}, {_MEDIANS} SELECT channel_id, total, price, decision, coalesce(median_views, 0) AS median_views FROM ({scoring._SQL_SCORED} SELECT channel_id, round(total, 6) AS total, price FROM t WHERE reason IS NULL ORDER BY t.total DESC, channel_id LIMIT 15) LEFT JOIN {_DECIDED} USING (channel_id) LEFT JOIN med USING (channel_id)",
    "rising_scored": f"SELECT channel_id, channel_id IN (SELECT channel_id FROM ({scoring._SQL_SCORED} SELECT channel_id FROM t WHERE reason IS NULL ORDER BY total DESC, channel_id LIMIT 500)) AS scored FROM ({_RISING}) WHERE badge",
    "active_signals": f"SELECT channel_id, rising FROM ({_RISING}) WHERE badge ORDER BY rising DESC, channel_id LIMIT 20",
    "arbitrage_ratio": f"{with_views('video', 'channel')}, {_MEDIANS} SELECT channel_id, round(pow(subscribers, 0.85) * 1.125, 4) AS expected, round(median_views / (pow(subscribers, 0.85) * 1.125), 6) AS ratio FROM channel JOIN med USING (channel_id)",
}
