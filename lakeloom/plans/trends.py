"""Weekly keyword trends of titles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import STOP_WORDS, keywords, week_start
from lakeloom.sources.domain import view, with_views

ALL = "_all"


def keyword_counts(titles: DataFrame, least: int = 3, extract=keywords) -> DataFrame:
    """Keywords by week and category, and over all categories as `_all`; a title counts a keyword once. Rare ones are not kept.

    `extract` makes a title column's distinct keywords, so that another way of finding them can be put in.
    """
    every = F.array_union(F.array(F.lit(ALL)), F.coalesce("categories", F.array().cast("array<string>")))
    # Titles are dealt out first: however few row groups a file has, every task makes keywords of its share.
    rows = titles.select(week_start(F.col("published_at")).alias("week"), every.alias("categories"), "title").repartition(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = rows.select("week", "categories", F.explode(extract(F.col("title"))).alias("keyword"))
    # Counted by list of categories first: what is dealt out to each category is one row for each distinct keyword, not for each title.
    counted = words.groupBy("week", "categories", "keyword").agg(F.count(F.lit(1)).alias("n"))
    tall = counted.select("week", F.explode("categories").alias("category"), "keyword", "n")
    return tall.groupBy("week", "category", "keyword").agg(F.sum("n").alias("frequency")).filter(F.col("frequency") >= least)


def growth(counts: DataFrame) -> DataFrame:
    """Each week's keywords against the week before: its stored count (0 if it was not kept), the growth, and whether it is new."""
    # A keyword's weeks follow one another in a window, so the counts are made once.
    row = Window.partitionBy("category", "keyword").orderBy("week")
    known = (F.lag("week").over(row) == F.date_sub("week", 7)) & F.col("category").isNotNull() & F.col("keyword").isNotNull()
    joined = counts.withColumn("previous", F.when(known, F.lag("frequency").over(row)).otherwise(0))
    rate = F.when(F.col("previous") == 0, F.col("frequency").cast("double")).otherwise(F.col("frequency") / F.when(F.col("previous") != 0, F.col("previous")))
    return joined.withColumns({"growth": rate, "is_new": F.col("previous") == 0})


def rising(grown: DataFrame, category: str, week: dt.date, limit: int = 20, least: float = 1.5) -> DataFrame:
    """Of the most frequent 5 * limit keywords of a week those that grow, fastest first."""
    frequent = grown.filter((F.col("category") == category) & (F.col("week") == F.lit(week))).orderBy(F.desc("frequency"), "keyword").limit(limit * 5)
    return frequent.filter(F.col("growth") >= least).orderBy(F.desc("growth"), F.desc("frequency"), "keyword").limit(limit)


def _titles(spark, sf_dir) -> DataFrame:
    channels = spark.range(40).select(F.col("id").alias("channel_id"), F.when(F.col("id") % 4 != 3, F.array(F.element_at(F.array(F.lit("food"), F.lit("camp"), F.lit("toys")), (F.col("id") % 4 + 1).cast("int")))).alias("categories"))
    return view(spark, sf_dir, "title").join(F.broadcast(channels), "channel_id", "left")


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


QUERIES = {
    "keyword_counts": lambda s, d: _out(keyword_counts(_titles(s, d))),
    "trend_growth": lambda s, d: _out(growth(keyword_counts(_titles(s, d)))).withColumn("growth", F.round("growth", 6)),
    "trend_rising": lambda s, d: rising(growth(keyword_counts(_titles(s, d))), ALL, dt.date(2024, 1, 8)).select("keyword", "frequency", "previous"),
    "trend_top": lambda s, d: keyword_counts(_titles(s, d)).filter(F.col("category") == "food").groupBy("keyword").agg(F.sum("frequency").alias("frequency")).orderBy(F.desc("frequency"), "keyword").limit(20),
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_COUNTS = f"""{with_views('title')}, w AS (SELECT title_id, channel_id, date_trunc('week', published_at) AS week, list_filter(string_split_regex(lower(title), '[^가-힣ㄱ-ㅎㅏ-ㅣa-z0-9]+'), lambda x: length(x) BETWEEN 2 AND 12 AND NOT regexp_matches(x, '^[0-9]*$')) AS words FROM title),
    k AS (SELECT week, channel_id, unnest(list_distinct(list_concat(list_filter(words, lambda x: x NOT IN ({_STOP})), list_filter(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), lambda x: length(x) <= 24)))) AS keyword FROM w),
    d AS (SELECT week, channel_id % 4 AS kind, keyword, count(*) AS n FROM k GROUP BY ALL),
    c AS (SELECT week, keyword, n AS times, unnest(CASE kind WHEN 3 THEN ['{ALL}'] ELSE ['{ALL}', ['food', 'camp', 'toys'][kind + 1]] END) AS category FROM d),
    n AS (SELECT week, category, keyword, CAST(sum(times) AS BIGINT) AS frequency FROM c GROUP BY ALL HAVING sum(times) >= 3),
    g AS (SELECT a.week, a.category, a.keyword, a.frequency, coalesce(b.frequency, 0) AS previous, CASE WHEN b.frequency IS NULL THEN CAST(a.frequency AS DOUBLE) ELSE a.frequency / b.frequency END AS growth, b.frequency IS NULL AS is_new
      FROM n a LEFT JOIN n b ON a.category = b.category AND a.keyword = b.keyword AND a.week = b.week + INTERVAL 7 DAY)"""

SQL = {
    "keyword_counts": f"{_COUNTS} SELECT strftime(week, '%Y-%m-%d') AS week, category, keyword, frequency FROM n",
    "trend_growth": f"{_COUNTS} SELECT strftime(week, '%Y-%m-%d') AS week, category, keyword, frequency, previous, round(growth, 6) AS growth, is_new FROM g",
    "trend_rising": f"{_COUNTS} SELECT keyword, frequency, previous FROM (SELECT * FROM g WHERE category = '{ALL}' AND week = TIMESTAMP '2024-01-08' ORDER BY frequency DESC, keyword LIMIT 100) WHERE growth >= 1.5 ORDER BY growth DESC, frequency DESC, keyword LIMIT 20",
    "trend_top": f"{_COUNTS} SELECT keyword, CAST(sum(frequency) AS BIGINT) AS frequency FROM n WHERE category = 'food' GROUP BY keyword ORDER BY 2 DESC, keyword LIMIT 20",
}
