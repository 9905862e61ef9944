"""Queries that show the column functions over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeloom.functions import columns as c


def text_functions(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    noisy = F.concat(F.lit("\t "), "p_name", F.lit(" \n"))
    return part.select(
        "p_partkey",
        c.strip_text(noisy).alias("stripped"),
        c.number_strip(F.concat("p_brand", F.lit(" -1.5kg"))).alias("number"),
        c.replace_code(F.col("p_type"), {"SMALL": "S", "LARGE": "L"}).alias("code"),
        c.default_if_empty(F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")), "none").alias("defaulted"),
        c.strip_tags(F.concat(F.lit("<b>"), "p_name", F.lit("</b><br/>"))).alias("untagged"),
        c.normalize_field_name(F.concat_ws("_- ", "p_name", "p_type")).alias("field"),
        F.array_join(c.split_pipes(F.concat_ws("|", "p_name", F.lit(" "), "p_type")), "/").alias("parts"),
        c.natural_key(F.col("p_partkey"), F.when(F.col("p_size") > 9, F.col("p_brand"))).alias("key"),
        c.shorten_key(F.repeat("p_name", 12), 40).alias("short"),
        c.mask_mentions(F.concat(F.lit("by @"), F.regexp_replace("p_name", " ", "."), F.lit("!"))).alias("masked"),
        c.percent_difference(F.col("p_size"), F.col("p_partkey") % 50).alias("percent"),
        c.grade(F.col("p_size") * 2.0).alias("grade"),
        F.round(c.curve(F.col("p_size").cast("double"), ((5.0, 0.0), (20.0, 3.0), (40.0, 10.0))), 6).alias("points"),
    )


def hangul_and_keywords(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    title = F.concat_ws(" ", F.lit("캠핑장에서"), "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("추천")), F.lit("텐트를"), F.col("p_size").cast("string"))
    return part.select("p_partkey", F.round(c.hangul_share(title), 6).alias("share"), F.array_join(F.array_sort(c.keywords(title)), "|").alias("keywords"))


def date_functions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day, minute = F.lit("yyyy-MM-dd HH:mm:ss"), F.hour("ts") * 60 + F.minute("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("2026-8-1")
    return events.select(
        "event_id",
        *[F.date_format(c.bucket(F.col("ts"), g), "yyyy-MM-dd HH:mm:ss").alias(g.lower()) for g in ("DAY", "HOUR", "TEN_MINUTES")],
        F.date_format(c.week_start(F.col("ts")), "yyyy-MM-dd").alias("week"),
        c.whole_days(F.col("ts"), F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")).alias("days"),
        F.date_format(c.parse_date(text), "yyyy-MM-dd").alias("parsed"),
        c.in_quiet_hours(minute, 1380, 420).alias("quiet"),
        c.iso_seconds(F.when(F.col("event_id") % 5 == 0, "P1DT2H").when(F.col("event_id") % 5 == 1, "PT90S").when(F.col("event_id") % 5 == 2, "PT3M1S").when(F.col("event_id") % 5 == 3, "1h").otherwise("PT")).alias("seconds"),
    )


QUERIES = {"text_functions": text_functions, "hangul_and_keywords": hangul_and_keywords, "date_functions": date_functions}

_LONG = "repeat(p_name, 12)"
SQL = {
    "text_functions": f"""SELECT p_partkey, p_name AS stripped, regexp_replace(p_brand || ' -1.5kg', '[^0-9.\\-]', '', 'g') AS number, CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'LARGE' THEN 'L' ELSE p_type END AS code,
        CASE WHEN p_size % 3 = 0 THEN 'none' ELSE p_name END AS defaulted, p_name AS untagged, lower(replace(p_name, ' ', '') || p_type) AS field, p_name || '/' || p_type AS parts,
        CAST(p_partkey AS VARCHAR) || chr(31) || CASE WHEN p_size > 9 THEN p_brand ELSE '' END AS key, CASE WHEN length({_LONG}) > 40 THEN substring({_LONG}, 1, 23) || '~' || substring(sha256({_LONG}), 1, 16) ELSE {_LONG} END AS short, 'by @***!' AS masked,
        CASE WHEN greatest(p_size, p_partkey % 50) = 0 THEN 0.0 ELSE round(100 * abs(p_size - p_partkey % 50) / greatest(p_size, p_partkey % 50), 1) END AS percent, CASE WHEN p_size * 2 >= 85 THEN 'S' WHEN p_size * 2 >= 70 THEN 'A' WHEN p_size * 2 >= 55 THEN 'B' WHEN p_size * 2 >= 40 THEN 'C' ELSE 'D' END AS grade,
        round(CASE WHEN p_size <= 5 THEN 0.0 WHEN p_size <= 20 THEN 3.0 * (p_size - 5) / 15 WHEN p_size <= 40 THEN 3.0 + 7.0 * (p_size - 20) / 20 ELSE 10.0 END, 6) AS points FROM part""",
    "hangul_and_keywords": """WITH t AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, 9 + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END - 1 AS h, length(replace(p_name, ' ', '')) AS l FROM part),
        k AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN ['캠핑장', w[1], w[2], '추천', '텐트'] ELSE ['캠핑장', w[1], w[2], '텐트'] END AS x FROM t)
        SELECT p_partkey, round(h / (h + l), 6) AS share, array_to_string(list_sort(list_distinct(list_concat(list_filter(x, lambda y: y NOT IN ('추천', 'new')), list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])))), '|') AS keywords FROM k""",
    "date_functions": """SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS day, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS ten_minutes,
        strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS BIGINT) AS days, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d') END AS parsed, extract(hour FROM ts) >= 23 OR extract(hour FROM ts) < 7 AS quiet,
        CAST([93600, 90, 181, -1, -1][event_id % 5 + 1] AS BIGINT) AS seconds FROM events""",
}
