"""A run's fields, mates of an item, snapshots of rows, sinks by mode, the outbox, and discovery in turns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.columns import dice, normalize_name, parse_time
from lakeloom.operators import names
from lakeloom.operators.transform import last_wins, merge, stage
from lakeloom.plans import listings, trends
from lakeloom.sources.domain import view, with_views


def run_fields(runs: DataFrame, connectors: DataFrame, field_maps: DataFrame, target_fields: DataFrame) -> DataFrame:
    """The fields that each run connected, by the mapping it ran with, with the name of the target field in its connector's model; null without one."""
    mapped = runs.join(connectors, "connector_id").join(field_maps, "mapping_id")
    return mapped.join(target_fields, ["model", "target"], "left").select("run_id", "source_field", "target", "display_name", "sort_order")


def mate_candidates(board: DataFrame, reference: str, side: str | None = None, needle: str = "", limit: int = 20) -> DataFrame:
    """Items that are in no unit yet (of one side or both), those most like a name first; where a word is searched for, its matches by name."""
    free = board.filter(F.col("kind") != "LINKED").filter(listings.optional("source", side))
    score = F.round(dice(normalize_name(F.lit(reference)), normalize_name(F.col("raw_name"))), 6)
    found = listings.matching(free, needle.strip()) if needle.strip() else free
    first = [] if needle.strip() else [F.desc("score")]
    return found.withColumn("score", score).orderBy(*first, "raw_name", "source", "item_ref").limit(limit)


def row_snapshots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as JSON under its natural key; nulls are left out."""
    return stage(rows, keys)


def populated(snapshots: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows that snapshots hold; what a snapshot leaves out is null."""
    return snapshots.select(F.from_json("payload", schema).alias("r")).select("r.*")


#: What a run writes, by its mode: the table with its rows merged in, or rows for a look before that.
SINKS: dict[str, Callable[[DataFrame, DataFrame, list[str], list[str]], DataFrame]] = {
    "LIVE": merge,
    "TEST": lambda existing, new, keys, order: stage(last_wins(new, keys, order), keys),
}


def sink(mode: str) -> Callable[[DataFrame, DataFrame, list[str], list[str]], DataFrame]:
    """The writer of a run's mode; an unknown mode is an error."""
    if mode not in SINKS:
        raise ValueError(f"no sink for run mode {mode}")
    return SINKS[mode]


def enqueued(outbox: DataFrame, new: DataFrame, now: dt.datetime, hours: int, order: list[str]) -> DataFrame:
    """Rows to append to the outbox, waiting to be sent: one for each key that had none in the last hours; rows of a blank key are never held back."""
    blank = F.trim(F.coalesce("dedupe_key", F.lit(""))) == ""
    recent = outbox.filter(F.col("created_at") > F.lit(now - dt.timedelta(hours=hours)).cast("timestamp_ntz")).select("dedupe_key").distinct()
    keyed = new.filter(~blank)
    others = [c for c in new.columns if c != "dedupe_key"]
    first = keyed.groupBy("dedupe_key").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select("dedupe_key", "r.*")
    rows = first.join(recent, "dedupe_key", "left_anti").unionByName(new.filter(blank))
    return rows.select("dedupe_key", F.lit("PENDING").alias("status"), F.to_json(F.struct(*others)).alias("payload"))


def next_targets(cursors: DataFrame, limit: int) -> DataFrame:
    """Whose turn it is: never visited ones first, then those whose last visit is longest ago."""
    return cursors.orderBy(F.col("last_run").asc_nulls_first(), "cursor_key").limit(limit)


def advanced(cursors: DataFrame, pages: DataFrame, now: dt.datetime) -> DataFrame:
    """Cursors after a round: those with a page take its next token (null: from the start again) and count its finds; others stay."""
    seen = pages.select("cursor_key", "next_token", F.col("found").alias("new_finds"), F.lit(True).alias("visited"))
    both = cursors.join(seen, "cursor_key", "left")
    return both.select(
        "cursor_key",
        F.when(F.col("visited"), F.col("next_token")).otherwise(F.col("token")).alias("token"),
        (F.col("finds") + F.coalesce("new_finds", F.lit(0))).alias("finds"),
        F.when(F.col("visited"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_run")).alias("last_run"),
    )


def plain_words(c: Column) -> Column:
    """A keyword extractor without rules of a language: distinct words of four small Latin letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([a-z]{4,})"), F.lit(1)))


_NOW = dt.datetime(2024, 1, 31)


def _run_fields(spark, sf_dir) -> DataFrame:
    runs = view(spark, sf_dir, "alert").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 7).alias("connector_id"), (F.col("user_id") % 5).alias("mapping_id"))
    connectors = spark.range(7).select(F.col("id").alias("connector_id"), F.when(F.col("id") % 3 == 0, "stock").otherwise("order").alias("model"))
    cells = spark.range(15).select((F.col("id") % 5).alias("mapping_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("source_field"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("target"), F.col("id").alias("sort_order"))
    targets = spark.range(6).select(F.when(F.col("id") < 3, "stock").otherwise("order").alias("model"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("target"), F.concat(F.lit("Field "), F.col("id").cast("string")).alias("display_name"))
    return run_fields(runs, connectors, cells, targets)


def _board(spark, sf_dir) -> DataFrame:
    items = names._names(spark, sf_dir)
    return names.board(items, view(spark, sf_dir, "member"), names.LEFT, names.RIGHT).join(items, ["source", "item_ref"])


def _times(spark, sf_dir) -> DataFrame:
    k, text = F.col("event_id") % 6, lambda f: F.date_format("ts", f)
    value = F.when(k == 0, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).when(k == 2, text("yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, text("yyyy-MM-dd")).when(k == 4, text("yyyy-MM-dd'T'HH:mm")).otherwise("2026-8-1 10:00")
    return view(spark, sf_dir, "alert").select("event_id", F.unix_seconds(parse_time(value, "Asia/Seoul")).alias("seconds"))


def _snapshots(spark, sf_dir) -> DataFrame:
    lines = view(spark, sf_dir, "order_line").drop("shipped_at")
    return populated(row_snapshots(lines, ["order_no", "line_no"]), lines.schema)


def _quantities(spark, sf_dir, mode: str) -> DataFrame:
    existing = view(spark, sf_dir, "sku").select("sku_id", "quantity", F.lit(0).cast("bigint").alias("seq"))
    new = view(spark, sf_dir, "order_line").filter("sku_id is not null").select("sku_id", "quantity", (F.col("order_no") * 10 + F.col("line_no")).alias("seq"))
    return sink(mode)(existing, new, ["sku_id"], ["seq"])


def _outbox(spark, sf_dir) -> DataFrame:
    alerts = view(spark, sf_dir, "alert").withColumn("dedupe_key", F.when(F.col("user_id") % 4 == 0, " ").otherwise(F.concat(F.lit("low:"), F.col("user_id").cast("string"))))
    sent = alerts.filter("event_type = 'error'").select("dedupe_key", F.col("ts").alias("created_at"))
    return enqueued(sent, alerts.filter("event_type = 'view'").select("dedupe_key", "event_id", "user_id"), _NOW, 72, ["event_id"])


def _discovery(spark, sf_dir) -> DataFrame:
    visited = F.when(F.col("cursor_key") % 3 != 0, F.col("last"))
    seen = view(spark, sf_dir, "alert").groupBy(F.col("user_id").alias("cursor_key")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("finds"))
    cursors = seen.select("cursor_key", F.concat(F.lit("p"), (F.col("cursor_key") % 4).cast("string")).alias("token"), "finds", visited.alias("last_run"))
    pages = next_targets(cursors, 8).filter("cursor_key % 5 <> 1").select("cursor_key", F.when(F.col("cursor_key") % 2 == 0, F.lit("p9")).alias("next_token"), F.lit(100).cast("bigint").alias("found"))
    return advanced(cursors, pages, _NOW).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


_REFERENCE = "red widget (27.01.02)"
QUERIES = {
    "run_fields": _run_fields,
    "mate_candidates": lambda s, d: mate_candidates(_board(s, d), _REFERENCE).select("source", "item_ref", "score"),
    "mate_search": lambda s, d: mate_candidates(_board(s, d), _REFERENCE, "wms", " NEW ", 50).select("source", "item_ref", "score"),
    "time_parsing": _times,
    "row_snapshots": _snapshots,
    "filter_values_json": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.to_json(F.split("p_name", " ")).alias("words")),
    "sink_live": lambda s, d: _quantities(s, d, "LIVE"),
    "sink_test": lambda s, d: _quantities(s, d, "TEST"),
    "outbox_append": _outbox,
    "discovery_round": _discovery,
    "keyword_counts_plain": lambda s, d: trends._out(trends.keyword_counts(trends._titles(s, d), extract=plain_words)),
}

_GRAMS = names._GRAMS.format
_MATES = f"""{names._BOARD}, m AS (SELECT b.source, b.item_ref, b.kind, n.raw_name, {names._NORMAL.format('n.raw_name')} AS own, {names._NORMAL.format(f"'{_REFERENCE}'")} AS base FROM board b JOIN names n USING (source, item_ref) WHERE b.kind <> 'LINKED'),
    s AS (SELECT *, round(CASE WHEN trim(own) = '' OR trim(base) = '' THEN 0.0 WHEN own = base THEN 1.0 WHEN length(own) < 2 OR length(base) < 2 THEN 0.0 ELSE 2.0 * len(list_intersect({_GRAMS('own')}, {_GRAMS('base')})) / (len({_GRAMS('own')}) + len({_GRAMS('base')})) END, 6) AS score FROM m)"""
_LAST = f"{with_views('sku', 'order_line')}, n AS (SELECT sku_id, arg_max(quantity, order_no * 10 + line_no) AS quantity, max(order_no * 10 + line_no) AS seq FROM order_line WHERE sku_id IS NOT NULL GROUP BY sku_id)"

SQL = {
    "run_fields": f"""{with_views('alert')}, cells AS (SELECT id % 5 AS mapping_id, 'f' || id AS source_field, 't' || (id % 4) AS target, id AS sort_order FROM range(15) r(id)),
        targets AS (SELECT CASE WHEN id < 3 THEN 'stock' ELSE 'order' END AS model, 't' || (id % 3) AS target, 'Field ' || id AS display_name FROM range(6) r(id))
        SELECT event_id AS run_id, source_field, c.target, display_name, sort_order FROM alert JOIN cells c ON c.mapping_id = user_id % 5 LEFT JOIN targets t ON t.target = c.target AND t.model = CASE WHEN user_id % 7 % 3 = 0 THEN 'stock' ELSE 'order' END""",
    "mate_candidates": f"{_MATES} SELECT source, item_ref, score FROM s ORDER BY score DESC, raw_name, source, item_ref LIMIT 20",
    "mate_search": f"{_MATES} SELECT source, item_ref, score FROM s WHERE source = 'wms' AND (contains(lower(raw_name), 'new') OR contains(CAST(item_ref AS VARCHAR), 'new')) ORDER BY raw_name, source, item_ref LIMIT 50",
    "time_parsing": """SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN floor(epoch(ts)) WHEN 1 THEN floor(epoch(ts)) - 32400 WHEN 2 THEN floor(epoch(ts)) - 32400 WHEN 3 THEN epoch(date_trunc('day', ts)) - 32400 WHEN 4 THEN epoch(date_trunc('minute', ts)) - 32400 END AS BIGINT) AS seconds FROM events""",
    "row_snapshots": f"{with_views('order_line')} SELECT order_no, line_no, item, sku_id, quantity, amount FROM order_line",
    "filter_values_json": "SELECT p_partkey, CAST(to_json(string_split(p_name, ' ')) AS VARCHAR) AS words FROM part",
    "sink_live": f"{_LAST} SELECT sku_id, coalesce(n.quantity, sku.quantity) AS quantity, coalesce(seq, 0) AS seq FROM sku FULL JOIN n USING (sku_id)",
    "sink_test": f"""{_LAST} SELECT CAST(sku_id AS VARCHAR) AS natural_key, concat('{{"sku_id":', sku_id, ',"quantity":', quantity, ',"seq":', seq, '}}') AS payload FROM n""",
    "outbox_append": f"""{with_views('alert')}, k AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN ' ' ELSE 'low:' || user_id END AS dedupe_key FROM alert), v AS (SELECT * FROM k WHERE event_type = 'view'),
        r AS (SELECT dedupe_key, min(event_id) AS event_id, min(user_id) AS user_id FROM v WHERE dedupe_key <> ' ' GROUP BY dedupe_key UNION ALL SELECT dedupe_key, event_id, user_id FROM v WHERE dedupe_key = ' ')
        SELECT dedupe_key, 'PENDING' AS status, concat('{{"event_id":', event_id, ',"user_id":', user_id, '}}') AS payload FROM r WHERE dedupe_key = ' ' OR dedupe_key NOT IN (SELECT dedupe_key FROM k WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-28')""",
    "discovery_round": f"""{with_views('alert')}, c AS (SELECT user_id AS cursor_key, 'p' || (user_id % 4) AS token, count(*) AS finds, CASE WHEN user_id % 3 <> 0 THEN max(ts) END AS last_run FROM alert GROUP BY user_id),
        p AS (SELECT cursor_key FROM (SELECT * FROM c ORDER BY last_run NULLS FIRST, cursor_key LIMIT 8) WHERE cursor_key % 5 <> 1)
        SELECT c.cursor_key, CASE WHEN p.cursor_key IS NULL THEN token WHEN c.cursor_key % 2 = 0 THEN 'p9' END AS token, finds + CASE WHEN p.cursor_key IS NULL THEN 0 ELSE 100 END AS finds, CASE WHEN p.cursor_key IS NOT NULL THEN '2024-01-31 00:00:00' ELSE strftime(last_run, '%Y-%m-%d %H:%M:%S') END AS last_run FROM c LEFT JOIN p USING (cursor_key)""",
    "keyword_counts_plain": f"""{with_views('title')}, k AS (SELECT date_trunc('week', published_at) AS week, channel_id, unnest(list_distinct(regexp_extract_all(coalesce(title, ''), '[a-z]{{4,}}'))) AS keyword FROM title),
        c AS (SELECT week, keyword, unnest(CASE channel_id % 4 WHEN 3 THEN ['{trends.ALL}'] ELSE ['{trends.ALL}', ['food', 'camp', 'toys'][channel_id % 4 + 1]] END) AS category FROM k)
        SELECT strftime(week, '%Y-%m-%d') AS week, category, keyword, count(*) AS frequency FROM c GROUP BY ALL HAVING count(*) >= 3""",
}
