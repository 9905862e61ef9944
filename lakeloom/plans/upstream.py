"""Channels as their platform gives them: refresh, dormancy, one snapshot a day, videos; and messages with attempts and retries by hand."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.transform import last_wins
from lakeloom.plans.orders import update_counters
from lakeloom.sources.domain import view, with_views

#: What a refresh of a known video may change.
COUNTERS = ("views", "likes", "comments", "paid")


def refreshed(channels: DataFrame, asked: DataFrame, fetched: DataFrame) -> DataFrame:
    """Channels (channel_id, subscribers, dormant, refreshed) after those `asked` for were fetched (channel_id, ts, id, subscribers).

    The last answer counts. A channel that was asked for and has no answer is gone upstream: it goes dormant and keeps what it had.
    Channels that nobody asked for stay, and answers nobody asked for are ignored.
    """
    last = last_wins(fetched.select("channel_id", "ts", "id", "subscribers"), ["channel_id"], ["ts", "id"]).select("channel_id", F.col("ts").alias("__at"), F.col("subscribers").alias("__now"))
    told = channels.join(asked.select("channel_id", F.lit(True).alias("__asked")).distinct(), "channel_id", "left").join(last, "channel_id", "left")
    answered = F.col("__asked").isNotNull() & F.col("__at").isNotNull()
    changed = {"dormant": F.col("dormant") | (F.col("__asked").isNotNull() & F.col("__at").isNull()), "subscribers": F.when(answered, F.col("__now")).otherwise(F.col("subscribers")), "refreshed": F.when(answered, F.col("__at")).otherwise(F.col("refreshed"))}
    return told.withColumns(changed).drop("__asked", "__at", "__now")


def captured(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Snapshots (channel_id, day, subscribers) with one for each channel and UTC day: what is stored stays, else the day's first answer counts."""
    first = fetched.groupBy("channel_id", F.to_date("ts").alias("day")).agg(F.min_by("subscribers", F.struct("ts", "id")).alias("subscribers"))
    return stored.select(*first.columns).unionByName(first.join(stored.select("channel_id", "day"), ["channel_id", "day"], "left_anti"))


def videos_after(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known videos with new counters, and new ones whole. A video whose length could not be read (negative or null) is left out, as 0 would make it a short."""
    return update_counters(stored, fetched.filter("duration_seconds >= 0"), "video_id", COUNTERS)


def delivery(events: DataFrame, most: int = 5) -> DataFrame:
    """What became of each message: `status`, `attempts` since its last retry, and how many events were `ignored`.

    Events (key, at, id, kind) count in order of time. A pending message is SENT by `ok`, and FAILED by `fatal` or the `most`-th `fail`;
    `retry` brings a failed one back with no attempts. Whatever does not fit the status is ignored: attempts of messages that are
    sent or failed, and retries of others. A fold over sorted partitions that keeps one message's state; null keys are one message.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = fold, None  # the message at hand (none yet): [status, attempts, ignored]
        for rows in batches:
            out = []
            for key, kind in zip(rows["key"].astype(object).where(rows["key"].notna(), None), rows["kind"], strict=True):
                if key != now:
                    if state:
                        out.append((now, *state))
                    now, state = key, ["PENDING", 0, 0]
                if kind == "retry" and state[0] == "FAILED":
                    state[:2] = "PENDING", 0
                elif kind in ("ok", "fail", "fatal") and state[0] == "PENDING":
                    state[1] += kind != "ok"
                    if kind == "ok":
                        state[0] = "SENT"
                    elif kind == "fatal" or state[1] >= most:
                        state[0] = "FAILED"
                else:
                    state[2] += 1
            yield pd.DataFrame(out, columns=["key", "status", "attempts", "ignored"])
        if state:
            yield pd.DataFrame([(now, *state)], columns=["key", "status", "attempts", "ignored"])

    kind = events.schema["key"].dataType.simpleString()
    ordered = events.select(F.col("key").cast("string").alias("key"), "at", "id", "kind").repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(fold, "key string, status string, attempts long, ignored long").withColumn("key", F.col("key").cast(kind))


# --- queries --------------------------------------------------------------------------------------


def _fetched(spark, sf_dir) -> DataFrame:
    e = view(spark, sf_dir, "alert").filter("user_id % 17 <> 0")
    return e.select(F.col("user_id").alias("channel_id"), "ts", F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("bigint").alias("subscribers"))


def _channels(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "channel")
    return c.select("channel_id", F.col("subscribers").cast("bigint").alias("subscribers"), F.col("excluded").alias("dormant"), F.lit(None).cast("timestamp_ntz").alias("refreshed"))


def _snapshots(spark, sf_dir) -> DataFrame:
    """Stored before: the first week of even channels, as of some earlier run."""
    early = _fetched(spark, sf_dir).filter((F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("channel_id") % 2 == 0))
    return early.select("channel_id", F.to_date("ts").alias("day"), F.lit(-1).cast("bigint").alias("subscribers")).distinct()


def _videos(spark, sf_dir, now: bool) -> DataFrame:
    v = view(spark, sf_dir, "video").select("video_id", "channel_id", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "duration_seconds", "views", F.floor("likes").alias("likes"), F.floor("comments").alias("comments"), "paid")
    if not now:
        return v.filter("video_id % 3 <> 0")
    length = F.when(F.col("video_id") % 23 == 0, -1).when(F.col("video_id") % 29 != 0, F.col("duration_seconds") + 1)
    return v.withColumns({"views": F.col("views") + 7, "paid": ~F.col("paid"), "duration_seconds": length})


def _attempts(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 24 == 0, "ok").when(e % 8 == 1, "fatal").when(e % 8 == 2, "retry").otherwise("fail")
    return view(spark, sf_dir, "alert").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), e.alias("id"), kind.alias("kind"))


QUERIES = {
    "channel_refresh": lambda s, d: refreshed(_channels(s, d), _channels(s, d).filter("channel_id % 3 <> 0"), _fetched(s, d)).withColumn("refreshed", F.date_format("refreshed", "yyyy-MM-dd HH:mm")),
    "channel_snapshots": lambda s, d: captured(_snapshots(s, d), _fetched(s, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd")),
    "video_refresh": lambda s, d: videos_after(_videos(s, d, False), _videos(s, d, True)).withColumn("duration_seconds", F.col("duration_seconds").cast("bigint")),
    "message_delivery": lambda s, d: delivery(_attempts(s, d)),
}

_F = f"{with_views('alert', 'channel', 'video')}, f AS (SELECT user_id AS channel_id, ts, event_id AS id, CAST(round(value * 100) AS BIGINT) AS subscribers FROM alert WHERE user_id % 17 <> 0)"
_STEP = "CASE WHEN kind = 'retry' AND status = 'FAILED' THEN {retry} WHEN kind <> 'retry' AND status = 'PENDING' THEN {attempt} ELSE {other} END"
SQL = {
    "channel_refresh": f"""{_F}, l AS (SELECT channel_id, arg_max(subscribers, (ts, id)) AS now, max(ts) AS t FROM f WHERE channel_id % 3 <> 0 GROUP BY 1)
        SELECT channel_id, coalesce(now, subscribers) AS subscribers, excluded OR (channel_id % 3 <> 0 AND t IS NULL) AS dormant, strftime(t, '%Y-%m-%d %H:%M') AS refreshed FROM channel LEFT JOIN l USING (channel_id)""",
    "channel_snapshots": f"""{_F} SELECT channel_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN channel_id % 2 = 0 AND min(ts) < TIMESTAMP '2024-01-08' THEN -1 ELSE arg_min(subscribers, (ts, id)) END AS subscribers FROM f GROUP BY 1, 2""",
    "video_refresh": f"""{_F}, v AS (SELECT video_id, channel_id, strftime(published_at, '%Y-%m-%d') AS published, duration_seconds, views, CAST(floor(likes) AS BIGINT) AS likes, CAST(floor(comments) AS BIGINT) AS comments, paid, video_id % 23 <> 0 AND video_id % 29 <> 0 AS readable, video_id % 3 <> 0 AS known FROM video)
        SELECT video_id, channel_id, published, CAST(CASE WHEN known THEN duration_seconds ELSE duration_seconds + 1 END AS BIGINT) AS duration_seconds, CASE WHEN readable THEN views + 7 ELSE views END AS views, likes, comments, CASE WHEN readable THEN NOT paid ELSE paid END AS paid FROM v WHERE known OR readable""",
    "message_delivery": f"""{with_views('alert').replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 24 = 0 THEN 'ok' WHEN event_id % 8 = 1 THEN 'fatal' WHEN event_id % 8 = 2 THEN 'retry' ELSE 'fail' END AS kind FROM alert),
        s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, 'PENDING' AS status, 0 AS attempts, 0 AS ignored FROM e
        UNION ALL SELECT s.key, e.n, {_STEP.format(retry="'PENDING'", attempt="CASE WHEN kind = 'ok' THEN 'SENT' WHEN kind = 'fatal' OR attempts >= 4 THEN 'FAILED' ELSE 'PENDING' END", other='status')}, {_STEP.format(retry='0', attempt="attempts + CASE WHEN kind = 'ok' THEN 0 ELSE 1 END", other='attempts')}, {_STEP.format(retry='ignored', attempt='ignored', other='ignored + 1')}
            FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
        SELECT key, arg_max(status, n) AS status, CAST(arg_max(attempts, n) AS BIGINT) AS attempts, CAST(arg_max(ignored, n) AS BIGINT) AS ignored FROM s GROUP BY key""",
}
