"""Streams of events: once-only ingestion, local-day windows, alert suppression, sliding look-backs.

Each function takes a streaming DataFrame and returns one; `drain` runs a stream over all that
its source holds now and returns the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.functions.columns import KST_HOURS
from lakeloom.session import shared_folder
from lakeloom.sources.domain import with_views

LATE = "10 minutes"
#: Buckets that keys are dealt to (a checkpoint is of one number), and what pandas has for no time.
BUCKETS, NO_TIME = 1024, -(2**63)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; `ts` is a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as a stream's source must be a folder or a pattern; it matches a file and a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def once_only(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Each key once, however often its event is read again within the watermark (an overlapping re-read)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def local_days(events: DataFrame, late: str = LATE) -> DataFrame:
    """Counts and sums by local day (midnight is 15:00 UTC of the day before) and type."""
    day = F.window("ts", "1 day", startTime=f"{24 - KST_HOURS} hours")
    return events.withWatermark("ts", late).groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def look_back(events: DataFrame, width: str = "7 days", step: str = "1 day", late: str = LATE) -> DataFrame:
    """Events of the last days at every step."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def _micros(times: pd.Series) -> list[int]:
    """Whole microseconds; `NO_TIME` for none."""
    return times.to_numpy("datetime64[us]").astype("int64").tolist()


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key. A call of Python for each key takes milliseconds, so keys share their state by bucket."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def suppress(events: DataFrame, key: str, hours: float, buckets: int = BUCKETS) -> DataFrame:
    """Events that are sent: those with no sent event of their key in the hours before. The state is each key's last time sent.

    Keys are folded by bucket: a batch writes the state of the buckets that it has events of.
    """
    step = round(hours * 3_600_000_000)

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        sent = dict(zip(*state.get, strict=True)) if state.exists else {}
        keep = []
        for k, ts in zip(rows["key"], _micros(rows["ts"]), strict=True):
            last = sent.get(k)
            free = last is None or (NO_TIME not in (ts, last) and ts - last >= step)
            keep.append(free)
            if free:
                sent[k] = ts
        state.update((list(sent), list(sent.values())))
        yield pd.DataFrame({"key": rows["key"][keep], "id": rows["event_id"][keep]})

    rows = events.select(F.col(key).cast("string").alias("key"), "ts", "event_id", bucket(F.col(key), buckets))
    return rows.groupBy("bucket").applyInPandasWithState(fold, "key string, id long", "key array<string>, last array<long>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append", change: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a stream over what its source holds, into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    place = shared_folder(spark)
    path = f"{place}/table"

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces what it had written.
        change(batch).write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    found = spark.read.parquet(path)
    return found.drop("batch") if mode != "complete" else found


def _keyed(spark, sf_dir) -> DataFrame:
    return event_stream(spark, sf_dir).withColumn("alert_key", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))


def _reread(spark, sf_dir) -> DataFrame:
    """Every event read twice, as an overlapping collection does."""
    events = event_stream(spark, sf_dir)
    return events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))


def _start(c: str = "w") -> list:
    return [F.date_format(F.col(f"{c}.start"), "yyyy-MM-dd HH:mm").alias("start")]


QUERIES = {
    "stream_once_only": lambda s, d: drain(once_only(_reread(s, d), ["event_id"]).select("event_id", "user_id")),
    "stream_local_days": lambda s, d: drain(local_days(event_stream(s, d)).select(*_start(), "event_type", "n", "cents"), "complete"),
    "stream_look_back": lambda s, d: drain(look_back(event_stream(s, d)).select(*_start(), "n"), "complete"),
    "stream_suppress": lambda s, d: drain(suppress(_keyed(s, d), "alert_key", 24)),
}

SQL = {
    "stream_once_only": "SELECT event_id, user_id FROM events",
    "stream_local_days": "SELECT strftime(date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "stream_look_back": "SELECT strftime(day, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest(list_transform(range(0, 7), lambda k: date_trunc('day', ts) - to_days(CAST(k AS INTEGER)))) AS day FROM events) GROUP BY 1",
    "stream_suppress": f"""{with_views('alert').replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT alert_key AS key, event_id AS id, ts FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY ts, event_id) AS n FROM alert) WHERE n = 1
        UNION ALL SELECT key, id, ts FROM (SELECT s.key, a.event_id AS id, a.ts, row_number() OVER (PARTITION BY s.key ORDER BY a.ts, a.event_id) AS n FROM s JOIN alert a ON a.alert_key = s.key AND a.ts >= s.ts + INTERVAL 24 HOUR) WHERE n = 1) SELECT key, id FROM s""",
}
