"""Streams that need a key's events in order: held batches, suppression and incidents, with timers and state that ends.

Events wait in the state of their key's bucket until the watermark has passed them, and are then folded in order of time, key by key, so
that events which come out of order, or in other batches, give what the batch forms in `plans/ledger.py` give for the
same rows. What waits is bounded by the watermark's delay (held batches: and by how long they are held),
however many events a key has; what a fold keeps of a key ends when it can't matter any more: when its bucket is next
looked at, or by a timer. State is read and written by bucket, as lists of columns, since a call of Python for each
key would take longer than all of its events. Events without a time take no part, as in the batch forms.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lakeloom.plans import ledger
from lakeloom.plans.ledger import after_quiet
from lakeloom.streaming.alerts import BUCKETS, NO_TIME, _micros, bucket, drain, event_stream

LATE = "10 minutes"
#: The only kind of state store that keeps timers and lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EPOCH = dt.datetime(1970, 1, 1)
NEVER = 2**63 - 1
Row = tuple[int, int, int]  # time in microseconds, id, and a number


def _time(micros: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=micros)


def _passed(rows: list[Row], micros: int) -> int:
    """How many of sorted rows are not after a time."""
    return bisect_right(rows, micros, key=lambda r: r[0])


class InOrder(StatefulProcessor):
    """Keeps a bucket's rows (key, ts, id, number) until the watermark has passed them; `fold` gets those of a key in order, with what it kept of it."""

    #: Columns of the rows that come out, and of what is kept of a key.
    columns: tuple[str, ...]
    kept_columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key array<string>, ts array<long>, id array<long>, number array<long>")
        self.kept = handle.getValueState("kept", ", ".join(["key array<string>", *[f"{c} array<long>" for c in self.kept_columns]]))

    def wake(self, micros: int) -> None:
        """Call again once the watermark has passed a time."""
        self.handle.registerTimer(micros // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = [(frame["key"].tolist(), _micros(frame["ts"]), frame["id"].tolist(), frame["number"].tolist()) for frame in rows if len(frame)]
        if found:
            self.waiting.appendList(found)
            self.wake(self.due(min(min(times) for _, times, _, _ in found)))
        yield pd.DataFrame(columns=list(self.columns))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        by_key: dict[str | None, list[Row]] = {}
        for keys, *columns in self.waiting.get() if self.waiting.exists() else ():
            for k, row in zip(keys, zip(*columns, strict=True), strict=True):
                by_key.setdefault(k, []).append(row)
        names, *values = self.kept.get() if self.kept.exists() else ([],)
        kept = dict(zip(names, zip(*values, strict=True), strict=True)) if values else {}
        out, rest = [], []
        for k, rows in by_key.items():
            done, left, now = self.fold(k, sorted(rows), passed, kept.get(k))
            out += done
            rest += [(k, *row) for row in left]
            kept[k] = now
        kept = {k: now for k, now in kept.items() if now is not None and self.ends(now) > passed}
        if rest:
            self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
            self.wake(self.due(min(r[1] for r in rest)))
        else:
            self.waiting.clear()
        if kept:
            self.kept.update((list(kept), *map(list, zip(*kept.values(), strict=True))))
            if (last := max(map(self.ends, kept.values()))) < NEVER:
                self.wake(last + 1000)
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=list(self.columns)).astype(object)

    def fold(self, key: str | None, rows: list[Row], passed: int, now: tuple | None) -> tuple[list[tuple], list[Row], tuple | None]:
        """Rows that come out, rows that wait on, and what is kept."""
        raise NotImplementedError

    def ends(self, now: tuple) -> int:
        """When what is kept does not matter any more."""
        return NEVER

    def due(self, first: int) -> int:
        """When a row that waits can be folded, if none comes before it."""
        return first

    def close(self) -> None:
        pass


class Held(InOrder):
    """One message for all events of a key, once the oldest has waited and it is not a quiet time."""

    columns = ("key", "oldest", "sent", "n", "cents")

    def __init__(self, minutes: int, quiet: tuple[int, int] | None) -> None:
        self.minutes, self.quiet = minutes, quiet

    def due(self, first: int) -> int:
        sent = after_quiet(_time(first) + dt.timedelta(minutes=self.minutes), self.quiet)
        return (sent - _EPOCH) // dt.timedelta(microseconds=1)

    def fold(self, key: str | None, rows: list[Row], passed: int, now: tuple | None) -> tuple[list[tuple], list[Row], tuple | None]:
        out, at = [], 0
        while at < len(rows) and (sent := self.due(rows[at][0])) <= passed:
            end = _passed(rows, sent)
            out.append((key, _time(rows[at][0]), _time(sent), end - at, sum(r[2] for r in rows[at:end])))
            at = end
        return out, rows[at:], None


class Suppressed(InOrder):
    """Events of a key with no sent one in the time before. The last time sent goes when it no longer suppresses anything."""

    columns = ("key", "id")
    kept_columns = ("last",)

    def __init__(self, hours: float) -> None:
        self.step = round(hours * 3_600_000_000)

    def fold(self, key: str | None, rows: list[Row], passed: int, now: tuple | None) -> tuple[list[tuple], list[Row], tuple | None]:
        ready, out = _passed(rows, passed), []
        for ts, i, _ in rows[:ready]:
            if now is None or ts - now[0] >= self.step:
                out.append((key, i))
                now = (ts,)
        return out, rows[ready:], now

    def ends(self, now: tuple) -> int:
        return now[0] + self.step


class Incidents(InOrder):
    """Events fold into an incident until one resolves it. Each change of an incident gives a row, of which the last holds.

    `number` is 1 for an event that resolves. An incident is named by the event that opened it; a key has state
    while one is open, and none after.
    """

    columns = ("key", "first_id", "occurrences", "resolved", "last_id", "at")
    kept_columns = ("first_id", "occurrences", "last_id")

    def fold(self, key: str | None, rows: list[Row], passed: int, now: tuple | None) -> tuple[list[tuple], list[Row], tuple | None]:
        ready, out = _passed(rows, passed), []
        for ts, i, resolves in rows[:ready]:
            if now or not resolves:
                first, many, last = now or (i, 0, i)
                now = first, many + (not resolves), max(last, i)
                out.append((key, now[0], now[1], bool(resolves), now[2], _time(ts)))
            if resolves:
                now = None
        return out, rows[ready:], now


def _stateful(events: DataFrame, number, processor: StatefulProcessor, schema: str, late: str, buckets: int) -> DataFrame:
    """Rows of a processor. Keys are texts in its state, and ids that are null `NO_TIME`, as pandas has no null whole numbers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = events.filter("ts is not null").select("key", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("id").cast("long"), F.lit(NO_TIME)).alias("id"), F.coalesce(number.cast("long"), F.lit(0)).alias("number"))
    rows = timed.withWatermark("ts", late).select(bucket(F.col("key"), buckets), F.col("key").cast("string").alias("key"), "ts", "id", "number")
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, f"key string, {schema}", "append", "eventtime")
    ids = {c: F.nullif(F.col(c), F.lit(NO_TIME)) for c in found.columns if c in ("id", "first_id", "last_id")}
    return found.withColumns({"key": F.col("key").cast(events.schema["key"].dataType)} | ids)


def held(events: DataFrame, minutes: int, quiet: tuple[int, int] | None = None, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """Batches of a stream (key, id, ts, cents): key, oldest, sent, n, cents. Quiet hours are minutes of the local day."""
    return _stateful(events, F.col("cents"), Held(minutes, quiet), "oldest timestamp, sent timestamp, n long, cents long", late, buckets)


def suppressed(events: DataFrame, hours: float, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """Events of a stream (key, id, ts) that are sent: key, id."""
    return _stateful(events, F.lit(0), Suppressed(hours), "id long", late, buckets)


def incidents(events: DataFrame, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """Changes of incidents of a stream (key, id, ts, resolves): key, first_id, occurrences, resolved, last_id, at."""
    return _stateful(events, F.col("resolves").cast("int"), Incidents(), "first_id long, occurrences long, resolved boolean, last_id long, at timestamp", late, buckets)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each incident."""
    row = F.max(F.struct("resolved", "occurrences", "last_id")).alias("row")  # all of them only rise
    return changes.groupBy("key", "first_id").agg(row).select("key", "first_id", "row.*")


def _events(spark, sf_dir) -> DataFrame:
    return event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "event_type", (F.col("event_type") == "signup").alias("resolves"))


def _keyed(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumn("key", F.concat_ws("-", "event_type", F.col("key").cast("string")))


QUIET = 23 * 60, 7 * 60
_TIME = "yyyy-MM-dd HH:mm:ss"

QUERIES = {
    "stream_held_batches": lambda s, d: drain(held(_events(s, d), 90, QUIET)).select("key", *[F.date_format(c, _TIME).alias(c) for c in ("oldest", "sent")], "n", "cents"),
    "stream_suppress_expiring": lambda s, d: drain(suppressed(_keyed(s, d), 24)),
    "stream_incidents": lambda s, d: latest(drain(incidents(_events(s, d).filter("event_type in ('error', 'signup')")))),
}

#: What the watermark has passed once all events are read.
_PASSED = "(SELECT make_timestamp(1000 * (epoch_ms(max(ts)) - 600000)) FROM events {0})"
SQL = {
    "stream_held_batches": f"SELECT * FROM ({ledger.SQL['held_until_due']}) WHERE sent <= strftime({_PASSED.format('')}, '%Y-%m-%d %H:%M:%S')",
    "stream_suppress_expiring": f"SELECT key, id FROM ({ledger.SQL['suppress_alerts']}) JOIN events ON id = event_id WHERE ts <= {_PASSED.format('')}",
    "stream_incidents": f"""WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_type = 'signup' AS resolves FROM events WHERE event_type IN ('error', 'signup') AND ts <= {_PASSED.format("WHERE event_type IN ('error', 'signup')")}),
        i AS (SELECT *, coalesce(sum(CAST(resolves AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e)
        SELECT key, arg_min(id, (ts, id)) FILTER (WHERE NOT resolves) AS first_id, bool_or(resolves) AS resolved, count(*) FILTER (WHERE NOT resolves) AS occurrences, max(id) AS last_id FROM i GROUP BY key, n HAVING count(*) FILTER (WHERE NOT resolves) > 0""",
}
