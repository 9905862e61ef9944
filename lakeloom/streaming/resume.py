"""Collections that go on where the last whole success ended, and a dimension that comes late.

`collect` reads a stream into a place of its own. Spark's checkpoint there names what each batch reads
before it runs; a batch's rows are written first and its line in the table of commits last, in one
file. So a batch that fails anywhere is read again as a whole by the next call and replaces what it
had written, a call that finds nothing new does nothing, and `committed` never shows half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import cut_lineage, shared_folder
from lakeloom.streaming.alerts import event_stream

COMMITS = "batch long, rows long, latest timestamp"


def collect(stream: DataFrame, place: str, check: Callable[[DataFrame, int], None] = lambda rows, batch: None, time: str = "ts") -> int:
    """Read what is new into `place`; how many batches that took. `check` may refuse a batch by raising, and the cursor stays before it."""
    done = []

    def put(rows: DataFrame, batch: int) -> None:
        path = f"{place}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
        check(kept, batch)
        commit = kept.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(time).cast("timestamp")).alias("latest")).select(F.lit(batch).cast("long").alias("batch"), "rows", "latest")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{place}/commits/{batch}")
        done.append(batch)

    query = stream.writeStream.option("checkpointLocation", f"{place}/cursor").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return len(done)


def commits(spark: SparkSession, place: str) -> DataFrame:
    """One row for each batch that succeeded: its number, its rows, and its latest time, which is as far as the cursor is."""
    return spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{place}/commits")


def committed(spark: SparkSession, place: str) -> DataFrame:
    """All rows of batches that succeeded."""
    rows = spark.read.parquet(f"{place}/rows")
    return rows.join(commits(spark, place).select("batch"), "batch", "left_semi").drop("batch")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing is written yet
        return spark.createDataFrame([], schema)


def match_late(lines: DataFrame, mappings: DataFrame, place: str, line: list[str], on: str, value: str) -> DataFrame:
    """Two streams: lines, and mappings (`on` to `value`) that may come after the lines they are for. Every line gets its value once.

    A line's batch looks its mapping up among those stored; without one the line waits in a table. A batch of
    mappings is stored and then given to the lines that wait and have no value yet. A batch writes folders
    of its own number and leaves out what other batches have done, not what it did itself, so a batch that is
    run again changes nothing. `line` names the columns that tell lines apart.
    """
    spark, names = lines.sparkSession, lines.columns
    typed = lambda df, *columns: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    all_mappings = lambda: _stored(spark, f"{place}/mappings", f"{typed(mappings, on, value)}, batch long")
    waiting = lambda: _stored(spark, f"{place}/waiting", f"{typed(lines, *names)}, batch long")
    applied = lambda: _stored(spark, f"{place}/applied", f"{typed(lines, *names)}, {typed(mappings, value)}, source string, batch long")
    one = lambda m: m.filter(F.col(value).isNotNull()).groupBy(on).agg(F.min(value).alias(value))

    def write(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/{folder}")

    def line_batch(rows: DataFrame, number: int) -> None:
        earlier = waiting().select(*line, "batch").union(applied().filter("source = 'lines'").select(*line, "batch")).filter(F.col("batch") != number)
        new = rows.dropDuplicates(line).join(earlier, line, "left_anti")
        late = applied().filter("source = 'mappings'").select(*line, F.lit(True).alias("__late")).distinct()
        found = cut_lineage(new.join(one(all_mappings()), on, "left").join(late, line, "left"))
        mine = F.col(value).isNotNull() & F.col("__late").isNull()
        write(found.filter(~mine).select(*names), f"waiting/batch={number}")
        write(found.filter(mine).select(*names, value), f"applied/source=lines/batch={number}")

    def mapping_batch(rows: DataFrame, number: int) -> None:
        write(rows.select(on, value), f"mappings/batch={number}")
        others = applied().filter(~((F.col("source") == "mappings") & (F.col("batch") == number)))
        left = waiting().dropDuplicates(line).join(others, line, "left_anti")
        write(cut_lineage(left.join(one(all_mappings().filter(F.col("batch") == number)), on).select(*names, value)), f"applied/source=mappings/batch={number}")

    for stream, put, name in ((lines, line_batch, "lines"), (mappings, mapping_batch, "mappings")):
        stream.writeStream.option("checkpointLocation", f"{place}/cursor/{name}").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return applied().select(*names, value)


def _collected(spark, sf_dir) -> DataFrame:
    place = shared_folder(spark)
    for _ in range(2):  # the second call finds nothing new
        collect(event_stream(spark, sf_dir), place)
    return committed(spark, place).select("event_id", "user_id", "event_type")


def _late(spark, sf_dir) -> DataFrame:
    source = lambda name: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parquet*")
    lines = source("lineitem").select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item"))
    mappings = source("part").filter("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("item"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"))
    return match_late(lines, mappings, shared_folder(spark), ["order_no", "line_no", "item"], "item", "sku")


QUERIES = {"stream_cursor_resume": _collected, "stream_late_mapping": _late}

SQL = {
    "stream_cursor_resume": "SELECT event_id, user_id, event_type FROM events",
    "stream_late_mapping": "SELECT DISTINCT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS item, 'SKU-' || p_partkey AS sku FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 17 <> 0",
}
