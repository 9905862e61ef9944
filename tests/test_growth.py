"""Steps whose time or memory must not grow faster than their input."""

import datetime as dt

from pyspark import TaskContext
from pyspark.sql import functions as F

from lakeloom.functions.columns import title_words
from lakeloom.operators.names import greedy_pairs
from lakeloom.operators.runs import HANDLE, TOGETHER, Script, scripted
from lakeloom.operators.reconcile import unmatched_named
from lakeloom.plans.trends import growth, keyword_counts
from lakeloom.streaming import ordered
from lakeloom.streaming.alerts import drain, suppress


def titles(spark, n=200):
    at = F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 14).cast("int"))
    return spark.range(n).select(at.alias("published_at"), F.array(F.lit("food")).alias("categories"), F.concat(F.lit("soup "), F.col("id").cast("string"), F.lit("x")).alias("title")).coalesce(1)


def test_titles_of_one_row_group_are_shared_out(spark):
    place = F.udf(lambda t: [f"task {TaskContext.get().partitionId()}"], "array<string>")
    found = keyword_counts(titles(spark), 1, place)
    assert found.select("keyword").distinct().count() > 1


def test_growth_makes_its_counts_once(spark):
    grown = growth(keyword_counts(titles(spark)))
    assert grown._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    got = {(r.week.day, r.category): (r.frequency, r.previous, r.is_new) for r in grown.filter("keyword = 'soup'").collect()}
    assert got == {(1, "_all"): (102, 0, True), (1, "food"): (102, 0, True), (8, "_all"): (98, 102, False), (8, "food"): (98, 102, False)}


def test_growth_over_a_gap_and_without_a_category(spark):
    rows = [(dt.date(2024, 1, d), c, "w", n) for d, c, n in ((1, "a", 4), (15, "a", 6), (1, None, 2), (8, None, 3))]
    grown = growth(spark.createDataFrame(rows, "week date, category string, keyword string, frequency long"))
    assert {(r.week.day, r.category): r.previous for r in grown.collect()} == {(1, "a"): 0, (15, "a"): 0, (1, None): 0, (8, None): 0}


def test_words_at_digits(spark):
    text = "12ab 345 a1 7ㅋ 1234567890123a 1234567890abc" + " " + "9" * 50_000 + " 가나다라마바사아자차카타에서부터 가나다라마바사아자차카타파에서"
    got = spark.createDataFrame([(text,)], "t string").select(title_words(F.col("t"))).first()[0]
    assert got == ["12ab", "a1", "7ㅋ", "가나다라마바사아자차카타"]


def test_stream_state_is_by_bucket_not_by_key(spark, tmp_path):
    """Many keys share few states; null keys, ids and times stay apart from them."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k, i * 1000 + k, start + dt.timedelta(hours=i)) for k in range(300) for i in range(3)] + [(None, None, start), (7, None, None), (2**60 + 1, 2**60 + 3, start)]
    place = str(tmp_path / "in")
    spark.createDataFrame(rows, "key long, id long, ts timestamp").coalesce(1).write.parquet(place)
    spark.createDataFrame([(-1, -1, start + dt.timedelta(days=9))], "key long, id long, ts timestamp").coalesce(1).write.mode("append").parquet(place)
    stream = spark.readStream.schema("key long, id long, ts timestamp").parquet(place)
    wanted = {(k, i * 1000 + k) for k in range(300) for i in (0, 2)} | {(None, None), (2**60 + 1, 2**60 + 3)}
    seen = []

    def put(batch, number):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    query = ordered.suppressed(stream, 2, buckets=8).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    seen = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {(r.key, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got - {(-1, -1)} == wanted
    assert max(seen) < 100  # of 303 keys


def test_plain_suppression_shares_state_over_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    place = str(tmp_path / "in")
    schema = "key string, event_id long, ts timestamp"
    for hour in (0, 1, 2):
        spark.createDataFrame([(None if k == 50 else f"k{k}", hour * 100 + k, start + dt.timedelta(hours=hour)) for k in range(51)], schema).coalesce(1).write.mode("append").parquet(place)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
    got = {(r.key, r.id) for r in drain(suppress(stream, "key", 2, buckets=4)).collect()}
    assert got == {(None if k == 50 else f"k{k}", hour * 100 + k) for k in range(51) for hour in (0, 2)}


def test_scripts_take_several_chunks_in_a_call_and_see_them_apart(spark):
    sizes = lambda t: t.assign(size=len(t))[[HANDLE, "size"]]
    rows = spark.range(2_300).select(F.col("id").alias("row_number"), F.lit(0).cast("long").alias("size"))
    done = scripted(rows, [Script("sizes", sizes)])
    assert [tuple(r) for r in done.groupBy("size").count().orderBy("size").collect()] == [(300, 300), (500, 2000)]
    plan = done._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas" in plan and f"/ cast({TOGETHER} as " in plan


def test_a_script_changes_all_rows_of_a_number(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "row_number long, name string")
    done = scripted(rows, [Script("x", lambda t: t[t["name"] != "c"].assign(name="x")[[HANDLE, "name"]])])
    assert sorted((r.row_number, r.name, r.script_error) for r in done.collect()) == [(1, "x", None), (1, "x", None), (2, "c", None)]


def test_small_units_are_paired_without_python_and_null_names_once(spark):
    """A call of Python for each unit costs more than the unit's pairs; extra columns and null names stay as they are."""
    rows = [(1, None, "x", 0.5, "a"), (1, None, "y", 0.9, "b"), (1, "p", None, 0.1, "c"), (1, "q", None, 0.2, "d"), (None, "l", "r", 0.0, "e"), (None, "l", "s", None, "f")]
    paired = greedy_pairs(spark.createDataFrame(rows, "unit_id int, left_name string, right_name string, score double, note string"))
    assert "InPandas" not in paired._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in paired.collect()} == {rows[1], rows[3], rows[5]}


def test_only_loose_rows_are_sorted_for_their_names(spark):
    """Rows of units' items are gone before the sort that a greatest name needs."""
    rows = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 3), ("a", 2, None, 4), ("b", 1, None, 5), (None, 1, "z", 6)], "source string, item_ref long, item string, quantity long")
    members = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "source string, item_ref long, confirmed boolean")
    found = unmatched_named(rows, members, "item")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert 0 <= plan.find("Aggregate") < plan.find("ShuffledHashJoin")
    assert {tuple(r) for r in found.collect()} == {("a", 2, "y", 7), ("b", 1, "", 5), (None, 1, "z", 6)}
