"""Sources: CSV and spreadsheet files, JSON bodies of APIs, nested orders, video records."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.functions.columns import iso_seconds, strip_tags
from lakeloom.session import shared_folder
from lakeloom.sources.domain import view, with_views


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts, header names cleaned, columns without a name dropped, blank rows dropped, short rows filled with ''."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True)
    names = {c: c.replace("﻿", "").strip() for c in raw.columns}
    kept = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in names.items() if n and not n.startswith("_c")]
    rows = raw.select(*kept)
    return rows.filter(F.concat(*[F.trim(c) for c in rows.columns]) != "") if rows.columns else rows


def json_rows(bodies: DataFrame, path: str, fields: list[str], column: str = "body") -> DataFrame:
    """One row for each element of the array at a dotted path of JSON bodies: the fields as texts without tags, and the number in the body."""
    elements = F.from_json(F.get_json_object(column, f"$.{path}"), "array<map<string,string>>")
    found = bodies.select(*[c for c in bodies.columns if c != column], F.posexplode(elements).alias("position", "row"))
    return found.select(*[c for c in found.columns if c != "row"], *[strip_tags(F.try_element_at("row", F.lit(f))).alias(f) for f in fields])


#: How deep a body is searched for an array of records.
DEEPEST = 5


def _first_records(node, depth: int = 0) -> list | None:
    """The first array, in document order and up to DEEPEST levels down, whose first element is an object."""
    if depth > DEEPEST or not isinstance(node, (list, dict)):
        return None
    if isinstance(node, list) and node and isinstance(node[0], dict):
        return node
    children = node.values() if isinstance(node, dict) else node
    return next((found for child in children if (found := _first_records(child, depth + 1)) is not None), None)


@F.pandas_udf(StringType())
def _searched(bodies: pd.Series) -> pd.Series:
    def one(body: str | None) -> str | None:
        try:
            found = _first_records(json.loads(body)) if body else None
        except (ValueError, RecursionError):  # no JSON, as where a login page comes back
            return None
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return bodies.map(one)


def response_rows(bodies: DataFrame, paths: Sequence[str], fields: Sequence[str], column: str = "body", wrapper: str | None = "cell", tags: bool = True) -> DataFrame:
    """One row for each record of bodies whose shape is not known for sure: the fields as texts, and the number in the body.

    The records are the first array that stands at one of the dotted `paths` (of several paths, one that holds something); where none does,
    the first array of objects up to five levels down. A record in a `wrapper` object is taken out of it. Elements that are no
    objects or hold nothing keep their number but give no row; bodies that are no JSON give none. Nulls and absent fields are ''; with `tags`,
    markup is taken out. Only bodies without an array at a known place go to Python.
    """
    known = [F.get_json_object(column, f"$.{p}") for p in paths]
    # A path's array counts if it is one, and of several paths only if it is not empty.
    sizes = [F.json_array_length(k) for k in known]
    at_path = F.coalesce(F.lit(None).cast("string"), *[F.when(n >= (1 if len(known) > 1 else 0), k) for k, n in zip(known, sizes, strict=True)])
    others = [c for c in bodies.columns if c != column]
    told = bodies.select(*others, F.explode(F.array(F.struct(F.col(column).alias("body"), at_path.alias("at")))).alias("__b"))
    records = F.coalesce("__b.at", _searched(F.when(F.col("__b.at").isNull(), F.col("__b.body"))))
    each = told.select(*others, F.posexplode(F.from_json(records, "array<string>")).alias("position", "__e"))
    record = F.from_json("__e", "map<string,string>")
    each = each.select(*others, "position", F.explode(F.array(record)).alias("__r"))
    if wrapper:
        inner = F.when(F.map_contains_key("__r", F.lit(wrapper)), F.from_json(F.try_element_at("__r", F.lit(wrapper)), "map<string,string>")).otherwise(F.col("__r"))
        each = each.select(*others, "position", F.explode(F.array(inner)).alias("__r"))
    value = lambda f: F.coalesce(F.try_element_at("__r", F.lit(f)), F.lit(""))
    return each.filter(F.size("__r") > 0).select(*others, "position", *[(strip_tags(value(f)) if tags else F.trim(value(f))).alias(f) for f in fields])


def truncated(bodies: DataFrame, path: str, total: str, column: str = "body") -> DataFrame:
    """Bodies that announce more records than they hold."""
    held = F.json_array_length(F.get_json_object(column, f"$.{path}"))
    announced = F.get_json_object(column, f"$.{total}").try_cast("bigint")
    return bodies.withColumns({"announced": announced, "held": held.cast("bigint")}).filter(F.col("announced") > F.col("held")).drop(column)


ORDER_PAGE = "struct<code:int,nextToken:string,data:array<struct<orderId:bigint,orderedAt:string,status:string,totalPaidAmount:bigint,orderItems:array<struct<vendorItemId:bigint,shippingCount:int,orderPrice:bigint>>>>>"


def order_lines(pages: DataFrame, column: str = "body") -> DataFrame:
    """Lines of nested order pages, with their header. Orders without items fall away; local times become UTC."""
    orders = pages.select(F.explode(F.from_json(column, ORDER_PAGE)["data"]).alias("o")).select("o.*")
    lines = orders.select("orderId", "orderedAt", "status", "totalPaidAmount", F.posexplode("orderItems").alias("line", "item"))
    at = F.to_utc_timestamp(F.to_timestamp(F.regexp_replace("orderedAt", "T", " ")), "Asia/Seoul")
    return lines.select(F.col("orderId").alias("order_no"), (F.col("line") + 1).alias("line_no"), at.alias("ordered_at"), "status", F.col("totalPaidAmount").alias("total"), F.col("item.vendorItemId").alias("item"), F.col("item.shippingCount").alias("quantity"), F.col("item.orderPrice").alias("amount"))


def video_rows(items: DataFrame, column: str = "body") -> DataFrame:
    """Flat rows of video records: length in seconds, counts (0 if absent), whether comments are off, epoch for a missing time."""
    get = lambda p: F.get_json_object(column, f"$.{p}")
    count = lambda p: F.coalesce(get(f"statistics.{p}").try_cast("bigint"), F.lit(0).cast("bigint"))
    return items.select(
        get("id").alias("video_id"), iso_seconds(get("contentDetails.duration")).alias("seconds"), count("viewCount").alias("views"), count("commentCount").alias("comments"),
        get("statistics.commentCount").isNull().alias("comments_off"), F.coalesce(F.try_to_timestamp(get("snippet.publishedAt")), F.timestamp_seconds(F.lit(0))).alias("published_at"),
    )


def _pages(spark, sf_dir) -> DataFrame:
    """Order pages as an API would send them: 20 orders a page, made from the order tables."""
    heads, lines = view(spark, sf_dir, "order_head"), view(spark, sf_dir, "order_line")
    items = lines.groupBy(F.col("order_no").alias("orderId")).agg(F.sort_array(F.collect_list(F.struct(F.col("item").alias("vendorItemId"), F.col("quantity").alias("shippingCount"), F.col("amount").alias("orderPrice")))).alias("orderItems"))
    orders = heads.select(F.col("order_no").alias("orderId"), F.date_format(F.col("ordered_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("orderedAt"), "status", F.col("amount").alias("totalPaidAmount")).join(items, "orderId", "left")
    page = F.struct(F.lit(200).alias("code"), F.lit("").alias("nextToken"), F.collect_list(F.struct("orderId", "orderedAt", "status", "totalPaidAmount", F.coalesce("orderItems", F.array().cast("array<struct<vendorItemId:bigint,shippingCount:bigint,orderPrice:bigint>>")).alias("orderItems"))).alias("data"))
    return orders.groupBy((F.col("orderId") / 100).cast("bigint").alias("page")).agg(F.to_json(page).alias("body"))


def _grid(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    cells = F.struct(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("<b>"), "p_name", F.lit("</b> ")).alias("product_name"), F.col("p_size").cast("string").alias("stock"))
    body = F.to_json(F.struct((F.count(F.lit(1)) + F.first(F.when(F.col("p_brand") == "Brand#7", 5).otherwise(0))).alias("records"), F.struct(F.collect_list(cells).alias("rows")).alias("result")))
    return rows.groupBy("p_brand", (F.col("p_partkey") / 500).cast("bigint").alias("page")).agg(body.alias("body"))


def _shaped(spark, sf_dir) -> DataFrame:
    """Parts of each brand in one of five shapes: at the expected path, somewhere below, each in a `cell`, as the whole body, and not at all."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    part = F.struct(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("<b>"), "p_name", F.lit("</b> ")).alias("product_name"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("stock"))
    shape = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 5
    plain, wrapped = F.collect_list(part), F.collect_list(F.struct(F.col("p_partkey").alias("id"), part.alias("cell")))
    body = (
        F.when(F.col("shape") == 0, F.to_json(F.struct(F.struct(plain.alias("rows")).alias("result"))))
        .when(F.col("shape") == 1, F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("sizes"), F.struct(F.struct(F.struct(plain.alias("list")).alias("page")).alias("data")).alias("answer"))))
        .when(F.col("shape") == 2, F.to_json(F.struct(F.lit("{}").alias("result"), F.struct(wrapped.alias("grid")).alias("view"))))
        .when(F.col("shape") == 3, F.to_json(plain))
        .otherwise(F.lit("<html>log in</html>"))
    )
    return rows.withColumn("shape", shape).groupBy("p_brand", "shape", (F.col("p_partkey") / 500).cast("bigint").alias("page")).agg(body.alias("body"))


def _csv(spark, sf_dir) -> DataFrame:
    """Parts written as CSV with an empty row and a nameless column, and read back."""
    path = shared_folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    blank = F.col("p_partkey") % 50 == 0
    out = part.select(*[F.when(~blank, F.col(c).cast("string")).alias(f" {c} ") for c in ("p_partkey", "p_name", "p_size")], F.lit(None).cast("string").alias(" "))
    out.write.csv(path, header=True)
    return read_csv(spark, path)


def _videos(spark, sf_dir) -> DataFrame:
    v = view(spark, sf_dir, "video")
    stats = F.when(F.col("video_id") % 10 != 0, F.struct(F.col("views").cast("string").alias("viewCount"), F.col("duration_seconds").cast("string").alias("commentCount"))).otherwise(F.struct(F.col("views").cast("string").alias("viewCount"), F.lit(None).cast("string").alias("commentCount")))
    d = F.col("duration_seconds")
    length = F.concat(F.lit("PT"), F.floor(d / 60).cast("string"), F.lit("M"), (d % 60).cast("string"), F.lit("S"))
    body = F.to_json(F.struct(F.col("video_id").cast("string").alias("id"), F.struct(length.alias("duration")).alias("contentDetails"), stats.alias("statistics"), F.struct(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("publishedAt")).alias("snippet")))
    return v.select(body.alias("body"))


QUERIES = {
    "csv_scan": _csv,
    "json_rows": lambda s, d: json_rows(_grid(s, d), "result.rows", ["key", "product_name", "stock"]).drop("position", "page"),
    "json_rows_found": lambda s, d: response_rows(_shaped(s, d), ["result.rows"], ["key", "product_name", "stock"]).drop("position", "page"),
    "json_truncated": lambda s, d: truncated(_grid(s, d), "result.rows", "records"),
    "nested_orders": lambda s, d: order_lines(_pages(s, d)).select("order_no", F.date_format("ordered_at", "yyyy-MM-dd HH:mm").alias("ordered_at"), "status", "total", "item", F.col("quantity").cast("bigint").alias("quantity"), "amount"),
    "video_records": lambda s, d: video_rows(_videos(s, d)).select("video_id", "seconds", "views", "comments", "comments_off", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at")),
}

SQL = {
    "csv_scan": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE p_partkey % 50 <> 0",
    "json_rows": "SELECT p_brand, CAST(p_partkey AS VARCHAR) AS key, p_name AS product_name, CAST(p_size AS VARCHAR) AS stock FROM part",
    "json_rows_found": "SELECT p_brand, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 AS shape, CAST(p_partkey AS VARCHAR) AS key, p_name AS product_name, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS stock FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 < 4",
    "json_truncated": "SELECT p_brand, p_partkey // 500 AS page, count(*) + 5 AS announced, count(*) AS held FROM part WHERE p_brand = 'Brand#7' GROUP BY ALL",
    "nested_orders": f"{with_views('order_head', 'order_line')} SELECT order_no, strftime(ordered_at - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS ordered_at, status, h.amount AS total, item, quantity, l.amount FROM order_head h JOIN order_line l USING (order_no)",
    "video_records": f"{with_views('video')} SELECT CAST(video_id AS VARCHAR) AS video_id, duration_seconds AS seconds, views, CASE WHEN video_id % 10 <> 0 THEN duration_seconds ELSE 0 END AS comments, video_id % 10 = 0 AS comments_off, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM video",
}
