"""The commerce domain's tables, derived from the raw tables by SQL that Spark and DuckDB both read.

One text defines each table, so a query and the SQL that checks it start from the same rows.
Texts name other tables in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import table

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    "order_head": """SELECT o_orderkey AS order_no, o_orderpriority AS channel, o_custkey AS customer, o_orderdate AS ordered_at,
        CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE o_orderstatus WHEN 'P' THEN 'PLACED' WHEN 'O' THEN 'CANCELLED' ELSE 'RETURNED' END AS status FROM {orders}""",
    "order_line": """SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS item, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey END AS sku_id,
        CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_shipdate AS shipped_at FROM {lineitem}""",
    "sku": """SELECT p_partkey AS sku_id, concat('SKU-', CAST(p_partkey AS STRING)) AS code, p_name AS name, p_brand AS brand,
        (p_partkey * 7) % 60 AS quantity, p_size AS safety_threshold, p_partkey % 10 <> 0 AS active FROM {part}""",
    "movement": """SELECT l_partkey AS sku_id, -CAST(l_quantity AS BIGINT) AS delta, CASE l_returnflag WHEN 'R' THEN 'CANCEL_RESTORE' ELSE 'SALE' END AS reason,
        l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS movement_id FROM {lineitem}
        UNION ALL SELECT p_partkey, 500 + p_size, 'INITIAL', TIMESTAMP '1990-01-01 00:00:00', -p_partkey - 1 FROM {part}""",
    "snapshot": """SELECT CASE l_linestatus WHEN 'O' THEN 'erp' ELSE 'wms' END AS source, date_trunc('year', l_shipdate) AS base_at, l_partkey AS item_ref,
        CAST(l_suppkey % 5 AS STRING) AS warehouse_code, l_returnflag AS lot_code, CAST(sum(l_quantity) AS BIGINT) AS quantity, max(l_shipdate) AS expiry_date
        FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "member": """SELECT p_partkey AS item_ref, s.source, p_partkey % 200 AS unit_id, CASE WHEN p_partkey % 5 = 0 THEN 12 ELSE 1 END AS factor, p_partkey % 13 <> 0 AS confirmed
        FROM {part} CROSS JOIN (SELECT 'erp' AS source UNION ALL SELECT 'wms' AS source) AS s WHERE p_partkey % 11 <> 0""",
    "video": """SELECT event_id AS video_id, user_id AS channel_id, ts AS published_at, 20 + event_id % 300 AS duration_seconds, CAST(round(value * 1000) AS BIGINT) AS views,
        CAST(round(value * 1000) AS BIGINT) * (event_id % 7) / 100 AS likes, CAST(round(value * 1000) AS BIGINT) * (event_id % 5) / 200 AS comments, event_id % 9 = 0 AS paid FROM {events}""",
    "channel": """SELECT channel_id, 1000 + (channel_id * 7919) % 200000 AS subscribers, CASE channel_id % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'camp' ELSE 'toys' END AS category,
        channel_id % 29 = 0 AS excluded FROM (SELECT DISTINCT user_id AS channel_id FROM {events}) AS u""",
    "title": """SELECT doc_id AS title_id, doc_id % 40 AS channel_id, text AS title, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 21) * INTERVAL '1' DAY AS published_at FROM {documents}""",
    "alert": """SELECT event_id, concat(event_type, '-', CAST(user_id AS STRING)) AS alert_key, event_type, user_id, ts, value FROM {events}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the files in `sf_dir`."""
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in _needs(name)})


def with_views(*names: str) -> str:
    """The same tables as common table expressions, for DuckDB. Integer division is Spark's `/` on whole numbers there."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names)
