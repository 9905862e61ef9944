"""Filters as data: rows of (field, operator, values) that become Spark columns.

A filter is a tree: a `Condition`, or `All`, `Any`, `Not` over others. Fields are typed; an
operator that does not fit its field's type, a wrong number of values, or a value that does
not read as the type is refused before a plan is built. Filters have no text form here: plain Python
values state them, and Catalyst does the rest (pushdown to the scan included).

Null values follow SQL's three-valued logic: a row whose field is null is in neither IN nor
NOT IN. Emptiness is defined for texts as null or '', for other types as null.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.columns import compiles, relative_date
from lakeloom.sources.domain import view, with_views

TEXT, NUMBER, DATE, BOOL = "TEXT", "NUMBER", "DATE", "BOOL"

#: The fields of a stock snapshot and their types.
FIELDS = {
    "source": TEXT, "item_ref": NUMBER, "warehouse_code": TEXT, "lot_code": TEXT, "quantity": NUMBER, "base_quantity": NUMBER, "base_unit": TEXT, "raw_item_name": TEXT,
    "quality_status": TEXT, "expiry_date": DATE, "manufacture_date": DATE, "base_at": DATE, "product_key": TEXT, "name": TEXT, "brand": TEXT, "code": TEXT, "safety_threshold": NUMBER, "active": BOOL,
    "warehouse_name": TEXT, "location_code": TEXT, "zone_code": TEXT, "unit": TEXT, "serial_no": TEXT, "normalized_name": TEXT, "currency": TEXT,
    "available_quantity": NUMBER, "reserved_quantity": NUMBER, "defective_quantity": NUMBER, "incoming_quantity": NUMBER, "outgoing_quantity": NUMBER, "unit_cost": NUMBER, "amount": NUMBER,
}

#: What the fields of a stock snapshot are called where people pick them.
LABELS = {
    "warehouse_code": "창고", "warehouse_name": "창고명", "lot_code": "로트", "location_code": "로케이션", "zone_code": "구역", "quality_status": "품질상태", "unit": "단위", "base_unit": "기준단위",
    "serial_no": "일련번호", "raw_item_name": "원본품명", "normalized_name": "다듬은품명", "item_ref": "품목코드", "currency": "통화", "expiry_date": "유통기한", "manufacture_date": "제조일", "quantity": "원본수량",
    "base_quantity": "기준수량", "available_quantity": "가용수량", "reserved_quantity": "할당수량", "defective_quantity": "불량수량", "incoming_quantity": "입고예정", "outgoing_quantity": "출고예정", "unit_cost": "단가", "amount": "금액",
}

#: Operators with the types they are for and their least and greatest number of values.
OPERATORS = {
    "IN": ((TEXT, NUMBER), 1, 1000), "NOT_IN": ((TEXT, NUMBER), 1, 1000), "EQ": ((TEXT, NUMBER, DATE), 1, 1), "NE": ((TEXT, NUMBER, DATE), 1, 1),
    "GT": ((NUMBER, DATE), 1, 1), "GTE": ((NUMBER, DATE), 1, 1), "LT": ((NUMBER, DATE), 1, 1), "LTE": ((NUMBER, DATE), 1, 1),
    "BETWEEN": ((NUMBER, DATE), 2, 2), "NOT_BETWEEN": ((NUMBER, DATE), 2, 2), "CONTAINS": ((TEXT,), 1, 1), "NOT_CONTAINS": ((TEXT,), 1, 1), "STARTS_WITH": ((TEXT,), 1, 1), "ENDS_WITH": ((TEXT,), 1, 1),
    "MATCHES": ((TEXT,), 1, 1), "IS_EMPTY": ((TEXT, NUMBER, DATE, BOOL), 0, 0), "IS_NOT_EMPTY": ((TEXT, NUMBER, DATE, BOOL), 0, 0), "IS_TRUE": ((BOOL,), 0, 0), "IS_FALSE": ((BOOL,), 0, 0),
}


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    values: tuple = ()

    def column(self, today: dt.date) -> Column:
        kind = field_type(self.field)
        kinds, low, high = OPERATORS.get(self.operator, ((), 0, -1))
        if kind not in kinds or not low <= len(self.values) <= high:
            raise ValueError(f"{self.operator} does not fit {self.field} with {len(self.values)} values")
        c = F.get_json_object("attributes", f"$.{self.field.removeprefix('attributes.')}") if self.field.startswith("attributes.") else F.col(self.field)
        v = [_value(kind, x, today) for x in self.values]
        match self.operator:
            case "IN":
                return c.isin(*v)
            case "NOT_IN":
                return ~c.isin(*v)
            case "EQ":
                return c == v[0]
            case "NE":
                return c != v[0]
            case "GT":
                return c > v[0]
            case "GTE":
                return c >= v[0]
            case "LT":
                return c < v[0]
            case "LTE":
                return c <= v[0]
            case "BETWEEN":
                return c.between(v[0], v[1])
            case "NOT_BETWEEN":
                return ~c.between(v[0], v[1])
            case "CONTAINS":
                return c.contains(v[0])
            case "NOT_CONTAINS":
                return ~c.contains(v[0])
            case "STARTS_WITH":
                return c.startswith(v[0])
            case "ENDS_WITH":
                return c.endswith(v[0])
            case "MATCHES":
                if not compiles(v[0]):
                    raise ValueError(f"not a safe pattern: {v[0]}")
                return c.rlike(f"(?i){v[0]}")
            case "IS_EMPTY" | "IS_NOT_EMPTY":
                empty = F.coalesce(c, F.lit("")) == "" if kind == TEXT else c.isNull()
                return empty if self.operator == "IS_EMPTY" else ~empty
            case _:
                return c.eqNullSafe(F.lit(self.operator == "IS_TRUE"))


@dataclass(frozen=True)
class All:
    parts: tuple

    def column(self, today: dt.date) -> Column:
        return reduce(lambda a, b: a & b, (p.column(today) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Any:
    parts: tuple

    def column(self, today: dt.date) -> Column:
        return reduce(lambda a, b: a | b, (p.column(today) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not:
    part: Condition | All | Any

    def column(self, today: dt.date) -> Column:
        return ~self.part.column(today)


EVERYTHING = All(())


def field_type(name: str) -> str:
    if name.startswith("attributes."):
        if set(name) & set("'\"`\\"):
            raise ValueError(f"not a field: {name}")
        return TEXT
    if name not in FIELDS:
        raise ValueError(f"no such field: {name}")
    return FIELDS[name]


def label(name: str) -> str:
    """What a field is called: its label, an attribute's own key, else its name."""
    field_type(name)
    return LABELS.get(name, name.removeprefix("attributes."))


def _value(kind: str, value, today: dt.date):
    if kind == NUMBER:
        try:
            return value if isinstance(value, int) else Decimal(str(value))
        except InvalidOperation as e:
            raise ValueError(f"no number: {value}") from e
    if kind == DATE:
        return F.lit(value if isinstance(value, dt.date) else relative_date(value, today))
    return str(value)


def numeric_field(name: str) -> Column:
    """A quantity column by name; an unknown name falls back to the plain quantity."""
    return F.col(name if FIELDS.get(name) == NUMBER and name in ("quantity", "base_quantity") else "quantity")


def of_rows(rows: Sequence[tuple]) -> All:
    """Rows (field, operator, values) that must all hold."""
    return All(tuple(Condition(f, o, tuple(v)) for f, o, v in rows))


def apply_filter(df: DataFrame, tree, today: dt.date) -> DataFrame:
    return df.filter(tree.column(today))


def preview(df: DataFrame, tree, today: dt.date, amount: str = "quantity") -> DataFrame:
    """One row: how many rows and how much quantity a filter keeps, of all."""
    keeps = F.coalesce(tree.column(today), F.lit(False))
    return df.agg(F.count(F.when(keeps, 1)).alias("kept"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(keeps, F.col(amount))), F.lit(0)).alias("kept_quantity"), F.coalesce(F.sum(amount), F.lit(0)).alias("total_quantity"))


def two_sources(df: DataFrame, left: str, left_filter, right: str, right_filter, today: dt.date) -> DataFrame:
    """Rows of two sources, each with its own filter, in one scan."""
    return df.filter(((F.col("source") == left) & left_filter.column(today)) | ((F.col("source") == right) & right_filter.column(today)))


def search(df: DataFrame, kinds: Sequence[str], start: str, stop: str, needle: str, column: str, page: int = 0, size: int = 25) -> DataFrame:
    """A page of events of some kinds in a range of times whose column holds a text, newest first."""
    found = df.filter(F.col("event_type").isin(*kinds) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(stop).cast("timestamp_ntz")) & F.contains(F.lower(F.col(column)), F.lit(needle.lower())))
    return found.orderBy(F.desc("ts"), F.desc("event_id")).offset(page * size).limit(size)


TODAY = dt.date(1999, 6, 15)
_KEY = ("source", "CAST(extract(YEAR FROM base_at) AS BIGINT) AS base_year", "item_ref", "warehouse_code", "lot_code", "quantity")


def _query(view_name: str, tree, columns):
    return lambda s, d: apply_filter(view(s, d, view_name), tree, TODAY).selectExpr(*columns)


def _sql(view_name: str, where: str, columns) -> str:
    return f"{with_views(view_name)} SELECT {', '.join(columns)} FROM {view_name} WHERE {where}"


_CASES = {
    "filter_in": ("snapshot", of_rows([("warehouse_code", "IN", ("0", "1")), ("lot_code", "NOT_IN", ("A",))]), "warehouse_code IN ('0', '1') AND lot_code NOT IN ('A')"),
    "filter_in_between": ("snapshot", of_rows([("warehouse_code", "IN", ("2", "3")), ("quantity", "BETWEEN", (20, 40)), ("item_ref", "NOT_BETWEEN", (100, 1900))]), "warehouse_code IN ('2', '3') AND quantity BETWEEN 20 AND 40 AND item_ref NOT BETWEEN 100 AND 1900"),
    "filter_compare": ("snapshot", of_rows([("quantity", "GTE", (45,)), ("quantity", "LT", (50,)), ("lot_code", "NE", ("R",)), ("item_ref", "GT", (10,)), ("item_ref", "LTE", (1500,))]), "quantity >= 45 AND quantity < 50 AND lot_code <> 'R' AND item_ref > 10 AND item_ref <= 1500"),
    "filter_relative_date": ("snapshot", of_rows([("expiry_date", "GTE", ("TODAY-30",)), ("expiry_date", "LTE", ("오늘+30",))]), "expiry_date >= DATE '1999-05-16' AND expiry_date <= DATE '1999-07-15'"),
    "filter_nested_or": ("snapshot", Any((Condition("warehouse_code", "EQ", ("1",)), All((Condition("warehouse_code", "EQ", ("2",)), Not(Any((Condition("lot_code", "EQ", ("N",)), Condition("quantity", "LT", (30,))))))))), "warehouse_code = '1' OR (warehouse_code = '2' AND NOT (lot_code = 'N' OR quantity < 30))"),
}
_TEXTS = {
    "filter_text": ("sku", of_rows([("name", "CONTAINS", ("i",)), ("name", "NOT_CONTAINS", ("bolt",)), ("brand", "STARTS_WITH", ("Brand#1",)), ("code", "ENDS_WITH", ("5",))]), "contains(name, 'i') AND NOT contains(name, 'bolt') AND starts_with(brand, 'Brand#1') AND ends_with(code, '5')"),
    "filter_matches": ("sku", of_rows([("name", "MATCHES", ("^(SMALL|red) [a-m]",))]), "regexp_matches(name, '^(SMALL|red) [a-m]', 'i')"),
    "filter_empty_true": ("sku", of_rows([("name", "IS_NOT_EMPTY", ()), ("active", "IS_FALSE", ())]), "coalesce(name, '') <> '' AND NOT active"),
}


def filter_json_attribute(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "concat(event_type, '-', CAST(user_id AS STRING)) AS alert_key", "props AS attributes")
    return apply_filter(rows, of_rows([("attributes.k", "IN", ("1", "22", "69"))]), TODAY).select("event_id", "alert_key")


QUERIES = {
    **{n: _query(v, t, _KEY) for n, (v, t, _) in _CASES.items()},
    **{n: _query(v, t, ("sku_id", "code", "name")) for n, (v, t, _) in _TEXTS.items()},
    "filter_json_attribute": filter_json_attribute,
    "filter_preview": lambda s, d: preview(view(s, d, "snapshot"), _CASES["filter_nested_or"][1], TODAY),
    "two_source_filter": lambda s, d: two_sources(view(s, d, "snapshot"), "erp", of_rows([("lot_code", "EQ", ("A",))]), "wms", of_rows([("quantity", "GT", (45,))]), TODAY).selectExpr(*_KEY),
    "audit_search_page": lambda s, d: search(view(s, d, "alert"), ("error", "purchase"), "2024-01-05", "2024-01-20", "-1", "alert_key", 1).select("event_id", "alert_key"),
}

SQL = {
    **{n: _sql(v, w, _KEY) for n, (v, _, w) in _CASES.items()},
    **{n: _sql(v, w, ("sku_id", "code", "name")) for n, (v, _, w) in _TEXTS.items()},
    "filter_json_attribute": f"{with_views('alert')} SELECT event_id, alert_key FROM alert JOIN events USING (event_id) WHERE json_extract_string(props, '$.k') IN ('1', '22', '69')",
    "filter_preview": f"{with_views('snapshot')} SELECT count(*) FILTER (WHERE k) AS kept, count(*) AS total, CAST(coalesce(sum(quantity) FILTER (WHERE k), 0) AS BIGINT) AS kept_quantity, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM (SELECT *, {_CASES['filter_nested_or'][2]} AS k FROM snapshot)",
    "two_source_filter": _sql("snapshot", "(source = 'erp' AND lot_code = 'A') OR (source = 'wms' AND quantity > 45)", _KEY),
    "audit_search_page": f"{with_views('alert')} SELECT event_id, alert_key FROM alert WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND contains(lower(alert_key), '-1') ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 25",
}
