"""Uploaded files and bodies behind one name for each kind: rows of texts, read in tasks, and previews with a full count.

Spark lists and reads the files, from any store it can; a workbook is taken apart by the task that has it, a sheet is never
on the driver. `read_source` is the registry: a kind's reader, or an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.readers import json_rows, read_csv

ROW = "file string, sheet string, position long, cells map<string,string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the file format that mean dates or times.
_DATES = {*range(14, 23), *range(45, 48)}


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def _number(text: str, is_date: bool) -> str:
    """A number as people see it: whole ones without a point, dates as ISO."""
    value = float(text)
    if is_date:
        at = datetime(1899, 12, 30) + timedelta(seconds=round(value * 86_400))
        return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat()
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[dict[int, str]]]]:
    """Names of a workbook's sheets, and their rows as texts by column number. Rows come one by one."""
    book = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    there = set(book.namelist())
    texts = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in there else []
    dated: list[bool] = []
    if "xl/styles.xml" in there:
        styles = tree("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        is_date = lambda i: int(i) in _DATES or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")).lower().replace("general", "")))
        cells = styles.find(f"{_MAIN}cellXfs")
        dated = [is_date(x.get("numFmtId", "0")) for x in (cells if cells is not None else ())]
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))).lstrip("/").removeprefix("xl/xl/") for r in tree("xl/_rels/workbook.xml.rels")}

    def value(cell) -> str:
        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return texts[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        style = int(cell.get("s", 0))
        return _number(v.text, style < len(dated) and dated[style]) if kind == "n" else v.text

    def rows(name: str) -> Iterator[dict[int, str]]:
        for _, node in ElementTree.iterparse(book.open(name)):
            if node.tag == f"{_MAIN}row":
                yield {_column(c.get("r")) if c.get("r") else i: value(c) for i, c in enumerate(node.iter(f"{_MAIN}c"))}
                node.clear()

    for sheet in tree("xl/workbook.xml").iter(f"{_MAIN}sheet"):
        yield sheet.get("name"), rows(targets[sheet.get(_LINK)] if targets[sheet.get(_LINK)] in there else f"xl/{targets[sheet.get(_LINK)]}")


def read_workbooks(spark: SparkSession, path: str, sheet: str | int | None = 0, header: int = 1, suffix: str = "*.xlsx") -> DataFrame:
    """Rows of one sheet (by name or place; None: of all) of every workbook at a path: file, sheet, position (from 1, below the header) and cells by column name.

    Names are trimmed, columns without a name and rows without a value fall away, absent cells are ''. A file is one task's work.
    """
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "content"), sheet, header)


def workbook_rows(files: DataFrame, sheet: str | int | None = 0, header: int = 1) -> DataFrame:
    """The same for workbooks that are rows (path, content) already, as attachments in a table are."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for place, (name, rows) in enumerate(sheets(content)):
                    if sheet is not None and sheet not in (name, place):
                        continue
                    names, found, position = {}, [], 0
                    for n, row in enumerate(rows, 1):
                        if n < header:
                            continue
                        if n == header:
                            names = {i: t.strip() for i, t in row.items() if t.strip()}
                            continue
                        cells = {name: row.get(i, "") for i, name in names.items()}
                        if any(t.strip() for t in cells.values()):
                            position += 1
                            found.append((file, name, position, cells))
                        if len(found) == 10_000:
                            yield pd.DataFrame(found, columns=["file", "sheet", "position", "cells"])
                            found = []
                    if found:
                        yield pd.DataFrame(found, columns=["file", "sheet", "position", "cells"])

    return files.repartition(F.col("path")).mapInPandas(take, ROW)


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).select(F.from_json("j", "map<string,string>").alias("cells"))


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "CSV": lambda spark, path, **options: _cells(read_csv(spark, path)),
    "EXCEL": lambda spark, path, **options: read_workbooks(spark, path, **options),
    "JSON": lambda spark, path, rows="rows", fields=(), **options: _cells(json_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"), rows, list(fields)).drop("position")),
}


def read_source(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Rows of a source as `cells` (texts by field); an unknown kind is an error."""
    if kind.upper() not in SOURCES:
        raise ValueError(f"no reader for sources of kind {kind}")
    return SOURCES[kind.upper()](spark, path, **options)


def fields(rows: DataFrame) -> list[str]:
    """Names of all fields that rows have, in order: what a schema is made of. One aggregation; names, not rows, come to the driver."""
    names = rows.select(F.explode(F.map_keys("cells")).alias("field")).distinct()
    return [r["field"] for r in names.orderBy("field").collect()]


def preview(spark: SparkSession, kind: str, path: str, limit: int = 200, **options) -> tuple[list[dict[str, str]], int]:
    """The first rows of a source and how many it has. Only `limit` rows come to the driver."""
    rows = read_source(spark, kind, path, **options)
    return [dict(r["cells"]) for r in rows.select("cells").limit(limit).collect()], rows.count()


def workbooks(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Workbooks (path, content) of one sheet for exchange with people, one for each value of `by`: texts and numbers, no styles. A group is one file, so groups are small."""

    def cell(v: object, r: int, c: int) -> str:
        if isinstance(v, str):
            return f'<c r="{_letter(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{_escape(v)}</t></is></c>'
        return f'<c r="{_letter(c)}{r}"><v>{v}</v></c>'

    def book(group: pd.DataFrame) -> pd.DataFrame:
        lines = [columns, *group[columns].astype(object).itertuples(index=False, name=None)]
        body = "".join(f'<row r="{r}">{"".join(cell(v, r, c) for c, v in enumerate(line) if v is not None and v == v)}</row>' for r, line in enumerate(lines, 1))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _parts(body).items():
                z.writestr(name, text)
        return pd.DataFrame({"path": [str(group[by].iloc[0])], "content": [out.getvalue()]})

    return rows.select(*dict.fromkeys([by, *columns])).groupBy(by).applyInPandas(book, "path string, content binary")


def _letter(c: int) -> str:
    return (_letter(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _parts(body: str) -> dict[str, str]:
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    return {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }


def _books(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.withColumn("book", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 1000).cast("string"))).withColumn(" size ", F.col("p_size") / 2).withColumn("p_name", F.when(F.col("p_partkey") % 9 != 0, F.concat("p_name", F.lit(" <&> "))))
    return workbooks(rows, "book", ["p_partkey", "p_name", " size "])


QUERIES = {"excel_scan": lambda s, d: workbook_rows(_books(s, d)).select(F.col("file").alias("book"), *[F.col("cells")[c].alias(c) for c in ("p_partkey", "p_name", "size")])}

SQL = {
    "excel_scan": "SELECT p_brand || '-' || p_partkey // 1000 AS book, CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name || ' <&> ' ELSE '' END AS p_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS size FROM part",
}
