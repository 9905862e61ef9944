"""Workbooks, CSV and JSON behind one name."""

import io
import zipfile

import pytest

from lakeloom.sources import uploads

MAIN = uploads._MAIN[1:-1]


def workbook(sheets: dict[str, str], shared=(), styles=None) -> bytes:
    parts = uploads._parts("")
    parts.pop("xl/worksheets/sheet1.xml")
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{office}"><sheets>{"".join(f"<sheet name=\'{n}\' sheetId=\'{i}\' r:id=\'r{i}\'/>" for i, n in enumerate(sheets))}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships>{"".join(f"<Relationship Id=\'r{i}\' Target=\'{"/xl/" if i else ""}worksheets/s{i}.xml\'/>" for i in range(len(sheets)))}</Relationships>'
    for i, body in enumerate(sheets.values()):
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'
    if shared:
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{"".join(f"<si>{t}</si>" for t in shared)}</sst>'
    if styles:
        parts["xl/styles.xml"] = styles
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


STYLES = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
FIRST = """<row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> on </t></is></c><c r="E2" t="inlineStr"><is><t>  </t></is></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>12.0</v></c><c r="D3" s="1"><v>45292</v></c><c r="E3"><v>9</v></c></row><row r="4"><c r="A4"/></row>
<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5"><v>1.25</v></c><c r="C5"><v>7</v></c><c r="D5" s="2"><v>45292.5</v></c></row><row r="6"><c r="B6" s="3"><v>3</v></c><c r="D6" t="str"><v>sum</v></c></row>"""


@pytest.fixture
def folder(tmp_path):
    shared = ("<t>name</t>", "<r><t>qu</t></r><r><t>antity</t></r>", "<t>Tent</t>")
    second = '<row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row>'
    (tmp_path / "one.xlsx").write_bytes(workbook({"Stock": FIRST, "More": second}, shared, STYLES))
    (tmp_path / "two.xlsx").write_bytes(workbook({"Stock": second}))
    (tmp_path / "notes.txt").write_text("no workbook")
    return str(tmp_path)


def test_cells_of_a_sheet(spark, folder):
    rows = [(r.sheet, r.position, r.cells) for r in uploads.read_workbooks(spark, f"{folder}/one.xlsx", "Stock", header=2).orderBy("position").collect()]
    assert rows == [
        ("Stock", 1, {"name": "Tent", "quantity": "12", "on": "2024-01-01"}),
        ("Stock", 2, {"name": "true", "quantity": "1.25", "on": "2024-01-01T12:00:00"}),
        ("Stock", 3, {"name": "", "quantity": "3", "on": "sum"}),
    ]


def test_sheets_and_files(spark, folder):
    count = lambda *a: {(r.file.rpartition("/")[2], r.sheet) for r in uploads.read_workbooks(spark, folder, *a).collect()}
    assert count("More") == {("one.xlsx", "More")}
    assert count(1) == {("one.xlsx", "More")}
    assert count(None) == {("one.xlsx", "Stock"), ("one.xlsx", "More"), ("two.xlsx", "Stock")}
    assert count("Nowhere") == set()


def test_sources_by_name(spark, folder, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code, name ,\nA1,Tent,x\n,,\nB2\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"result": {"items": [{"code": 1, "name": "<b>x</b>"}, {"code": 2}]}}')
    assert uploads.preview(spark, "csv", f"{folder}/a.csv") == ([{"code": "A1", "name": "Tent"}, {"code": "B2", "name": ""}], 2)
    assert uploads.preview(spark, "EXCEL", folder, 1, sheet="More") == ([{"k": "5"}], 1)
    assert uploads.preview(spark, "EXCEL", folder, 1, sheet=None)[1] > 2
    found = uploads.read_source(spark, "JSON", f"{folder}/b.json", rows="result.items", fields=("code", "name"))
    assert sorted(r.cells["code"] for r in found.collect()) == ["1", "2"] and uploads.fields(found) == ["code", "name"]
    with pytest.raises(ValueError):
        uploads.read_source(spark, "FTP", folder)
