import io
import zipfile

from gridscope.sources import delimited, files, ooxml


def test_encodings():
    assert delimited.decode("﻿a".encode()) == ("a", "utf-8-sig")
    assert delimited.decode("あ".encode()) == ("あ", "utf-8")
    assert delimited.decode("①あ".encode("cp932")) == ("①あ", "cp932")


def test_diagnostics():
    d = delimited.diagnose('a,b\n"x\ny",2\n1,"p"q\n1,2,3\n\n"open', ",")
    assert d.counts == {"multiline_record": 1, "unquoted_quote": 1, "field_count_mismatch": 3, "unclosed_quote": 1}
    assert delimited.diagnose('a,"b""c"\r\n1,2\r\n', ",").counts == {}
    many = delimited.diagnose("a,b\n" + "1\n" * 2000, ",")
    assert many.truncated and many.confidence == 0.85 and len(many.samples) == 50


def test_text_records():
    rows = list(files.parse("x.csv", "名,値\n北,\n".encode(), "id"))
    cells = {(r["row"], r["col"]): r["vtext"] for r in rows if r["kind"] == "cell"}
    assert cells == {(1, 1): "名", (1, 2): "値", (2, 1): "北", (2, 2): None}
    assert [r["kind"] for r in files.parse("x.pdf", b"", "id")] == ["error"]
    assert [r["kind"] for r in files.parse("x.xlsx", b"no zip", "id")] == ["error"]
    assert [r["kind"] for r in files.parse("x.csv", b"a\x00b", "id")] == ["error"]


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def workbook(sheet: str, drawing: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", RELS.format(f'<Relationship Id="r1" Type="{TYPE}officeDocument" Target="xl/workbook.xml"/>'))
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="one" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", RELS.format(f'<Relationship Id="r1" Type="{TYPE}worksheet" Target="worksheets/s1.xml"/>'))
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><fonts><font/><font><b/><color rgb="FFFF0000"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><borders><border/></borders><cellXfs><xf/><xf fontId="1" fillId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {NS}>{sheet}</worksheet>")
        if drawing:
            z.writestr("xl/worksheets/_rels/s1.xml.rels", RELS.format(f'<Relationship Id="r1" Type="{TYPE}drawing" Target="../drawings/d1.xml"/>'))
            z.writestr("xl/drawings/d1.xml", drawing)
    return out.getvalue()


SHEET = """<cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>
<row r="2" hidden="1"><c r="A2" s="2"><v>45292</v></c><c r="B2"><f>A2*2</f><v>3</v></c></row><row r="3"><c r="A3" t="e"><f>X!A1</f><v>#REF!</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B5"/></mergeCells>"""
DRAWING = '<wsDr xmlns="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"><oneCellAnchor><from><col>1</col><row>2</row></from><pic/></oneCellAnchor></wsDr>'


def test_workbook():
    (s,) = ooxml.read(workbook(SHEET, DRAWING))
    assert s.cells[1, 1][:2] == ("str", "name") and s.cells[1, 1][4].bold and s.cells[1, 1][4].bg == "FFFFFF00"
    assert s.cells[1, 2][1] == "value" and s.cells[2, 1][:2] == ("date", "2024-01-01 00:00:00")
    assert s.cells[2, 2][:4] == ("num", "3", 3.0, "=A2*2") and s.cells[3, 2][:3] == ("bool", "True", 1.0)
    assert s.merges == [(4, 1, 5, 2)] and s.hidden_rows == [2] and s.hidden_cols == [3]
    assert len(s.formulas) == 2 and s.errors == [(3, 1, "X!A1")] and s.objects == [(3, 2, "image")]


def test_workbook_records():
    rows = list(files.parse("b.xlsx", workbook(SHEET, DRAWING), "id"))
    slaves = [r for r in rows if r["kind"] == "cell" and r.get("m_row") == 4]
    assert len(slaves) == 4 and {r["kind"] for r in rows} == {"sheet", "merge", "cell", "formula", "error_ref", "object"}


def test_outline_groups(spark):
    sheet = "<sheetData>" + "".join(f'<row r="{r}"{" outlineLevel=" + chr(34) + "1" + chr(34) if r in (2, 3, 5) else ""}><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 7)) + "</sheetData>"
    given = spark.createDataFrame([("b.xlsx", bytearray(workbook(sheet)))], "path string, content binary")
    got = files.Workbooks(files.parse_files(given)).outlines.collect()
    assert sorted((r.axis, r.start, r.end, r.n) for r in got) == [("row", 2, 3, 2), ("row", 5, 5, 1)]


def test_white_space_behind_a_quote():
    assert delimited.diagnose('a,b\n"x" \t,2\n', ",").counts == {} and delimited.diagnose('a,b\n"x"\ty,2\n', ",").counts == {"unquoted_quote": 1}
