"""Office files made here and read from their zip and XML."""

import zipfile

from vellum.plans.stored import docx_of, xlsx_of, zipped
from vellum.sources import files, office

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _book(sheets, shared="", styles="", properties=""):
    parts = {
        "xl/workbook.xml": f"<workbook {MAIN} {RELS}>{properties}<sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
    }
    parts |= {f"xl/worksheets/s{i}.xml": f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>" for i, rows in enumerate(sheets.values())}
    return zipped(parts | ({"xl/sharedStrings.xml": f"<sst {MAIN}>{shared}</sst>"} if shared else {}) | ({"xl/styles.xml": f"<styleSheet {MAIN}>{styles}</styleSheet>"} if styles else {}))


def test_workbooks():
    rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>1.50</v></c><c r="C3" t="b"><v>1</v></c><c r="AA3" t="str"><f>A1</f><v>made</v></c></row>'
    dated = '<row><c s="1"><v>45292</v></c><c s="2"><v>0.5</v></c><c s="3"><v>3.0</v></c><c t="e"><v>#N/A</v></c><c/></row>'
    shared = "<si><t>one</t><rPh><t>no</t></rPh></si><si><r><t>t</t></r><r><t>wo</t></r></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="hh:mm"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    first, second = office.xlsx(_book({"A &amp; B": rows, "d": dated}, shared, styles))
    assert first[0] == "【工作表: A & B】\n" and len(first[1]) == 3 and first[1][0] == [""] * 27
    assert first[1][1][:3] == ["one", "", "two"] and first[1][2][1:3] == ["1.50", "True"] and first[1][2][26] == "made"
    assert second[1] == [["2024-01-01 00:00:00", "12:00:00", "3", "#N/A", ""]]
    old = office.xlsx(_book({"d": dated}, "", styles, '<workbookPr date1904="1"/>'))
    assert old[0][1][0][0] == "2028-01-02 00:00:00"


def test_documents_with_tables():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    t = lambda x: f'<w:t xml:space="preserve">{x}</w:t>'
    cell = lambda *ps: "<w:tc>" + "".join(map(p, ps)) + "</w:tc>"
    table = f"<w:tbl><w:tr>{cell(t('k'))}{cell(t('v'))}</w:tr><w:tr>{cell(t('a'), t('b'))}{cell('')}</w:tr></w:tbl>"
    body = p(t(" one "), t("two"), "<w:tab/>", t("x")) + table + p(t("  ")) + p(t("last"), "<w:delText>gone</w:delText>")
    raw = zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    assert office.docx(raw) == [("", "one two\tx"), ("", "last"), ("", [["k", "v"], ["a\nb", ""]])]


def test_office_files_are_rows(spark, tmp_path):
    made = {"a.docx": docx_of("one\n\n  two & <three>"), "b.xlsx": xlsx_of("S", [["n", "m"], ["1", "x"], ["", "y"]]), "c.docx": b"no archive", "d.docx": docx_of(" \n"), "e.XLSX": xlsx_of("none", [])}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.files(spark, f"file://{tmp_path}")).collect()}
    assert got["a.docx"]["text"] == "one\ntwo & <three>" and got["b.xlsx"]["text"] == "【工作表: S】\nn: 1; m: x\nm: y"
    assert "BadZipFile" in got["c.docx"]["error"] and got["d.docx"]["error"] == got["e.XLSX"]["error"] == "no text"


def test_large_parts_are_an_error(monkeypatch):
    monkeypatch.setattr(office, "MOST", 1000)
    try:
        office.docx(docx_of("x" * 2000))
        raise AssertionError
    except ValueError as e:
        assert "too large" in str(e)
    assert issubclass(zipfile.BadZipFile, Exception)
