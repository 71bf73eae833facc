"""Sheets written here and read back."""

import zipfile

from tallyweave.sources import sheets

HEAD = '<?xml version="1.0"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    rows = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>期末 </t></is></c></row>
    <row r="3"><c r="A3"><v>1001.0</v></c><c r="B3" s="1"><v>45292</v></c><c r="C3"><v>12.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}><si><r><t>科目</t></r><r><t>代码</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"{HEAD}<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


def test_csv_and_xlsx(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("科目代码, 金额\n,\n1001,\"1,000\"\n".encode("gbk"))
    workbook(tmp_path / "b.xlsx")
    found = {(r["file"].rpartition("/")[2], r["row_index"]): list(r["cells"]) for r in sheets.read_sheets(spark, str(tmp_path)).collect()}
    assert found == {
        ("a.csv", 0): ["科目代码", "金额"],
        ("a.csv", 1): ["1001", "1,000"],
        ("b.xlsx", 0): ["科目代码", "", "期末"],
        ("b.xlsx", 1): ["1001", "2024-01-01", "12.5", ""],
    }


def test_large_csv_keeps_all_cells_below_a_title_line(spark, tmp_path):
    (tmp_path / "titled.csv").write_text('年度报表\n科目编码, 科目名称,金额\n1001,"现金, 库存",5\n')
    rows = sorted(sheets.large_csv(spark, str(tmp_path / "titled.csv")).select("row_index", "cells").collect())
    assert [r["cells"] for r in rows] == [["年度报表"], ["科目编码", "科目名称", "金额"], ["1001", "现金, 库存", "5"]]


def test_large_csv_keeps_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{i},x{i}\n" if i % 3 else ",\n" for i in range(1, 2000)))
    rows = sorted(sheets.large_csv(spark, str(tmp_path / "big.csv")).select("row_index", "cells").collect())
    assert [r["cells"][0] for r in rows] == [str(i) for i in range(1, 2000) if i % 3]
    assert [r["row_index"] for r in rows] == list(range(len(rows)))


def test_batches_replace_only_themselves(spark, tmp_path):
    out = str(tmp_path / "t")
    sheets.write_batches(spark.createDataFrame([(1, "a"), (2, "b")], "batch_id int, v string"), out)
    sheets.write_batches(spark.createDataFrame([(2, "c")], "batch_id int, v string"), out)
    assert {(r["batch_id"], r["v"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}


def test_the_active_sheet_is_read(tmp_path):
    sheet = lambda text: f'{HEAD}<worksheet {NS}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS} {rel}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="x" r:id="r9"/><sheet name="y" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("first"))
        z.writestr("xl/worksheets/sheet7.xml", sheet("shown"))
    assert sheets.xlsx_cells((tmp_path / "a.xlsx").read_bytes()) == [["shown"]]


def test_csv_with_a_mark_reads_back(spark, tmp_path):
    sheets.write_csv(spark.createDataFrame([("现金", 1)], "name string, amount int").coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfname,amount") and sheets.csv_cells(data) == [["name", "amount"], ["现金", "1"]]
