"""The workbook data source: a task a sheet, pushed filters, the same rows as the plain reader."""

import io
import zipfile

import pytest

from reportloom.sources import xlsx, xlsx_source

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        named = "".join(f'<sheet name="{name}" r:id="r{k}"/>' for k, (name, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{named}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for k, (_, rows) in enumerate(sheets):
            cells = lambda row: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row)
            body = rows if isinstance(rows, str) else f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>'
            z.writestr(f"xl/worksheets/s{k}.xml", body)
    return out.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    xlsx_source.register(spark)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(workbook([("Sales", [["a", "", "b"], [], ["c"]]), ("Broken", "no xml"), ("Notes", [["n"]])]))
    (tmp_path / "deep" / "b.xlsx").write_bytes(workbook([("Sales", [["x", "y"]]), ("Notes", [["m"]])]))
    return str(tmp_path)


def test_a_task_a_sheet_and_pushed_filters(spark, folder):
    every = spark.read.format("xlsx").load(folder)
    assert every.rdd.getNumPartitions() == 5
    sales = every.where("sheet = 'Sales'")
    assert sales.rdd.getNumPartitions() == 2
    plan = sales._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    got = [(r.path.rsplit("/", 1)[1], r.sheet_no, r.row_no, r.cells) for r in sales.orderBy("path", "row_no").collect()]
    assert got == [("a.xlsx", 0, 0, ["a", "", "b"]), ("a.xlsx", 0, 1, ["c", "", ""]), ("b.xlsx", 0, 0, ["x", "y"])]  # the broken sheet is not parsed
    assert every.where("sheet IN ('Notes', 'Sales') AND row_no = 0 AND path LIKE '%b.xlsx'").count() == 2
    assert every.where("sheet = 'none'").count() == 0


def test_same_rows_as_the_plain_reader(spark, tmp_path):
    xlsx_source.register(spark)
    (tmp_path / "c.xlsx").write_bytes(workbook([("", [["1", "2"]]), ("Empty", []), (" ", [["3"]])]))
    rows = lambda df: sorted((r.sheet, r.row_no, r.cells) for r in df.collect())
    got = rows(spark.read.format("xlsx").load(str(tmp_path)))
    assert got == rows(xlsx.read(spark, str(tmp_path))) == [("Sheet1", 0, ["1", "2"]), ("Sheet2", 0, ["3"])]
    (tmp_path / "old.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="legacy"):
        spark.read.format("xlsx").load(str(tmp_path)).collect()
