"""Scalars, directives, normaliser rules, workbook reader and the queue on hand-made input."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reportloom.functions import directives, periods
from reportloom.functions import scalars as sc
from reportloom.operators import analytics as an
from reportloom.operators import splitting, tables
from reportloom.sources import envelope, sinks, xlsx
from reportloom.streaming import pipeline


def one(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_numbers(spark):
    text = ["(1,234.50)", "1,234", "5-", "-5", "+5", "1d", "5f", "$12", "5%", "1e3", " 7 ", "", None, "--5", "(-5)", ".5", "¤9"]
    assert one(spark, text, sc.net_double) == [-1234.5, 1234.0, -5.0, -5.0, 5.0, None, None, None, None, 1000.0, 7.0, None, None, None, None, 0.5, 9.0]


def test_trim_is_that_of_unicode(spark):
    text = [f"{a}x {a}y{b}{a}" for a in sc.WHITE for b in "\u3000 z"] + ["\u200bx\u200b", "", None, sc.WHITE]
    assert one(spark, text, sc.u_trim) == one(spark, text, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))


def test_clean_cells(spark):
    noise = ["280.16000000000003", "0.0575", "1234", "0.00005", "abc.d", "-0.12345"]
    assert one(spark, noise, lambda v: sc.clean_cell(v, F.lit(False))) == ["280.16", "0.0575", "1234", "0.0001", "abc.d", "-0.1235"]
    serial = ["46050", "45453.7", "19999", "20000", "65000", "65001"]
    assert one(spark, serial, lambda v: sc.clean_cell(v, F.lit(True))) == ["2026-01-28", "2024-06-10", "19999", "1954-10-03", "2077-12-16", "65001"]


def test_periods(spark):
    rows = spark.createDataFrame([("01", "2026"), ("3", "2026"), ("13", "2026"), ("x", "2026")], "m string, y string")
    got = [r.p and tuple(r.p) for r in rows.select(periods.previous_period(F.col("m"), F.col("y")).alias("p")).collect()]
    assert got == [("12", "2025"), ("02", "2026"), None, None]
    names = ["3M YTD 2-28-26.xlsx", "3M PYTD.xlsx", "3M_YTD_Feb.xlsx", "a Y.T.D. b"]
    assert one(spark, names, lambda v: periods.looks_cumulative(v, F.array(F.lit("PYTD")))) == [True, False, False, True]
    assert one(spark, ["a"], lambda v: periods.looks_cumulative(v, F.array(F.lit(" ytd ")))) == [True]


def test_year_to_date_golden_figures(spark):
    docs = spark.createDataFrame(
        [("a", "j.xlsx", "M", "01", "2026", "1", 794258.99), ("b", "f.xlsx", "M", "02", "2026", "2", 1406580.58), ("c", "m.xlsx", "M", "04", "2026", "3", 9.0)],
        "id string, original_file_name string, manufacturer string, period_month string, period_year string, upload_ts string, t double",
    ).selectExpr("*", "cast(t as decimal(18,2)) total_net_sales", "cast(0 as decimal(18,2)) total_commission", "true is_cumulative")
    got = {r.id: r.monthly_net_sales for r in an.with_monthly(docs).collect()}
    assert {k: v if v is None else float(v) for k, v in got.items()} == {"a": 794258.99, "b": 612321.59, "c": None}


@pytest.mark.parametrize(("text", "name"), [
    ('Only read the sheet named "Commissions"; ignore all other sheets in this workbook.', "Commissions"),
    ('Only read the sheet "8215 Sales"; ignore the "summary" sheet', "8215 Sales"),
    ('ignore the "summary" sheet', "summary"), ('ignore "summary" sheet', None), ("sheet: Commissions", "Commissions"), ("", None),
])
def test_sheet_directive(spark, text, name):
    assert one(spark, [text], directives.sheet_name) == [name]


def test_other_directives(spark):
    lists = ['read the sheets "A", "B" and "C". Then go', 'read the sheets "A" and "B"']
    assert one(spark, lists, directives.sheet_names) == [["A", "B", "C"], None]
    money = ['use only the money column whose header starts with "Current Month Gross Sales"', 'use "2026 Invoiced price" as netSales', "x"]
    assert one(spark, money, directives.money_prefix) == ["Current Month Gross Sales", "2026 Invoiced price", None]
    per_sheet = ['On sheets "B" and "C" use "Y" as netSales. On sheet "B" use "Z" as netSales', "x"]
    assert one(spark, per_sheet, directives.money_prefix_by_sheet) == [{"b": "Z", "c": "Y"}, None]


def block(spark, rows, **kw):
    grid = spark.createDataFrame([("d", 1, "S", k, list(r)) for k, r in enumerate(rows)], "doc_id string, block_no int, sheet string, row_no long, cells array<string>")
    return [(r.kind, r.cells) for r in tables.normalize(tables.rectangular(grid), **kw).orderBy("row_no").collect()]


HEAD = ["CUST NO", "CUST NAME", "INV DATE", "NET"]


def test_header_notes_totals_and_dates(spark):
    got = block(spark, [["Title"] * 3, ["field"], HEAD, ["1", "Acme", "46050", "280.16000000000003"], ["2", "Sum Innovations LLC", "46051", "1"], ["", "", "Result", "9"], ["a note"], ["Acme", "0", "0", "0"]])
    kinds = [k for k, _ in got]
    assert kinds == ["preamble", "label", "header", "row", "total", "total", "note", "row"]
    assert got[3][1] == ["1", "Acme", "2026-01-28", "280.16"] and got[6][1] == ["a note"]
    assert [k for k, _ in block(spark, [HEAD, ["Acme", "0", "0", "0"], ["1", "B", "3", "4"]], banners_in_body=False)] == ["header", "banner", "row"]


def test_repeated_columns_and_pins(spark):
    rows = [["A", "A", "B", "C", "D", ""]] + [[str(k), str(k), "x", "y", str(k * 2), ""] for k in range(1, 12)]
    assert block(spark, rows)[0] == ("header", ["A", "B", "C", "D"])
    pins = spark.createDataFrame([("s", "current month")], "sheet string, prefix string")
    head = ["Item", "Current Month", "Current Year Range", "Prior Year"]
    assert block(spark, [head, ["i", "1", "2", "3"], ["j", "4", "5", "6"]], pins=pins)[0][1] == ["Item", "Current Month"]


def test_pivot_keeps_the_grand_total(spark):
    rows = [HEAD] + [["g", f"n{k}", "t", "5"] for k in range(6)] + [["Grand Total", "", "", "30"]]
    got = [c for k, c in block(spark, rows) if k == "row"]
    assert got == [["ALL CUSTOMERS COMBINED", "", "", "30"]]


def test_lines_blocks_and_table_split(spark):
    text = "# S1\n| a | b |\n| - | - |\n| 1 | 2 |\n\n| 3 | 4 |\ntext\n# S2\n| c | d |\n| --- | --- |\n| 5 | 6 |"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    grid = [(r.block_no, r.sheet, r.cells) for r in tables.grid(tables.text_lines(docs)).orderBy("row_no").collect()]
    assert grid == [(1, "S1", ["a", "b"]), (1, "S1", ["1", "2"]), (2, "S1", ["3", "4"]), (3, "S2", ["c", "d"]), (3, "S2", ["5", "6"])]
    split = [(r.table_no, r.kind) for r in splitting.split_tables(tables.text_lines(docs)).orderBy("row_no").collect()]
    assert [s for s in split if s[1] in ("header", "row")] == [(1, "header"), (1, "row"), (1, "row"), (2, "header"), (2, "row")]


def test_paragraphs_pack_greedily(spark):
    assert one(spark, ["aa\n\nbb\n\ncccccccc\n\nd"], lambda v: tables.text_chunks(v, 6)) == [["aa\n\nbb", "cccccccc", "d"]]


def workbook():
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + rows + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sales" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>NAME</t></si><si><r><t>a</t></r><r><t>b\nc</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> D </t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>46050.5</v></c><c r="C3"><v>0.30000000000000004</v></c><c r="D3" t="b"><v>1</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet(""))
    return out.getvalue()


def test_workbook_reader(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    got = [(r.sheet, r.cells) for r in xlsx.read(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [("Sales", ["NAME", "", "D", ""]), ("Sales", ["ab c", "2026-01-28 12:00", "0.3", "TRUE"])]
    assert xlsx.read(spark, str(tmp_path), [" sales "]).count() == 2
    with pytest.raises(Exception, match="no filled row in the sheets .*other sheets: .*Sales"):
        xlsx.read(spark, str(tmp_path), ["other"]).collect()


def test_envelopes_in_either_case(spark):
    raw = spark.createDataFrame([("a", "not json"), ("b", json.dumps({"result": {"contents": [{"path": "S", "markdown": "m"}]}}))], "doc_id string, raw_json string")
    assert sorted(map(tuple, envelope.contents(raw).collect())) == [("a", 0, None, "not json"), ("b", 0, "S", "m")]
    stored = [("x", json.dumps({"Sales": [{"NetSales": 1.5, "Date": "2026-01-02"}]})), ("y", json.dumps({"sales": [{"netSales": 2.5, "customerId": "c"}]}))]
    rows = envelope.canonical_rows(spark.createDataFrame(stored, "doc_id string, analytics_json string")).collect()
    assert sorted((r.doc_id, r.net_sales, r.customer_id, str(r.date)) for r in rows) == [("x", 1.5, None, "2026-01-02"), ("y", 2.5, "c", "None")]


def test_queue_runs_once_and_again(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = "| CUST NO | CUST NAME | INV DATE | NET |\n| --- | --- | --- | --- |\n| 1 | Acme | 46050 | 2.5 |"
    put = lambda n, doc: (source / n).write_text(json.dumps({"doc_id": doc, "raw_json": json.dumps({"result": {"contents": [{"path": "S", "markdown": text}]}})}) + "\n")
    put("1.json", "d1")
    for _ in range(2):
        pipeline.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    put("2.json", "d1")
    put("3.json", "d2")
    pipeline.start(spark, str(source), target, str(tmp_path / "cp")).awaitTermination(120)
    sales = sinks.read(spark, f"{target}/sales")
    assert sorted((r.doc_id, r.customer_name, r.net_sales) for r in sales.collect()) == [("d1", "Acme", 2.5), ("d2", "Acme", 2.5)]


def test_separator_blocks_and_small_tables(spark):
    text = "|---|---|\n\n| a | b |\n|---|---|\n" + "\n".join(f"| {k} | x |" for k in range(5)) + "\n\ntext\n\n| c | d |\n|---|---|\n| 1 | 2 |"
    lines = tables.text_lines(spark.createDataFrame([("d", text), ("e", "|--|--|\n|:-|-:|")], "doc_id string, text string"))
    got = sorted((r.doc_id, r.row_no, r.kind, r.cells[0]) for r in tables.separator_blocks(lines).collect())
    assert got == [("d", 0, "verbatim", "|---|---|"), ("e", 0, "verbatim", "|--|--|"), ("e", 1, "verbatim", "|:-|-:|")]
    assert {(r.doc_id, r.detected) for r in splitting.rows_detected(lines).collect()} >= {("d", 5)}


def test_point_lookup(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    raw = spark.createDataFrame([("a", "r")], "doc_id string, raw_json string")
    none = spark.createDataFrame([], "doc_id string, analytics_json string")
    assert [tuple(r) for r in an.details(docs, raw, none, "a").collect()] == [("a", 1, "r", None)]
    assert an.details(docs, raw, none, "zz").isEmpty() and an.details(docs, raw, none).count() == 2


def test_configuration_problems():
    from reportloom import session

    assert session.problems({"a": "x", "b": " ", "c": "<key>", "f": "rel/ative", "g": "s3://b/x"}, ("a", "b", "c", "d"), ("f", "g")) == [
        "b is missing or still a placeholder.", "c is missing or still a placeholder.", "d is missing or still a placeholder.",
        "f is neither an absolute path nor a URI: rel/ative",
    ]
    with pytest.raises(ValueError, match="1 problem"):
        session.validate({}, ("a",))
    session.validate({"a": "1"}, ("a",))
