"""Instructions for each document, fallbacks, adjustments and failures; chunks in halves."""

import json

import pytest
from pyspark.sql import functions as F

from reportloom.operators import document_job as dj
from reportloom.operators import halving

HEAD = "| CUST NO | CUSTOMER NAME | ITEM NO | INV DATE | NET SALES | NET PRIOR | COMMISSION |\n|---|---|---|---|---|---|---|"
NAMES = "doc_id string, raw_json string, original_file_name string, manufacturer string, period_month string, period_year string, custom_instructions string"


def doc(i, told, sheets, name="r.xlsx"):
    raw = json.dumps({"result": {"contents": [{"path": n, "markdown": f"# {n}\n{t}"} for n, t in sheets]}})
    return (i, raw, name, "Maker", "03", "2026", told)


def test_each_document_has_its_own_instructions(spark):
    rows = "\n".join(f"| {k} | c{k} | i{k} | {'2026-03-09' if k else ''} | {k}.5 | 1{k} | |" for k in range(6))
    sales, other = f"{HEAD}\n{rows}\n| | Total | | | 15 | | 4.25 |", f"{HEAD}\n| 9 | c9 | i9 | 2026-01-01 | 100 | 7 | |"
    docs = [
        doc("all", None, [("Sales", sales), ("Other", other)]),
        doc("one", 'Only read the sheet named "Sales".', [("Sales", sales), ("Other", other)]),
        doc("none", 'Only read the sheet named "Gone".', [("Sales", sales), ("Other", other)]),
        doc("pinned", 'use "Net Prior" as netSales', [("Sales", sales), ("Other", other)], "r YTD.xlsx"),
        doc("text", "", [("S", "nothing here")]),
        doc("ytd", None, [("S", other.replace("ITEM NO", "ytd"))]),
    ]
    job = dj.run(spark.createDataFrame(docs, NAMES))
    got = {r.doc_id: r for r in job.documents.collect()}
    figures = lambda i: (got[i].status, got[i].line_count, float(got[i].total_net_sales), float(got[i].total_commission), got[i].detected)
    assert figures("all") == ("Done", 8, 118.0, 4.25, 6)
    assert figures("one") == ("Done", 7, 18.0, 4.25, 6)
    assert figures("pinned") == ("Done", 8, 10 + 11 + 12 + 13 + 14 + 15 + 7, 4.25, 6)
    assert tuple(got["none"])[:8] == ("none", "Failed", None, None, None, None, None, None)
    assert got["none"].error_message == "None of the sheets gone is there; the document has Other, Sales."
    assert got["text"].error_message == "Nothing extracted: no table content found." and got["text"].line_count == 0
    assert [got[i].is_cumulative for i in ("all", "pinned", "ytd")] == [False, True, True]
    sales = {(r.doc_id, r.part_no): r for r in job.sales.collect()}
    assert str(sales["all", "i0"].date) == "2026-03-01" and sales["all", "i0"].manufacturer == "Maker"
    extra = sales["all", None]
    assert (extra.customer_name, extra.commission, extra.net_sales, str(extra.date), extra.source_name) == (dj.UNALLOCATED, 4.25, None, "2026-03-01", "Sales")


def test_a_pin_for_one_sheet_alone(spark):
    asked = spark.createDataFrame([("d", "s", None), ("e", None, {"b": "Net"})], "doc_id string, prefix string, prefixes map<string,string>")
    assert sorted(map(tuple, dj.pins(asked).collect()), key=str) == [("d", None, "s"), ("e", "b", "Net")]


@pytest.mark.parametrize(("bad", "lost"), [([], []), ([5], [("12", 3)]), ([1, 10], [("11", 2), ("22", 3)]), (range(1, 11), [("11", 2), ("12", 3), ("21", 2), ("22", 3)])])
def test_halves_until_they_are_too_small(spark, bad, lost):
    rows = spark.range(1, 11).select(F.lit("c").alias("c"), F.col("id").alias("nth"))

    def work(part, key):
        failed = part.where(F.col("nth").isin(list(bad))).select(*key).distinct() if bad else part.where("false").select(*key)
        return part, failed.withColumn("message", F.lit("no"))

    kept, gone = halving.in_halves(rows, ["c"], work)
    assert sorted((r.part, r.n_rows) for r in gone.collect()) == lost
    assert kept.count() == 10 - sum(n for _, n in lost)
