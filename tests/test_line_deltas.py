"""Month lines from year-to-date reports: vanished and respelt lines, missing reports, golden figures."""

from decimal import Decimal

from pyspark.sql import functions as F

from reportloom.operators import analytics as an
from tests.measured import shuffled_bytes

SCHEMA = "manufacturer string, year int, month int, source_name string, customer_id string, customer_name string, city string, net_sales double, commission double"
BY = ["manufacturer", "year"]


def held(spark, *rows):
    lines = spark.createDataFrame(list(rows), SCHEMA)
    for c in an.LINE_KEY:
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast("string"))
    return lines


def found(spark, lines, reports):
    reports = spark.createDataFrame(reports, "manufacturer string, year int, month int")
    rows = an.line_deltas(lines, ["net_sales", "source_name"], BY, F.col("month"), F.col("month"), reports).collect()
    assert all(r["quantity"] is None and (r["date"].year, r["date"].month, r["date"].day) == (r["year"], r["month"], 1) for r in rows)
    return sorted((r["month"], r["customer_name"], r["source_name"], float(r["net_sales"]), float(r["commission"])) for r in rows)


def test_vanished_respelt_and_new_lines(spark):
    lines = held(
        spark,
        ("M", 2026, 1, "jan", "1", "Acme", "Rome", 100.0, 1.0), ("M", 2026, 1, "jan", "2", "Beta", "Oslo", 40.0, 4.0), ("M", 2026, 1, "jan", None, "Same", "X", 7.0, 0.0),
        ("M", 2026, 2, "feb", "1", " ACME ", "rome", 130.0, 1.0), ("M", 2026, 2, "feb b", "1", "acme", "Rome", 20.0, 0.5), ("M", 2026, 2, "feb", None, "Same", "X", 7.0, 0.0),
        ("M", 2026, 2, "feb", "3", "New", "Y", 5.0, None), ("M", 2026, 4, "apr", "1", "Acme", "Rome", 500.0, 9.0), ("M", 2025, 12, "dec", "1", "Acme", "Rome", 900.0, 9.0),
    )
    months = [("M", 2026, m) for m in (1, 2, 4)] + [("M", 2025, 12)]
    assert found(spark, lines, months) == [
        (1, "Acme", "jan", 100.0, 1.0), (1, "Beta", "jan", 40.0, 4.0), (1, "Same", "jan", 7.0, 0.0),
        (2, "Beta", "jan", -40.0, -4.0), (2, "New", "feb", 5.0, 0.0), (2, "acme", "feb b", 50.0, 0.5),
    ]  # no December in 2026, none before April: no figures


def test_a_report_that_lost_everything(spark):
    lines = held(spark, ("M", 2026, 1, "jan", "1", "Acme", "Rome", 100.0, 1.0))
    assert found(spark, lines, [("M", 2026, m) for m in (1, 2, 3)]) == [(1, "Acme", "jan", 100.0, 1.0), (2, "Acme", "jan", -100.0, -1.0)]


def test_golden_figure_of_one_pair(spark):
    frame = lambda v: held(spark, ("M", 2026, 1, "s", "1", "Acme", "Rome", v, 0.0)).drop("year", "month")
    got = an.line_delta(frame(1406580.58), frame(794258.99), ["net_sales"]).collect()
    assert [(r["net_sales"], r["customer_name"]) for r in got] == [(Decimal("612321.59"), "Acme")]


def test_texts_are_shuffled_once_a_step_and_not_at_all_for_figures(spark):
    n = 2000
    texts = {c: F.concat(*(F.sha2(F.concat(F.lit(f"{c}{k}"), F.col("id").cast("string")), 256) for k in range(3))) for c in ("customer_name", "part_description")}
    lines = spark.range(n).withColumns({c: F.lit(None).cast("string") for c in an.LINE_KEY}).withColumns(texts)
    lines = lines.select(
        "*", F.lit("M").alias("manufacturer"), F.lit(2026).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.lit("s").alias("source_name"),
        F.col("id").cast("double").alias("net_sales"), F.lit(1.0).alias("commission"),
    )
    held = n * 2 * 3 * 64  # bytes of all texts
    months = F.col("month")
    deltas = an.line_deltas(lines, ["net_sales", "customer_name", "part_description"], BY, months, months)
    assert held < shuffled_bytes(deltas) < 2.6 * held  # two steps; before, keys and order each held them as well
    assert shuffled_bytes(an.line_figures(lines, BY, months, months)) < 0.5 * held
    total = deltas.agg(F.sum("net_sales").alias("n"), F.count("*").alias("c")).first()
    assert an.line_figures(lines, BY, months, months).agg(F.sum("net_sales").alias("n"), F.count("*").alias("c")).first() == total
