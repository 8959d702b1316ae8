"""Driver tables seen as the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions.scalars import CENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows from the star schema; small dimensions join by whatever way their size allows."""
    t = lambda name: table(spark, sf_dir, name)
    net = F.bround(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast(CENTS)
    # Orders meet their customers before the lines, of which there are several an order.
    bought = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        t("lineitem").join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.lit("lineitem").alias("source_name"), F.col("p_brand").alias("manufacturer"), F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("customer_name"), F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("city"), F.col("r_name").alias("state"),
            F.col("p_type").alias("product_family"), F.col("p_partkey").cast("string").alias("part_no"), F.col("p_name").alias("part_description"),
            F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), net.alias("net_sales"),
            F.bround(net * F.col("l_tax").cast("decimal(4,2)"), 2).cast(CENTS).alias("commission"),
        )
    )


SALES_SQL = """
  SELECT 'lineitem' AS source_name, p_brand AS manufacturer, c_custkey::VARCHAR AS customer_id, c_name AS customer_name,
    o_orderdate::DATE AS date, n_name AS city, r_name AS state, p_type AS product_family, p_partkey::VARCHAR AS part_no,
    p_name AS part_description, l_quantity::DECIMAL(18,2) AS quantity, net_sales,
    round_even((net_sales * l_tax::DECIMAL(4,2))::DECIMAL(20,4), 2)::DECIMAL(18,2) AS commission
  FROM (SELECT *, round_even((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(20,4), 2)::DECIMAL(18,2) AS net_sales FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded reports, one per order."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast(CENTS)
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("report_"), k.cast("string"), F.when(k % 2 == 0, " YTD").otherwise(""), F.lit(".xlsx")).alias("original_file_name"),
        F.lit("xlsx").alias("file_type"), F.col("o_orderdate").alias("upload_ts"),
        F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", F.element_at(F.array(F.lit("Queued"), F.lit("Extracting"), F.lit("Mapping")), (k % 3 + 1).cast("int"))).otherwise("Failed").alias("status"),
        (k % 10 * 10).cast("double").alias("progress_pct"), F.when(k % 13 == 0, "sheet unreadable").alias("error_message"), (k % 5 == 0).alias("has_warnings"),
        F.when(k % 7 != 0, total).alias("total_net_sales"), F.when(k % 7 != 0, F.bround(total * F.lit("0.05").cast("decimal(4,2)"), 2).cast(CENTS)).alias("total_commission"),
        (k * 37 % 100_000).alias("file_size_bytes"), F.when(k % 11 != 0, F.col("o_custkey") % 20).cast("long").alias("customer_count"),
        F.when(k % 11 != 0, F.col("o_custkey") % 50).cast("long").alias("line_count"), (k % 2 == 0).alias("is_cumulative"), F.col("o_orderpriority").alias("manufacturer"),
        F.date_format("o_orderdate", "MM").alias("period_month"), F.date_format("o_orderdate", "yyyy").alias("period_year"),
        F.when(k % 4 == 0, "only rows with a comment").alias("custom_instructions"),
    )


DOCUMENTS_SQL = """
  SELECT o_orderkey::VARCHAR AS id, 'report_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' YTD' ELSE '' END || '.xlsx' AS original_file_name,
    'xlsx' AS file_type, o_orderdate AS upload_ts,
    CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN ['Queued', 'Extracting', 'Mapping'][o_orderkey % 3 + 1] ELSE 'Failed' END AS status,
    (o_orderkey % 10 * 10)::DOUBLE AS progress_pct, CASE WHEN o_orderkey % 13 = 0 THEN 'sheet unreadable' END AS error_message, o_orderkey % 5 = 0 AS has_warnings,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS total_net_sales,
    CASE WHEN o_orderkey % 7 <> 0 THEN round_even((o_totalprice::DECIMAL(18,2) * 0.05::DECIMAL(4,2))::DECIMAL(20,4), 2)::DECIMAL(18,2) END AS total_commission,
    o_orderkey * 37 % 100000 AS file_size_bytes, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 20 END AS customer_count,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 50 END AS line_count, o_orderkey % 2 = 0 AS is_cumulative, o_orderpriority AS manufacturer,
    strftime(o_orderdate, '%m') AS period_month, strftime(o_orderdate, '%Y') AS period_year,
    CASE WHEN o_orderkey % 4 = 0 THEN 'only rows with a comment' END AS custom_instructions FROM orders"""


def year_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date reports: running totals of each manufacturer and year, one document per month."""
    from pyspark.sql import Window

    monthly = sales(spark, sf_dir).groupBy("manufacturer", F.year("date").alias("y"), F.month("date").alias("m")).agg(F.sum("net_sales").alias("n"), F.sum("commission").alias("c"))
    running = Window.partitionBy("manufacturer", "y").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        F.concat_ws("-", "manufacturer", "y", F.lpad(F.col("m").cast("string"), 2, "0")).alias("id"), F.lit("ytd.xlsx").alias("original_file_name"),
        F.lit("Done").alias("status"), F.make_timestamp("y", "m", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("upload_ts"), "manufacturer",
        F.lpad(F.col("m").cast("string"), 2, "0").alias("period_month"), F.col("y").cast("string").alias("period_year"), F.lit(True).alias("is_cumulative"),
        F.sum("n").over(running).cast(CENTS).alias("total_net_sales"), F.sum("c").over(running).cast(CENTS).alias("total_commission"),
    )


def _odd(brand):
    """Brands whose second column repeats the first."""
    return F.right(brand, F.lit(1)).cast("int") % 2 == 1


def report_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy report per brand as grid rows: banner, field name, header, data, totals, notes.

    Every 17th part is a subtotal and every 29th of the others a note.
    """
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_type", F.col("p_retailprice").cast("string").alias("price"))
    blank, key = F.lit(""), F.col("p_partkey")
    text = key.cast("string")
    part = F.array(
        text, F.when(_odd("p_brand"), text).otherwise(F.concat(F.lit("K"), text)), F.col("p_name"), F.col("p_type"),
        (F.lit(45_000) + key % 2000).cast("string"), F.col("price"), blank,
    )
    subtotal = F.array(blank, blank, F.lit("Subtotal"), blank, blank, F.col("price"), blank)
    note = F.array(F.concat(F.lit("Note on "), F.col("p_name")), *[blank] * 6)
    rows = p.select(
        F.col("p_brand").alias("doc_id"), (key + 10).alias("row_no"),
        F.when(key % 17 == 0, subtotal).when(key % 29 == 0, note).otherwise(part).alias("cells"),
    )
    brands = p.groupBy("p_brand").agg(F.max("p_partkey").alias("last"))
    heads = [F.lit("ITEM NO"), F.when(_odd("p_brand"), "ITEM NO").otherwise("SKU"), *(F.lit(h) for h in ("DESCRIPTION", "CATEGORY", "INV DATE", "NET SALES", ""))]
    fixed = [
        (1, F.array(*[F.concat(F.lit("Report of "), F.col("p_brand"))] * 4, blank, blank, blank)),
        (2, F.array(F.lit("Sales Org"), *[blank] * 6)),
        (3, F.array(*heads)),
    ]
    for n, cells in fixed:
        rows = rows.unionByName(brands.select(F.col("p_brand").alias("doc_id"), F.lit(n).cast("long").alias("row_no"), cells.alias("cells")))
    for k, cells in enumerate((F.array(blank, blank, F.lit("Subtotal"), *[blank] * 2, F.lit("9.5"), blank), F.array(F.lit("Figures are provisional"), *[blank] * 6))):
        rows = rows.unionByName(brands.select(F.col("p_brand").alias("doc_id"), (F.col("last") + 11 + k).alias("row_no"), cells.alias("cells")))
    return rows.select("doc_id", F.lit(1).alias("block_no"), F.lit("Sheet1").alias("sheet"), "row_no", "cells")


#: CTEs: g has the parts with their kind, b each brand with its kept columns (one column fewer where nine in ten rows repeat).
GRIDS_SQL = """p AS (SELECT *, p_partkey AS k, right(p_brand, 1)::INT % 2 = 1 AS odd,
    CASE WHEN p_partkey % 17 = 0 THEN 'total' WHEN p_partkey % 29 = 0 THEN 'note' ELSE 'row' END AS kind FROM part),
  b AS (SELECT p_brand, any_value(odd) AS odd, max(k) AS last, count_if(kind = 'row') AS n_rows, count_if(kind = 'total') + 1 AS n_totals, count_if(kind = 'note') + 1 AS n_notes,
    any_value(odd) AND count_if(kind = 'row') + 1 >= 0.9 * (count_if(kind = 'row') + 1 + count_if(kind = 'note') + 1) AS twice FROM p GROUP BY 1),
  g AS (SELECT p.*, b.twice, k + 10 AS row_no FROM p JOIN b USING (p_brand))"""


def pinned_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per brand with this period's, the prior year's and a range's figures, on one of two sheets."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.col("p_retailprice").cast("string").alias("price"))
    key, doc = F.col("p_partkey").cast("string"), F.col("p_brand").alias("doc_id")
    data = p.select(doc, (F.col("p_partkey") + 1).alias("row_no"), F.array(F.concat(F.lit("P"), key), F.concat(F.lit("text "), key), F.col("p_size").cast("string"), F.col("price"), F.concat(key, F.lit("5"))).alias("cells"))
    heads = F.array(*map(F.lit, ("ITEM NO", "DESCRIPTION", "NET PRIOR YEAR", "NET CURRENT", "RANGE OF SALES")))
    rows = data.unionByName(p.select("p_brand").distinct().select(doc, F.lit(0).cast("long").alias("row_no"), heads.alias("cells")))
    return rows.select("doc_id", F.lit(1).alias("block_no"), F.when(_odd("doc_id"), "Summary").otherwise("Detail").alias("sheet"), "row_no", "cells")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as text for each order, one line of it for each of its line items: doc_id, line_no, line."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 1).cast("int").alias("line_no"),
        F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("string"), F.lit(" |")).alias("line"),
    )
    head = F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("| ITEM | QTY |").alias("line")), F.struct(F.lit(1).alias("line_no"), F.lit("|---|---|").alias("line"))))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), head.alias("h")).select("doc_id", "h.*")
    return items.unionByName(heads)
