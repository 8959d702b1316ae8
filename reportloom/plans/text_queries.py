"""Queries on reports as text: odd tables, chunk texts, counts on normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.operators import analytics as an
from reportloom.operators import splitting, tables
from reportloom.plans.registry import query
from reportloom.plans.views import table
from reportloom.session import swept


def odd_texts(spark: SparkSession, d: str) -> DataFrame:
    """A report text for each order with its items as rows: doc_id, text.

    By the order's number a blank-cell row, a dash-only row or a blank line stands inside
    the table after the third (blank: second) item; even orders have a second table, whose
    separator is doubled in every fifth order, so that it holds no rows. Every seventh order
    has no table.
    """
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    o = table(spark, d, "lineitem").groupBy(k.alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), F.col("l_partkey").alias("p")))).alias("items"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).join(o, "doc_id", "left")
    k, empty = F.col("doc_id"), F.array().cast("array<string>")
    inside = F.when(k % 3 == 0, "|  |  |").when(k % 3 == 1, "").otherwise("|---|---|")
    at = F.when(k % 3 == 1, 2).otherwise(3)
    items = F.coalesce(F.flatten(F.transform("items", lambda x, i: F.concat(
        F.array(F.concat(F.lit("| "), x["p"].cast("string"), F.lit(" | n"), x["n"].cast("string"), F.lit(" |"))), F.when(i + 1 == at, F.array(inside)).otherwise(empty)
    ))), empty)
    text = lambda *lines: F.array(*map(F.lit, lines))
    head = F.array(F.concat(F.lit("Report "), k.cast("string")), F.lit("| ITEM | QTY |"), F.lit("|---|---|"))
    second = F.concat(text("Next", "| NO | NAME |", "| :- | -: |"), F.when(k % 5 == 0, text("|-|-|")).otherwise(empty), text("| 1 | x |"))
    free = F.array(F.concat(F.lit("No figures for "), k.cast("string")), F.lit(""), F.lit("| x |"), F.lit("end"))
    lines = F.when(k % 7 == 0, free).otherwise(F.concat(head, items, F.when(k % 2 == 0, second).otherwise(empty)))
    return o.select("doc_id", F.array_join(lines, "\n").alias("text"))


#: CTEs: o has the orders with their item lines, t the tables (no: the place in the text) with their preamble, head and rows in order.
ODD_SQL = """i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i,
    '| ' || l_partkey || ' | n' || l_linenumber || ' |' AS line FROM lineitem),
  o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 1000000 ELSE 3 END AS cut, CASE o_orderkey % 3 WHEN 0 THEN '|  |  |' ELSE '|---|---|' END AS ends,
      o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS two FROM orders WHERE o_orderkey % 7 <> 0),
  s AS (SELECT k, count(i) AS n, list(line ORDER BY i) AS items FROM o LEFT JOIN i USING (k) GROUP BY 1),
  t AS (SELECT k, 1 AS no, 'Report ' || k AS above, '| ITEM | QTY |' || chr(10) || '|---|---|' AS head, items[1:least(cut, n)] AS rows FROM o JOIN s USING (k) WHERE n > 0
    UNION ALL SELECT k, 2, CASE WHEN n >= cut THEN array_to_string(list_concat(list_concat([ends], items[cut + 1:n]), ['Next']), chr(10)) ELSE 'Next' END, '| NO | NAME |' || chr(10) || '| :- | -: |', ['| 1 | x |']
    FROM o JOIN s USING (k) WHERE two),
  f AS (SELECT o_orderkey AS k, 'No figures for ' || o_orderkey || chr(10) || chr(10) AS first, '| x |' || chr(10) || 'end' || chr(10) || chr(10) AS rest FROM orders WHERE o_orderkey % 7 = 0)"""


@query(f"""WITH {ODD_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_tables, row_number() OVER (PARTITION BY k ORDER BY no) AS table_no FROM t)
  SELECT k AS doc_id, table_no::INT AS table_no, n_tables, len(rows) AS n_rows, md5(array_to_string(rows, chr(10))) AS digest FROM n""")
def table_split(spark, d):
    """Tables with blank-cell, dash-only and repeated separators, and blank lines."""
    rows = splitting.split_tables(tables.text_lines(odd_texts(spark, d))).where("kind = 'row'")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "table_no", "n_tables").agg(F.count("*").alias("n_rows"), F.md5(text).alias("digest"))


@query(f"""WITH {ODD_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_tables, row_number() OVER (PARTITION BY k ORDER BY no) AS table_no FROM t),
  c AS (SELECT *, unnest(range(1, (len(rows) + 1) // 2 + 1)) AS chunk_no FROM n),
  x AS (SELECT k, table_no, chunk_no, CASE WHEN n_tables > 1 THEN 'table ' || table_no || ' of ' || n_tables ELSE 'document' END AS label, rows[2 * chunk_no - 1:2 * chunk_no] AS part, above, head FROM c)
  SELECT k AS doc_id, table_no::INT AS table_no, chunk_no::BIGINT AS chunk_no, label, len(part)::BIGINT AS n_rows,
    md5(CASE WHEN above <> '' THEN above || chr(10) || chr(10) ELSE '' END || head || chr(10) || array_to_string(part, chr(10)) || chr(10)) AS digest FROM x
  UNION ALL SELECT k, 1, 1, 'document', 0, md5(first || rest) FROM f
  UNION ALL SELECT o_orderkey, 1, 1, 'document', 0, md5(replace('Report ' || o_orderkey || '/| ITEM | QTY |/|---|---|' ||
    CASE WHEN o_orderkey % 10 = 0 THEN '/Next/| NO | NAME |/| :- | -: |/|-|-|/| 1 | x |' ELSE '' END || '//', '/', chr(10)))
    FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey NOT IN (SELECT k FROM t)""")
def chunk_texts(spark, d):
    """What would be mapped apart: two rows of a table below its preamble and header."""
    chunks = splitting.chunk_texts(odd_texts(spark, d), rows=2)
    return chunks.select("doc_id", "table_no", "chunk_no", "label", "n_rows", F.md5("content").alias("digest"))


def listed_texts(spark: SparkSession, d: str) -> DataFrame:
    """A report text for each supplier: its items below a title, with subtotals and a note, and a small table of totals."""
    item = F.format_string("| C%d | part %d | 2024-01-05 | %d |", "l_partkey", "l_partkey", "l_linenumber")
    line = F.when(F.col("l_partkey") % 9 == 0, F.format_string("| | Subtotal | | %d |", "l_linenumber")).otherwise(item)
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", line.alias("line")))).alias("rows"))
    fixed = lambda *lines: F.array(*map(F.lit, lines))
    lines = F.concat(
        fixed("# Sales", "| Title | Title | Title | Title |", "| CUST NO | CUST NAME | INV DATE | NET |", "|---|---|---|---|"), F.transform("rows", lambda r: r["line"]),
        fixed("| as of today | | | |", "", "# Summary", "| CUST NO | CUST NAME | INV DATE | NET |", "|---|---|---|---|", "| A1 | all | 2024-01-05 | 7 |"),
    )
    return rows.select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("""WITH n AS (SELECT l_suppkey AS doc_id, count_if(l_partkey % 9 <> 0) AS n, count(*) AS raw FROM lineitem GROUP BY 1)
  SELECT doc_id, (CASE WHEN n >= 5 THEN n ELSE 0 END)::BIGINT AS detected, (CASE WHEN raw + 1 >= 5 THEN raw + 1 ELSE 0 END)::BIGINT AS detected_raw, (n + 1)::BIGINT AS lines,
    CASE WHEN n % 3 = 0 THEN CASE WHEN n >= 5 THEN 'Nothing extracted although about ' || n || ' source rows were found.' ELSE 'Nothing extracted: no table content found.' END
      WHEN n % 3 = 1 AND n >= 5 AND ((n + 1) // 2) * 100 < n * 85 THEN (n + 1) // 2 || ' lines for about ' || n || ' source rows.' END AS warning FROM n""")
def coverage_on_text(spark, d):
    """Rows counted on the normalised text, where totals and notes don't count, against canonical lines; a third of the documents lose all, a third half of them."""
    lines = tables.text_lines(listed_texts(spark, d))
    clean = swept(tables.normalize(tables.grid(lines)))
    found = swept(splitting.rows_detected(splitting.normalized_lines(lines, clean).repartition("doc_id"), spread=splitting.SPREAD))
    raw = splitting.rows_detected(lines).select("doc_id", F.col("detected").alias("detected_raw"))
    held = clean.where("kind = 'row'").groupBy("doc_id").agg(F.count("*").alias("lines"))
    n = F.col("lines") - 1
    kept = F.when(n % 3 == 0, 0).when(n % 3 == 1, F.floor((n + 1) / 2)).otherwise(n)
    return found.join(raw, "doc_id").join(held, "doc_id").select("doc_id", "detected", "detected_raw", "lines", an.coverage_warning(kept, F.col("detected"), F.lit(None).cast("string")).alias("warning"))
