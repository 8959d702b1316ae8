"""Every registered report query and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.functions import directives, periods
from reportloom.functions import scalars as sc
from reportloom.operators import analytics as an
from reportloom.operators import mapping, splitting, tables
from reportloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from reportloom.plans.views import DOCUMENTS_SQL, GRIDS_SQL, SALES_SQL, documents, pinned_grids, report_grids, report_lines, sales, table, year_to_date
from reportloom.sources import envelope


@query(SALES_SQL)
def canonical_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d)


@query(f"""WITH s AS ({SALES_SQL}) SELECT manufacturer, year(date)::INT AS y, month(date)::INT AS m, sum(net_sales)::DECIMAL(18,2) AS total_net_sales,
  sum(commission)::DECIMAL(18,2) AS total_commission, count(*) AS line_count, count(DISTINCT customer_id) AS customer_count FROM s GROUP BY ALL""")
def document_aggregates(spark, d):
    s = sales(spark, d).withColumn("y", F.year("date")).withColumn("m", F.month("date"))
    return an.document_aggregates(s, "manufacturer", "y", "m")


@query("""SELECT c_mktsegment, count(DISTINCT CASE WHEN trim(k) <> '' THEN k END) AS customers FROM (SELECT c_mktsegment,
  coalesce(CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN (c_custkey % 10)::VARCHAR ELSE c_custkey::VARCHAR END, c_name) AS k FROM customer) GROUP BY 1""")
def customer_count_rule(spark, d):
    k = F.col("c_custkey")
    ids = F.when(k % 4 == 0, None).when(k % 4 == 1, "").when(k % 4 == 2, (k % 10).cast("string")).otherwise(k.cast("string"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct(an.customer_key(ids, F.col("c_name"))).alias("customers"))


_YTD = f"""WITH s AS ({SALES_SQL}), mo AS (SELECT manufacturer, year(date) AS y, month(date) AS m, sum(net_sales) AS n, sum(commission) AS c FROM s GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER w AS tn, sum(c) OVER w AS tc FROM mo WINDOW w AS (PARTITION BY manufacturer, y ORDER BY m))"""


@query(f"""{_YTD} SELECT a.manufacturer, lpad(a.m::VARCHAR, 2, '0') AS period_month, a.y::VARCHAR AS period_year, a.tn::DECIMAL(18,2) AS total_net_sales,
  (CASE WHEN a.m = 1 THEN a.tn ELSE a.tn - b.tn END)::DECIMAL(18,2) AS monthly_net_sales, (CASE WHEN a.m = 1 THEN a.tc ELSE a.tc - b.tc END)::DECIMAL(18,2) AS monthly_commission
  FROM r a LEFT JOIN r b ON a.manufacturer = b.manufacturer AND a.y * 12 + a.m - 1 = b.y * 12 + b.m""")
def monthly_from_ytd(spark, d):
    """Each manufacturer's own-month figure from year-to-date reports."""
    return an.with_monthly(year_to_date(spark, d)).select(
        "manufacturer", "period_month", "period_year", "total_net_sales", "monthly_net_sales", "monthly_commission"
    )


def ytd_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of year-to-date reports with the months in whose reports they stand (_from, _to).

    A line comes with its sale and stays to December, but every seventh part's lines are
    gone after the next report. Every other supplier's lines are spelt in their own way. Of
    every 25th manufacturer the report of May is missing.
    """
    m, odd = F.month("date"), F.col("quantity").cast("int") % 2 == 1
    spelt = lambda c: F.when(odd, F.concat(F.lit(" "), F.lower(c), F.lit("  "))).otherwise(F.col(c)).alias(c)
    s = sales(spark, d)
    return s.select(
        *(spelt(c) if c in ("customer_name", "city", "part_description") else F.col(c) for c in s.columns if c != "date"), F.year("date").alias("year"), m.alias("_from"),
        F.when(F.col("part_no").cast("long") % 7 == 0, F.least(m + 1, F.lit(12))).otherwise(12).alias("_to"),
    )


def ytd_reports(spark: SparkSession, d: str) -> DataFrame:
    """Which year-to-date reports there are: manufacturer, year, month."""
    years = table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("manufacturer")).distinct()
    every = brands.crossJoin(years).select("manufacturer", F.explode(F.sequence("a", "b")).alias("year")).select("manufacturer", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return every.where("NOT (month = 5 AND manufacturer = 'Brand#25')")


_ORDER = ["customer_id", "part_no", "quantity", "net_sales", "commission", "customer_name", "city", "part_description"]
_LINE = "customer_id, customer_name, city, state, product_family, part_no, part_description"
_FIGURES = "sum(net_sales) AS n, sum(commission) AS c"
_DELTA = f"""WITH s AS ({SALES_SQL}), l AS (SELECT manufacturer, year(date)::INT AS year, source_name, customer_id, state, product_family, part_no, quantity, net_sales, commission, month(date)::INT AS f,
    CASE WHEN part_no::BIGINT % 7 = 0 THEN least(month(date) + 1, 12) ELSE 12 END::INT AS t, quantity::INT % 2 = 1 AS odd, upper(trim(customer_name)) AS kc, upper(trim(city)) AS ky, upper(trim(part_description)) AS kp,
    CASE WHEN odd THEN ' ' || lower(customer_name) || '  ' ELSE customer_name END AS customer_name, CASE WHEN odd THEN ' ' || lower(city) || '  ' ELSE city END AS city,
    CASE WHEN odd THEN ' ' || lower(part_description) || '  ' ELSE part_description END AS part_description FROM s),
  r AS (SELECT manufacturer, year, unnest(range(1, 13))::INT AS month FROM (SELECT DISTINCT p_brand AS manufacturer FROM part),
    (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1))::INT AS year FROM orders)),
  held AS (SELECT * FROM r WHERE NOT (month = 5 AND manufacturer = 'Brand#25')),
  own AS (SELECT l.*, month FROM l JOIN held USING (manufacturer, year) WHERE month BETWEEN f AND t),
  base AS (SELECT manufacturer, year, month + 1 AS month FROM held),
  was AS (SELECT l.*, month FROM l JOIN base USING (manufacturer, year) WHERE month - 1 BETWEEN f AND t),
  k AS (SELECT manufacturer, year, month, customer_id, kc, ky, state, product_family, part_no, kp, {_FIGURES}, arg_min((source_name, {_LINE}), ({', '.join(_ORDER)})) AS x FROM own GROUP BY ALL),
  p AS (SELECT manufacturer, year, month, customer_id, kc, ky, state, product_family, part_no, kp, {_FIGURES}, arg_min((source_name, {_LINE}), ({', '.join(_ORDER)})) AS x FROM was GROUP BY ALL),
  j AS (SELECT manufacturer, year, month, coalesce(k.n, 0) - coalesce(p.n, 0) AS n, coalesce(k.c, 0) - coalesce(p.c, 0) AS c, coalesce(k.x, p.x) AS x
    FROM k FULL JOIN p USING (manufacturer, year, month, customer_id, kc, ky, state, product_family, part_no, kp)),
  delta AS (SELECT j.* FROM j SEMI JOIN held USING (manufacturer, year, month) WHERE (n <> 0 OR c <> 0) AND (month = 1 OR (manufacturer, year, month) IN (SELECT (manufacturer, year, month) FROM base)))"""


@query(f"""{_DELTA} SELECT manufacturer, year, month, make_date(year, month, 1) AS date, x[1] AS source_name, x[2] AS customer_id, x[3] AS customer_name, x[4] AS city, x[5] AS state,
  x[6] AS product_family, x[7] AS part_no, x[8] AS part_description, NULL::DECIMAL(38,10) AS quantity, n::DECIMAL(18,2) AS net_sales, c::DECIMAL(18,2) AS commission FROM delta""")
def line_delta(spark, d):
    """Each month's lines from its year-to-date report and the one before, lines that vanish or are spelt anew among them."""
    return an.line_deltas(ytd_lines(spark, d), _ORDER, ["manufacturer", "year"], F.col("_from"), F.col("_to"), ytd_reports(spark, d))


@query(f"""{_DELTA}, sums AS (SELECT manufacturer, year, month, sum(n)::DECIMAL(18,2) AS delta FROM delta GROUP BY ALL),
  cs AS (SELECT manufacturer, year, month, sum(net_sales) AS n FROM own GROUP BY ALL), ps AS (SELECT manufacturer, year, month, sum(net_sales) AS n FROM was GROUP BY ALL)
  SELECT manufacturer, year, month, coalesce(delta, 0)::DECIMAL(18,2) AS delta, (coalesce(cs.n, 0) - coalesce(ps.n, 0))::DECIMAL(18,2) AS difference
  FROM held LEFT JOIN cs USING (manufacturer, year, month) LEFT JOIN ps USING (manufacturer, year, month) LEFT JOIN sums USING (manufacturer, year, month)
  WHERE month = 1 OR (manufacturer, year, month) IN (SELECT (manufacturer, year, month) FROM base)""")
def delta_total_check(spark, d):
    """The line deltas of a month add up to the difference of its reports' totals."""
    by = ["manufacturer", "year", "month"]
    lines, reports = ytd_lines(spark, d), ytd_reports(spark, d)
    zero = F.lit(0).cast(sc.CENTS)
    months = lines.groupBy("manufacturer", "year", "_from", "_to").agg(F.sum("net_sales").alias("n"))
    totals = months.withColumn("month", F.explode(F.sequence("_from", "_to"))).groupBy(*by).agg(F.sum("n").cast(sc.CENTS).alias("_n"))
    before = totals.select("manufacturer", "year", (F.col("month") + 1).alias("month"), F.col("_n").alias("_p"))
    deltas = an.line_figures(lines, ["manufacturer", "year"], F.col("_from"), F.col("_to"), reports).groupBy(*by).agg(sc.total(F.col("net_sales")).alias("delta"))
    known = reports.select("manufacturer", "year", (F.col("month") + 1).alias("month"))
    based = reports.where("month = 1").unionByName(reports.join(known, by, "left_semi").where("month > 1"))
    found = based.join(totals, by, "left").join(before, by, "left").join(deltas, by, "left")
    return found.select(*by, F.coalesce("delta", zero).alias("delta"), (F.coalesce("_n", zero) - F.coalesce("_p", zero)).cast(sc.CENTS).alias("difference"))


_LATEST = f"""WITH docs AS ({DOCUMENTS_SQL}), latest AS (SELECT * FROM docs WHERE is_cumulative AND total_net_sales IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY manufacturer, period_year, period_month ORDER BY upload_ts DESC, id) = 1)"""
_BEFORE = "strftime(make_date(d.period_year::INT, d.period_month::INT, 1) - INTERVAL 1 MONTH, '%Y-%m') = l.period_year || '-' || l.period_month"
_MONTHLY = """CASE WHEN d.is_cumulative AND d.{0} IS NOT NULL THEN CASE WHEN d.period_month = '01' THEN d.{0} ELSE d.{0} - l.{0} END END::DECIMAL(18,2)"""
_LISTED = f"""{_LATEST}, listed AS (SELECT d.*, {_MONTHLY.format('total_net_sales')} AS monthly_net_sales, {_MONTHLY.format('total_commission')} AS monthly_commission
  FROM docs d LEFT JOIN latest l ON d.manufacturer = l.manufacturer AND {_BEFORE})"""


@query(f"{_LATEST} SELECT id, manufacturer, period_year, period_month, total_net_sales FROM latest")
def latest_document_per_period(spark, d):
    return an.latest_per_period(documents(spark, d)).select("id", "manufacturer", "period_year", "period_month", "total_net_sales")


@query(f"""WITH docs AS ({DOCUMENTS_SQL}), done AS (SELECT * FROM docs WHERE is_cumulative AND status = 'Done'
  QUALIFY row_number() OVER (PARTITION BY manufacturer, period_year, period_month ORDER BY upload_ts DESC, id) = 1)
  SELECT d.id, l.id AS prev_id, l.original_file_name AS prev_file_name FROM docs d LEFT JOIN done l ON d.manufacturer = l.manufacturer AND {_BEFORE}""")
def previous_period_lookup(spark, d):
    return an.previous_document(documents(spark, d)).select("id", "prev_id", "prev_file_name")


@query(f"""{_LISTED} SELECT {', '.join(an.LISTED)}, monthly_net_sales, monthly_commission FROM listed ORDER BY upload_ts DESC, id""")
def listing(spark, d):
    return an.listing(documents(spark, d))


@query(f"WITH docs AS ({DOCUMENTS_SQL}) SELECT id, status, progress_pct, error_message, has_warnings FROM docs")
def status_listing(spark, d):
    return documents(spark, d).select("id", "status", "progress_pct", "error_message", "has_warnings")


@query(f"WITH docs AS ({DOCUMENTS_SQL}) SELECT id, status, upload_ts FROM docs WHERE status IN ('Queued', 'Extracting', 'Mapping') ORDER BY upload_ts, id")
def resume_scan(spark, d):
    return documents(spark, d).where(F.col("status").isin(an.OPEN)).select("id", "status", "upload_ts").orderBy("upload_ts", "id")


@query(f"""WITH docs AS ({DOCUMENTS_SQL}) SELECT id FROM docs WHERE status = 'Done' AND line_count IS NULL
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey::VARCHAR = id)""")
def backfill_scan(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return documents(spark, d).where("status = 'Done' AND line_count IS NULL").select("id").join(rows, "id", "left_semi")


@query(f"""{_LISTED} SELECT count(*) AS documents, count_if(status = 'Done') AS done, count_if(status IN ('Queued', 'Extracting', 'Mapping')) AS running,
  count_if(has_warnings) AS flagged,
  sum(CASE WHEN status = 'Done' THEN coalesce(CASE WHEN is_cumulative THEN monthly_net_sales END, total_net_sales, 0) ELSE 0 END)::DECIMAL(18,2) AS net_sales,
  sum(CASE WHEN status = 'Done' THEN coalesce(CASE WHEN is_cumulative THEN monthly_commission END, total_commission, 0) ELSE 0 END)::DECIMAL(18,2) AS commission FROM listed""")
def batch_rollup(spark, d):
    return an.batch_rollup(an.with_monthly(documents(spark, d)))


@query(f"""WITH docs AS ({DOCUMENTS_SQL}), n AS (SELECT l_orderkey::VARCHAR AS id, count(*) AS detected FROM lineitem GROUP BY 1),
  j AS (SELECT d.id, coalesce(line_count, 0) AS lines, coalesce(detected, 0) AS detected, coalesce(custom_instructions, '') AS told FROM docs d LEFT JOIN n USING (id))
  SELECT id, lines, detected, CASE WHEN lines = 0 AND detected = 0 THEN 'Nothing extracted: no table content found.'
    WHEN lines = 0 THEN 'Nothing extracted although about ' || detected || ' source rows were found.'
    WHEN detected > 0 AND lines * 100 < detected * 85 THEN lines || ' lines for about ' || detected || ' source rows.' ||
      CASE WHEN trim(told) <> '' THEN ' The instructions may filter rows on purpose.' ELSE '' END END AS warning FROM j""")
def coverage_check(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count("*").alias("detected"))
    j = documents(spark, d).join(n, "id", "left")
    lines, found = F.coalesce("line_count", F.lit(0)), F.coalesce("detected", F.lit(0))
    return j.select("id", lines.alias("lines"), found.alias("detected"), an.coverage_warning(lines, found, F.col("custom_instructions")).alias("warning"))


@query("""WITH w AS (SELECT o_custkey, list_sort(list('chunk ' || o_orderkey)) AS m FROM orders GROUP BY 1)
  SELECT o_custkey, array_to_string(list_concat(m, ['coverage'])[1:10], ' | ') AS text FROM w""")
def warnings_top10(spark, d):
    w = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("chunk "), F.col("o_orderkey").cast("string"))).alias("m"))
    return w.select("o_custkey", an.warning_text(F.col("m"), F.array(F.lit("coverage"))).alias("text"))


_LINES = "l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_NTH = f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINES})"


def _numbered(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(*_LINES.split(", "))
    return table(spark, d, "lineitem").withColumn("nth", F.row_number().over(w))


@query(f"""SELECT l_suppkey, ((nth - 1) // 90 + 1)::BIGINT AS chunk_no, count(*) AS n_rows, sum(l_quantity)::DECIMAL(18,2) AS quantity
  FROM (SELECT *, {_NTH} AS nth FROM lineitem) GROUP BY ALL""")
def row_chunking(spark, d):
    return _numbered(spark, d).groupBy("l_suppkey", tables.chunk_no(F.col("nth")).alias("chunk_no")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast(sc.CENTS).alias("quantity")
    )


@query(f"""WITH c AS (SELECT *, ((nth - 1) // 90 + 1)::BIGINT AS chunk_no FROM (SELECT *, {_NTH} AS nth FROM lineitem))
  SELECT l_suppkey, chunk_no, count(*) AS rows_sent, count_if(l_returnflag <> 'N') AS rows_returned FROM c GROUP BY ALL HAVING 100 * count_if(l_returnflag <> 'N') < 70 * count(*)""")
def chunk_reconciliation(spark, d):
    c = _numbered(spark, d).withColumn("chunk_no", tables.chunk_no(F.col("nth")))
    return mapping.chunk_shortfalls(c, c.where("l_returnflag <> 'N'"), ["l_suppkey", "chunk_no"])


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, {_NTH} AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
  WHERE nth <= 12 OR (n > 15 AND nth > n - 3)""")
def head_tail_sample(spark, d):
    order = [F.col(c) for c in _LINES.split(", ")]
    return tables.sample_rows(table(spark, d, "lineitem"), ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents)
  SELECT doc_id, count(*) AS n_lines, count_if(regexp_matches(line, '^\s*\|.*\|\s*$')) AS n_rows, count_if(regexp_matches(line, '^\s*\|[\s:\-|]+\|\s*$')) AS n_separators,
  max(length(line))::INT AS longest FROM l GROUP BY 1""")
def text_line_split(spark, d):
    return tables.text_lines(table(spark, d, "documents")).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(tables.ROW)).alias("n_rows"),
        F.count_if(F.col("line").rlike(tables.SEPARATOR)).alias("n_separators"), F.max(F.length("line")).alias("longest"),
    )


@query("""WITH RECURSIVE p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents),
  r AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk_no, ps[1] AS chunk FROM p
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(chunk) + 2 + length(ps[i + 1]) <= 1000 THEN chunk_no ELSE chunk_no + 1 END,
      CASE WHEN length(chunk) + 2 + length(ps[i + 1]) <= 1000 THEN chunk || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END FROM r WHERE i < len(ps)),
  f AS (SELECT doc_id, chunk_no, arg_max(chunk, i) AS chunk FROM r GROUP BY ALL)
  SELECT doc_id, chunk_no, length(chunk)::INT AS chars, md5(chunk) AS digest FROM f""")
def paragraph_chunking(spark, d):
    chunks = tables.text_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


_LABELS = ["Subtotal", "Sum Innovations LLC", "Results", " grand total", "sub-total x", "Totals", "Acme", "Summary"]


@query(f"""SELECT p_partkey, NOT regexp_matches(({_LABELS})[p_partkey % 8 + 1], '(?i)^\\s*((grand|overall)\\s+)?(total|totals|subtotal|sub-total|sum|result)\\b')
  AND NOT regexp_matches(p_name, '(?i)^\\s*((grand|overall)\\s+)?(total|totals|subtotal|sub-total|sum|result)\\b') AS kept FROM part""")
def aggregate_row_filter(spark, d):
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", (~tables.is_total(F.array(label, F.col("p_name")))).alias("kept"))


@query("""SELECT o_orderkey, strftime(CASE WHEN 15000 + k BETWEEN 20000 AND 65000 THEN DATE '1899-12-30' + (15000 + k)::INT END, '%Y-%m-%d') AS in_dates, (15000 + k)::VARCHAR AS elsewhere
  FROM (SELECT o_orderkey, o_orderkey % 60000 AS k FROM orders)""")
def excel_serial_dates(spark, d):
    serial = (F.lit(15_000) + F.col("o_orderkey") % 60_000).cast("string")
    dated = sc.clean_cell(serial, F.lit(True))
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(dated != serial, dated).alias("in_dates"), sc.clean_cell(serial, F.lit(False)).alias("elsewhere")
    )


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * l_discount, 4)::DECIMAL(38,4)::DOUBLE AS cleaned FROM lineitem""")
def float_cleanup(spark, d):
    noisy = (F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(38,12)").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", sc.net_double(sc.clean_cell(noisy, F.lit(False))).alias("cleaned"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN -l_quantity WHEN 1 THEN l_quantity WHEN 2 THEN -l_quantity END AS number FROM lineitem""")
def numeric_parse(spark, d):
    q, k = F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(F.lit("("), q, F.lit(")"))).when(k == 1, F.concat(F.lit(" +"), q)).when(k == 2, F.concat(q, F.lit("-"))).otherwise(F.concat(F.lit("$"), q))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", sc.net_double(text).alias("number"))


@query(f"""WITH r AS (SELECT l_suppkey AS doc_id, 1 AS block_no, {_NTH} AS nth, l_extendedprice FROM lineitem)
  SELECT doc_id, nth AS row_no, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN nth % 5 = 0 THEN NULL ELSE 2.0 * nth END ELSE l_extendedprice END AS net_sales FROM r""")
def pinned_override(spark, d):
    r = _numbered(spark, d).select(F.col("l_suppkey").alias("doc_id"), F.lit(1).alias("block_no"), F.col("nth").cast("long").alias("row_no"), F.col("l_extendedprice").alias("net_sales"))
    pinned = r.where("doc_id % 2 = 0 OR row_no > 1").select("doc_id", "block_no", "row_no", F.when(F.col("row_no") % 5 != 0, 2.0 * F.col("row_no")).alias("pinned"))
    return mapping.override_by_ordinal(r, pinned).select("doc_id", "row_no", "net_sales")


_PRICE = "CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE rtrim(round(p_retailprice, 4)::DECIMAL(18,4)::VARCHAR, '0') END"
_HEADER = "'ITEM NO' || CASE WHEN twice THEN '' WHEN odd THEN ' | ITEM NO' ELSE ' | SKU' END || ' | DESCRIPTION | CATEGORY | INV DATE | NET SALES'"


@query(f"""WITH {GRIDS_SQL}
  SELECT p_brand AS doc_id, 1::BIGINT AS row_no, 'preamble' AS kind, 'Report of ' || p_brand AS line FROM b
  UNION ALL SELECT p_brand, 2, 'label', 'Sales Org' || repeat(' | ', 6) FROM b UNION ALL SELECT p_brand, 3, 'header', {_HEADER} FROM b
  UNION ALL SELECT p_brand, last + 11, 'total', CASE WHEN twice THEN '' ELSE ' | ' END || ' | Subtotal |  |  | 9.5' FROM b
  UNION ALL SELECT p_brand, last + 12, 'note', 'Figures are provisional' FROM b
  UNION ALL SELECT p_brand, row_no, kind, CASE kind WHEN 'note' THEN 'Note on ' || p_name
    WHEN 'total' THEN CASE WHEN twice THEN '' ELSE ' | ' END || ' | Subtotal |  |  | ' || p_retailprice::VARCHAR
    ELSE k || CASE WHEN twice THEN '' WHEN odd THEN ' | ' || k ELSE ' | K' || k END || ' | ' || p_name || ' | ' || p_type || ' | ' ||
      strftime(DATE '1899-12-30' + (45000 + k % 2000)::INT, '%Y-%m-%d') || ' | ' || {_PRICE} END FROM g""")
def normalized_reports(spark, d):
    return tables.normalize(report_grids(spark, d)).select("doc_id", "row_no", "kind", F.array_join("cells", " | ").alias("line"))


@query(f"WITH {GRIDS_SQL} SELECT p_brand AS doc_id, n_rows AS rows, n_totals AS dropped_totals, n_notes AS notes, (CASE WHEN twice THEN 5 ELSE 6 END)::INT AS columns, false AS pivot FROM b")
def normalize_metrics(spark, d):
    return tables.metrics(tables.normalize(report_grids(spark, d))).drop("block_no")


@query(f"""WITH {GRIDS_SQL} SELECT p_brand AS doc_id, k::VARCHAR AS part_no, p_name AS part_description, p_type AS product_family, DATE '1899-12-30' + (45000 + k % 2000)::INT AS date,
  round_even(p_retailprice, 2) AS net_sales FROM g WHERE kind = 'row'""")
def mapped_reports(spark, d):
    """One canonical row per data row of the messy reports."""
    mapped = mapping.canonical(tables.normalize(report_grids(spark, d)))
    return mapped.select("doc_id", "part_no", "part_description", "product_family", "date", "net_sales")


@query(f"WITH {GRIDS_SQL} SELECT p_brand AS doc_id, 3::BIGINT AS row_no, {_HEADER} AS line FROM b")
def header_inference(spark, d):
    return tables.normalize(report_grids(spark, d)).where("kind = 'header'").select("doc_id", "row_no", F.array_join("cells", " | ").alias("line"))


@query(f"""WITH {GRIDS_SQL} SELECT p_brand AS doc_id, unnest(['Report of ' || p_brand, 'Figures are provisional']) AS text, unnest(['preamble', 'note']) AS kind FROM b
  UNION ALL SELECT p_brand, 'Note on ' || p_name, 'note' FROM g WHERE kind = 'note'""")
def banners_and_notes(spark, d):
    return tables.normalize(report_grids(spark, d)).where("kind IN ('preamble', 'note')").select("doc_id", F.get("cells", F.lit(0)).alias("text"), "kind")


@query(f"WITH {GRIDS_SQL} SELECT p_brand AS doc_id, CASE WHEN odd THEN [0, 2, 3, 4, 5] ELSE [0, 1, 2, 3, 4, 5] END AS columns FROM b")
def column_dedup(spark, d):
    grid = report_grids(spark, d).where("row_no > 10")
    return tables.column_selection(grid.where(~tables.is_note(F.col("cells")) & ~tables.is_total(F.col("cells")))).select("doc_id", "columns")


@query("SELECT o_orderpriority AS doc_id, 'ALL CUSTOMERS COMBINED | x | ' || sum(o_orderkey % 3)::VARCHAR AS line FROM orders GROUP BY 1")
def pivot_collapse(spark, d):
    """Nested order sums repeat their figures, so only the grand total row is left."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_id"), F.col("o_orderkey").alias("k"))
    rows = o.select("doc_id", (F.col("k") + 2).alias("row_no"), F.array(F.concat(F.lit("order "), F.col("k").cast("string")), F.lit("x"), (F.col("k") % 3).cast("string")).alias("cells"))
    top = o.groupBy("doc_id").agg(F.sum(F.col("k") % 3).alias("s"), F.max("k").alias("last"))
    rows = rows.unionByName(top.select("doc_id", F.lit(1).cast("long").alias("row_no"), F.array(F.lit("label"), F.lit("mark"), F.lit("net")).alias("cells")))
    rows = rows.unionByName(top.select("doc_id", (F.col("last") + 3).alias("row_no"), F.array(F.lit("Grand Total"), F.lit("x"), F.col("s").cast("string")).alias("cells")))
    done = tables.normalize(rows.select("doc_id", F.lit(1).alias("block_no"), F.lit(None).cast("string").alias("sheet"), "row_no", "cells"))
    return done.where("kind = 'row'").select("doc_id", F.array_join("cells", " | ").alias("line"))


@query(f"""WITH h AS (SELECT *, right(p_brand, 1)::INT % 2 = 1 AS odd FROM part)
  SELECT p_brand AS doc_id, 0::BIGINT AS row_no, 'ITEM NO | DESCRIPTION | ' || CASE WHEN any_value(odd) THEN 'NET CURRENT' ELSE 'NET PRIOR YEAR | NET CURRENT | RANGE OF SALES' END AS line FROM h GROUP BY 1
  UNION ALL SELECT p_brand, p_partkey + 1, 'P' || p_partkey || ' | text ' || p_partkey || ' | ' ||
    CASE WHEN odd THEN {_PRICE} ELSE p_size || ' | ' || {_PRICE} || ' | ' || p_partkey || '5' END FROM h""")
def per_sheet_pin(spark, d):
    """On one sheet the pinned money column wins over prior and range columns; on the other no column has the pin's prefix."""
    pins = spark.createDataFrame([("SUMMARY", "net c"), (None, "gross")], "sheet string, prefix string")
    return tables.normalize(pinned_grids(spark, d), pins).select("doc_id", "row_no", F.array_join("cells", " | ").alias("line"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Sheet ' || c_custkey WHEN c_custkey % 3 = 1 THEN c_name END AS sheet,
  CASE WHEN c_custkey % 3 = 2 THEN 'Net ' || c_custkey END AS prefix FROM customer""")
def directive_parse(spark, d):
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('Only read the sheet named "Sheet '), k, F.lit('"; ignore the rest.'))).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("sheet: "), F.col("c_name"))
    ).otherwise(F.concat(F.lit('use "Net '), k, F.lit('" as netSales')))
    return table(spark, d, "customer").select("c_custkey", directives.sheet_name(text).alias("sheet"), directives.money_prefix(text).alias("prefix"))


@query(f"WITH docs AS ({DOCUMENTS_SQL}) SELECT id, is_cumulative OR id::BIGINT % 9 = 0 AS cumulative FROM docs")
def cumulative_detect(spark, d):
    """By the file name, or by a cell that says exactly YTD."""
    cells = F.array(F.lit("PYTD"), F.when(F.col("id").cast("long") % 9 == 0, " ytd ").otherwise("YTD sales"))
    return documents(spark, d).select("id", periods.looks_cumulative(F.col("original_file_name"), cells).alias("cumulative"))


@query("SELECT doc_id, 0 AS content_no, source AS sheet, md5(text) AS digest FROM documents")
def json_envelope_read(spark, d):
    raw = table(spark, d, "documents").select(
        "doc_id", envelope.envelope(F.col("source"), F.col("text"), F.col("n_chars"), F.lit("2026-01-01T00:00:00Z")).alias("raw_json")
    )
    return envelope.contents(raw).select("doc_id", "content_no", "sheet", F.md5("markdown").alias("digest"))


@query(f"""WITH docs AS ({DOCUMENTS_SQL}), known AS (SELECT id, status FROM docs WHERE id::BIGINT % 3 <> 0),
  polled AS (SELECT id, CASE WHEN status = 'Mapping' THEN 'Done' ELSE status END AS status FROM docs WHERE id::BIGINT % 4 <> 0)
  SELECT id, coalesce(p.status, k.status) AS status, k.status IS NULL AS is_new,
    coalesce(k.status IN ('Queued', 'Extracting', 'Mapping') AND p.status NOT IN ('Queued', 'Extracting', 'Mapping'), false) AS finished FROM known k FULL JOIN polled p USING (id)""")
def status_upsert(spark, d):
    docs = documents(spark, d)
    number = F.col("id").cast("long")
    polled = docs.where(number % 4 != 0).withColumn("status", F.when(F.col("status") == "Mapping", "Done").otherwise(F.col("status")))
    return an.upsert_status(docs.where(number % 3 != 0), polled)


@query(f"""WITH docs AS ({DOCUMENTS_SQL}), r AS (SELECT l_orderkey::VARCHAR AS id, count(*) AS raw_rows FROM lineitem GROUP BY 1),
  c AS (SELECT l_orderkey::VARCHAR AS id, sum(l_quantity)::DECIMAL(18,2) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT id, status, total_net_sales, raw_rows, quantity FROM docs LEFT JOIN r USING (id) LEFT JOIN c USING (id)""")
def document_details(spark, d):
    """Each document with what is held of it; a document without raw or canonical rows stays."""
    items = table(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey").cast("string"))
    raw = items.groupBy("doc_id").agg(F.count("*").alias("raw_rows"))
    canonical = items.where("l_returnflag = 'R'").groupBy("doc_id").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast(sc.CENTS).alias("quantity"))
    return an.details(documents(spark, d), raw, canonical).select("id", "status", "total_net_sales", "raw_rows", "quantity")


@query(f"""WITH docs AS ({DOCUMENTS_SQL}) SELECT status, CASE status WHEN 'Extracting' THEN 'Phase 1 · extracting' WHEN 'Mapping' THEN 'Phase 2 · mapping'
  WHEN 'Done' THEN 'Complete' WHEN 'Failed' THEN 'Failed · no table detected' ELSE status END AS label, count(*) AS n FROM docs GROUP BY ALL""")
def status_labels(spark, d):
    return documents(spark, d).groupBy("status", an.status_label(F.col("status")).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN count(l_orderkey) >= 5 THEN count(l_orderkey) ELSE 0 END AS detected FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def rows_detected(spark, d):
    return splitting.rows_detected(report_lines(spark, d))


@query(f"""WITH docs AS ({DOCUMENTS_SQL}), done AS (SELECT * FROM docs WHERE is_cumulative AND status = 'Done'
  QUALIFY row_number() OVER (PARTITION BY manufacturer, period_year, period_month ORDER BY upload_ts DESC, id) = 1),
  n AS (SELECT l_orderkey::VARCHAR AS id, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  j AS (SELECT d.id, l.id AS prev_id, l.original_file_name AS prev_file, d.period_month, d.period_year, coalesce(n_lines, 0) AS n_lines
    FROM docs d LEFT JOIN done l ON d.manufacturer = l.manufacturer AND {_BEFORE} LEFT JOIN n ON n.id = l.id WHERE d.is_cumulative),
  b AS (SELECT *, CASE WHEN prev_id IS NULL THEN CASE WHEN period_month = '01' THEN 'own' END WHEN n_lines > 0 THEN 'difference' END AS basis FROM j)
  SELECT id, prev_id, basis, CASE WHEN basis IS NULL THEN CASE WHEN prev_id IS NULL
    THEN 'Year-to-date figures, not those of ' || period_month || '/' || period_year || ' alone: the report of the month before is missing.'
    ELSE 'No lines are held of the month before (' || prev_file || '), so the month can''t be derived.' END END AS warning FROM b""")
def monthly_basis(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.count("*").alias("n_lines"))
    return an.monthly_basis(an.previous_document(documents(spark, d)), n)


@query(f"""WITH c AS (SELECT *, (nth - 1) // 90 + 1 AS chunk_no, (nth - 1) % 90 + 1 AS place FROM (SELECT *, {_NTH} AS nth FROM lineitem)),
  s AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey, chunk_no) AS n FROM c)
  SELECT l_suppkey, chunk_no::BIGINT AS chunk_no, (CASE WHEN n >= 4 AND place > n // 2 THEN 2 ELSE 1 END)::INT AS half_no, count(*) AS n_rows, sum(l_quantity)::DECIMAL(18,2) AS quantity FROM s GROUP BY ALL""")
def chunk_halves(spark, d):
    """Chunks that have to be tried again, in halves; the halves keep their chunk's number and order."""
    c = _numbered(spark, d).withColumn("chunk_no", tables.chunk_no(F.col("nth"))).withColumn("place", (F.col("nth") - 1) % 90 + 1)
    sizes = c.groupBy("l_suppkey", "chunk_no").agg(F.count("*").alias("n"))
    halves = c.join(sizes, ["l_suppkey", "chunk_no"]).withColumn("half_no", tables.half_no(F.col("place"), F.col("n")))
    return halves.groupBy("l_suppkey", "chunk_no", "half_no").agg(F.count("*").alias("n_rows"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast(sc.CENTS).alias("quantity"))


@query(f"""WITH c AS (SELECT *, ((nth - 1) // 90 + 1)::BIGINT AS chunk_no, l_orderkey % 501 = 0 AS bad FROM (SELECT *, {_NTH} AS nth FROM lineitem)),
  k AS (SELECT l_suppkey, chunk_no, count_if(bad) AS n_bad, sum(l_quantity)::DECIMAL(18,2) AS quantity FROM c GROUP BY ALL)
  SELECT l_suppkey, chunk_no, CASE WHEN n_bad = 0 THEN quantity END AS quantity,
    CASE WHEN n_bad > 0 THEN 'Chunk ' || chunk_no || ' of ' || l_suppkey || ' gave no rows: ' || n_bad || ' could not be read.' END AS warning FROM k""")
def failing_chunks(spark, d):
    """Unreadable quantities cost their chunk alone, with a warning."""
    text = F.when(F.col("l_orderkey") % 501 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    c = _numbered(spark, d).withColumn("chunk_no", tables.chunk_no(F.col("nth"))).withColumn("number", sc.net_double(text).cast("decimal(18,2)"))
    by = ["l_suppkey", "chunk_no"]
    name = F.concat(F.lit("Chunk "), F.col("chunk_no").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    kept, warnings = mapping.tolerated(c, F.col("number").isNull(), by, name)
    sums = kept.groupBy(*by).agg(F.sum("number").cast(sc.CENTS).alias("quantity"))
    return sums.join(warnings, by, "full_outer")


from reportloom.plans import job_queries, text_queries  # noqa: E402, F401  (register their own)
