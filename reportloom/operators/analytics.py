"""Aggregates, period derivations and listings on the canonical sales rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import periods
from reportloom.functions.scalars import CENTS, MONEY, money, norm_key, total, two_decimals, u_trim

#: The seven fields that identify a line across periods.
LINE_KEY = ["customer_id", "customer_name", "city", "state", "product_family", "part_no", "part_description"]
DONE, OPEN = "Done", ["Queued", "Extracting", "Mapping"]


def customer_key(customer_id: Column, name: Column) -> Column:
    """The id, or the name where there is no id; blank keys count as none."""
    key = F.coalesce(customer_id, name)
    return F.when(u_trim(key) != "", key)


def document_aggregates(sales: DataFrame, *by: str) -> DataFrame:
    """Totals, lines and customers of each document."""
    return sales.groupBy(*by).agg(
        total(F.col("net_sales")).alias("total_net_sales"),
        total(F.col("commission")).alias("total_commission"),
        F.count("*").alias("line_count"),
        F.countDistinct(customer_key(F.col("customer_id"), F.col("customer_name"))).alias("customer_count"),
    )


def latest_per_period(documents: DataFrame) -> DataFrame:
    """The newest cumulative document with a total of each manufacturer and period."""
    newest = Window.partitionBy("manufacturer", "period_year", "period_month").orderBy(F.desc("upload_ts"), "id")
    return (
        documents.where("is_cumulative AND total_net_sales IS NOT NULL")
        .withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    )


def with_previous(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each document with the previous period's totals (``prev_*``), by manufacturer and calendar month.

    A join on the shifted month, not a lag: a missing month must stay missing.
    """
    before = periods.previous_period(F.col("period_month"), F.col("period_year"))
    keyed = documents.withColumn("_b", before)
    prev = candidates.select(
        F.col("manufacturer").alias("_m"), F.col("period_month").alias("_pm"), F.col("period_year").alias("_py"),
        F.col("id").alias("prev_id"), F.col("original_file_name").alias("prev_file_name"),
        F.col("total_net_sales").alias("prev_net_sales"), F.col("total_commission").alias("prev_commission"),
    )
    on = (keyed["manufacturer"] == prev["_m"]) & (keyed["_b.month"] == prev["_pm"]) & (keyed["_b.year"] == prev["_py"])
    return keyed.join(prev, on, "left").drop("_m", "_pm", "_py", "_b")


def with_monthly(documents: DataFrame) -> DataFrame:
    """Adds the month's own figures, derived at read time so that upload order does not matter."""
    month = lambda own, prev: periods.derive_monthly(
        F.col("is_cumulative"), F.col("period_month"), F.col(own), F.col(prev)
    ).cast(CENTS)
    return (
        with_previous(documents, latest_per_period(documents))
        .withColumn("monthly_net_sales", month("total_net_sales", "prev_net_sales"))
        .withColumn("monthly_commission", month("total_commission", "prev_commission"))
    )


def previous_document(documents: DataFrame) -> DataFrame:
    """The newest finished cumulative document of the month before, for the line-level view."""
    newest = Window.partitionBy("manufacturer", "period_year", "period_month").orderBy(F.desc("upload_ts"), "id")
    done = documents.where((F.col("status") == DONE) & F.col("is_cumulative"))
    done = done.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return with_previous(documents, done).where("prev_id IS NULL OR prev_id <> id")


#: What a derived month line takes from a line that is held.
TEMPLATE = ["source_name", "manufacturer", *LINE_KEY]
#: A key as two hashes of different seeds, 128 bits: the longs are shuffled and sorted instead of seven texts.
_KEY = ["_h", "_g"]


def line_parts(lines: DataFrame, by: list[str], since: Column, until: Column, *more: Column) -> DataFrame:
    """Lines summed under their key and their months: _h, _g, by, parts (_from, _to, net, comm and the aggregates ``more``)."""
    keys = [norm_key(F.col(c)) for c in LINE_KEY]
    lines = lines.withColumns({"_h": F.xxhash64(*keys), "_g": F.xxhash64(F.lit(1), *keys), "_from": since.cast("int"), "_to": until.cast("int")})
    parts = lines.groupBy(*_KEY, *by, "_from", "_to").agg(
        F.sum(money(F.col("net_sales"))).cast(MONEY).alias("net"), F.sum(money(F.col("commission"))).cast(MONEY).alias("comm"), *more
    )
    fields = [c for c in parts.columns if c not in (*_KEY, *by)]
    return parts.groupBy(*_KEY, *by).agg(F.collect_list(F.struct(*fields)).alias("parts"))


def moved_parts(lists: DataFrame, by: list[str], reports: DataFrame | None = None) -> DataFrame:
    """The months in which a figure of a key moved: by, month, _net, _comm, _now and _before (the parts that stand in that month's report and in the one before)."""
    # Only where a part begins, or the month after it ends, can a figure move.
    edges = F.array_distinct(F.concat(F.transform("parts", lambda p: p["_from"]), F.filter(F.transform("parts", lambda p: p["_to"] + 1), lambda m: m <= 12)))
    moved = lists.withColumn("month", F.explode(edges))
    if reports is not None:
        held = reports.groupBy(*by).agg(F.collect_set(F.col("month").cast("int")).alias("_held"))
        moved = moved.join(held, by).where(F.array_contains("_held", F.col("month")) & ((F.col("month") == 1) | F.array_contains("_held", F.col("month") - 1)))
    within = lambda month: F.filter("parts", lambda p: (p["_from"] <= month) & (month <= p["_to"]))
    zero = F.lit(0).cast(MONEY)
    added = lambda ps, f: F.aggregate(ps, zero, lambda acc, p: (acc + p[f]).cast(MONEY))
    moved = moved.withColumn("_now", within(F.col("month"))).withColumn("_before", within(F.col("month") - 1))
    diff = lambda f: added("_now", f) - added("_before", f)
    return moved.withColumn("_net", diff("net")).withColumn("_comm", diff("comm")).where("_net <> 0 OR _comm <> 0")


def line_figures(lines: DataFrame, by: list[str], since: Column, until: Column, reports: DataFrame | None = None) -> DataFrame:
    """by, month, net_sales and commission of each row that :func:`line_deltas` gives; no text is carried for them."""
    moved = moved_parts(line_parts(lines, by, since, until), by, reports)
    return moved.select(*by, "month", two_decimals(F.col("_net")).alias("net_sales"), two_decimals(F.col("_comm")).alias("commission"))


def line_deltas(lines: DataFrame, order: list[str], by: list[str], since: Column, until: Column, reports: DataFrame | None = None) -> DataFrame:
    """Month rows of year-to-date reports, each against the report of the month before.

    ``lines`` are report lines, ``by`` what one year's reports have in common, year included
    (a column ``year``). A line stands in the reports of the months ``since`` to ``until`` (1
    to 12; the same month where each report brings its own lines). ``reports`` (by, month)
    says which reports there are, else all twelve. January's report is its own month; a
    report without one the month before gives no rows.

    A line's figures are summed under its key, however spelt; lines that moved in neither
    figure are left out before rounding. A line that vanished counts as what it takes back. The row's
    text is that of the first line (by ``order``) in the month's own report, else in the one
    before. Quantities don't accumulate, so there are none; the date is the month's first day.

    Lines are summed before anything is compared, and all months of a key are compared in
    its one row: its parts differ in their months alone, so there are 78 at most. Keys are
    told apart by 128-bit hashes, and each text is carried once.
    """
    text = [c for c in TEMPLATE if c not in by]
    # Among lines alike in ``order`` the rest of the text decides; what ``order`` holds already is not held again.
    rest = [c for c in text if c not in order and c in lines.columns]
    firsts = F.min(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), *rest)).alias("first")
    moved = moved_parts(line_parts(lines, by, since, until, firsts), by, reports)
    first = lambda ps: F.array_min(F.transform(ps, lambda p: p["first"]))
    place = lambda c: F.col(f"_row.o{order.index(c)}") if c in order else F.col(f"_row.{c}") if c in rest else F.lit(None).cast("string")
    return moved.withColumn("_row", F.coalesce(first(F.col("_now")), first(F.col("_before")))).select(
        *by, "month", F.make_date("year", "month", F.lit(1)).alias("date"), *(place(c).alias(c) for c in text),
        F.lit(None).cast("decimal(38,10)").alias("quantity"), two_decimals(F.col("_net")).alias("net_sales"), two_decimals(F.col("_comm")).alias("commission"),
    )


def line_delta(current: DataFrame, previous: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The month rows of one year-to-date line set against the one before it (see :func:`line_deltas`)."""
    by = by or []
    columns = [c for c in [*by, *TEMPLATE, *order, "net_sales", "commission"] if c in current.columns]
    pick = lambda rows, month: rows.select(*dict.fromkeys(columns), F.lit(2000).alias("year"), F.lit(month).alias("_m"))
    both = pick(previous, 1).unionByName(pick(current, 2))
    found = line_deltas(both, order, [*by, "year"], F.col("_m"), F.col("_m")).where("month = 2")
    return found.select(*by, *(c for c in TEMPLATE if c in current.columns and c not in by), "net_sales", "commission")


#: What the listing shows of a document; its JSON stays unread.
LISTED = [
    "id", "original_file_name", "file_size_bytes", "upload_ts", "manufacturer", "period_month", "period_year", "status", "progress_pct", "error_message",
    "has_warnings", "total_net_sales", "total_commission", "line_count", "customer_count", "custom_instructions", "is_cumulative",
]


def listing(documents: DataFrame) -> DataFrame:
    """Newest first, without the JSON columns, with the month's figures."""
    return with_monthly(documents).select(*LISTED, "monthly_net_sales", "monthly_commission").orderBy(F.desc("upload_ts"), "id")


def details(documents: DataFrame, raw: DataFrame, canonical: DataFrame, document: str | None = None) -> DataFrame:
    """Documents with what is held of each, at most one row on either side (both keyed by doc_id); one document if its id is given."""
    found = documents if document is None else documents.where(F.col("id") == document)
    for part in (raw, canonical):
        found = found.join(part, found["id"] == part["doc_id"], "left").drop("doc_id")
    return found


#: How each status is shown.
STATUS_LABELS = {
    "Queued": "Queued", "Extracting": "Phase 1 · extracting", "Mapping": "Phase 2 · mapping", "Done": "Complete", "Failed": "Failed · no table detected",
}


def status_label(status: Column) -> Column:
    """The status as shown; an unknown one as it is."""
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, status), status)


def monthly_basis(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether a cumulative document's own month can be derived line by line: id, prev_id, basis, warning.

    ``documents`` have their previous document (see :func:`previous_document`), ``lines``
    (doc_id, n_lines) how many lines are held of each. The basis is the difference to
    the previous document, the document itself in January, or null with a warning
    where the previous document is missing or holds no lines.
    """
    held = lines.select(F.col("doc_id").alias("prev_id"), "n_lines")
    n = F.coalesce("n_lines", F.lit(0))
    basis = F.when(F.col("prev_id").isNull(), F.when(periods.is_first_of_year(F.col("period_month")), "own")).when(n > 0, "difference")
    period = F.concat_ws("/", "period_month", "period_year")
    warning = F.when(F.col("prev_id").isNull(), F.concat(F.lit("Year-to-date figures, not those of "), period, F.lit(" alone: the report of the month before is missing."))).otherwise(
        F.concat(F.lit("No lines are held of the month before ("), F.coalesce("prev_file_name", F.lit("")), F.lit("), so the month can't be derived."))
    )
    return documents.where("is_cumulative").join(held, "prev_id", "left").select("id", "prev_id", basis.alias("basis"), F.when(basis.isNull(), warning).alias("warning"))


def batch_rollup(listed: DataFrame) -> DataFrame:
    """Counts and headline sums of a batch: the month's figure of cumulative documents, else the total."""
    done = F.col("status") == DONE
    head = lambda m, t: F.when(done, F.coalesce(F.when(F.col("is_cumulative"), F.col(m)), F.col(t)))
    return listed.agg(
        F.count("*").alias("documents"), F.count_if(done).alias("done"), F.count_if(F.col("status").isin(OPEN)).alias("running"),
        F.count_if(F.coalesce(F.col("has_warnings"), F.lit(False))).alias("flagged"),
        total(head("monthly_net_sales", "total_net_sales")).alias("net_sales"),
        total(head("monthly_commission", "total_commission")).alias("commission"),
    )


def coverage_warning(lines: Column, detected: Column, instructions: Column) -> Column:
    """What to say where a document yielded fewer lines than its tables hold rows; else null."""
    told = F.when(u_trim(F.coalesce(instructions, F.lit(""))) != "", " The instructions may filter rows on purpose.").otherwise("")
    return (
        F.when((lines == 0) & (detected == 0), "Nothing extracted: no table content found.")
        .when(lines == 0, F.concat(F.lit("Nothing extracted although about "), detected.cast("string"), F.lit(" source rows were found.")))
        .when(
            (detected > 0) & (lines * 100 < detected * 85),
            F.concat(lines.cast("string"), F.lit(" lines for about "), detected.cast("string"), F.lit(" source rows."), told),
        )
    )


def warning_text(mapper: Column, document: Column) -> Column:
    """Mapper warnings in order, document warnings after them, the first ten."""
    return F.array_join(F.slice(F.concat(F.array_sort(mapper), document), 1, 10), " | ")


def upsert_status(known: DataFrame, polled: DataFrame) -> DataFrame:
    """Known documents with polled statuses, unknown ids added, with what changed."""
    new = polled.select("id", F.col("status").alias("_status"))
    joined = known.select("id", "status").join(new, "id", "full_outer")
    was, now = F.col("status").isin(OPEN), F.col("_status").isin(OPEN)
    return joined.select(
        "id", F.coalesce("_status", "status").alias("status"), F.col("status").isNull().alias("is_new"),
        F.coalesce(was & ~now, F.lit(False)).alias("finished"),
    )
