"""Report text to clean table rows.

Lines become blocks (gaps and islands), blocks become rows of string cells, and
rows become header, data, notes and preamble. Rows carry their place, since a
DataFrame has no order. A block is never collected: what a rule needs to know
about its block is an aggregate joined back or a window over narrow columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions.scalars import clean_cell, is_numeric, net_double, u_trim
from reportloom.session import settled, swept

#: The patterns of the report dialect.
ROW = r"(?sU)^\s*\|.*\|\s*$"
SEPARATOR = r"(?U)^\s*\|[\s:\-|]+\|\s*$"
HEADING = r"(?U)^#\s+(.+?)\s*$"
TOTAL_LABEL = r"(?iU)^\s*((grand|overall)\s+)?(total|totals|subtotal|sub-total|sum|result)\b"
GRAND_TOTAL = r"(?iU)^(grand total|total g.n.ral)$"
DATE_HEADER = r"(?iU)(^|\s|_)(DT|DATE|DATES)($|\s|_)|DATE"
OTHER_PERIOD = r"(?iU)\brange\b|\bprior\b"
COMBINED = "ALL CUSTOMERS COMBINED"
HEADER_ROWS, SAME_COLUMN, NUMERIC_SHARE, REPEAT_SHARE = 60, 0.9, 0.5, 0.3
PREAMBLE_CHARS, CHUNK_ROWS, TEXT_CHARS, LEAST_ROWS = 2000, 90, 45_000, 5

BLOCK = ["doc_id", "block_no"]


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, line ends unified: doc_id, line_no, line."""
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("line_no", "line"))


def classified(lines: DataFrame) -> DataFrame:
    """Adds is_row, is_separator, sheet (the latest heading) and block_no (null outside tables)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    heading = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 1))
    is_row = F.col("line").rlike(ROW) & (F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 2)
    opens = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(order), F.lit(False))
    return (
        lines.withColumn("is_row", is_row).withColumn("is_separator", F.col("line").rlike(SEPARATOR))
        .withColumn("sheet", F.last(heading, ignorenulls=True).over(order))
        .withColumn("block_no", F.when(F.col("is_row"), F.sum(opens.cast("int")).over(order)))
    )


def split_cells(line: Column) -> Column:
    """Cells of a table line: one leading and one trailing pipe go, cells are trimmed."""
    inner = F.regexp_replace(F.regexp_replace(u_trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), u_trim)


def grid(lines: DataFrame) -> DataFrame:
    """Table rows without separators, as wide as their block: doc_id, block_no, sheet, row_no, cells."""
    rows = classified(lines).where("is_row AND NOT is_separator").select(
        "doc_id", "block_no", "sheet", F.col("line_no").alias("row_no"), split_cells(F.col("line")).alias("cells")
    )
    return rectangular(rows)


def rectangular(rows: DataFrame) -> DataFrame:
    width = F.max(F.size("cells")).over(Window.partitionBy(*BLOCK))
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), (width - F.size("cells")).cast("int"))))


def is_banner(cells: Column) -> Column:
    """A title spread over merged cells: three or more filled, three or fewer distinct, one of them thrice."""
    ne = filled(cells)
    most = F.array_max(F.transform(F.array_distinct(ne), lambda v: F.size(F.filter(ne, lambda x: x == v))))
    return (F.size(ne) >= 3) & (F.size(F.array_distinct(ne)) <= 3) & (most >= 3)


def banner_text(cells: Column) -> Column:
    """The most frequent value, then the longest, then the first."""
    ne = filled(cells)
    ranked = F.transform(
        F.array_distinct(ne),
        lambda v: F.struct(F.size(F.filter(ne, lambda x: x == v)).alias("n"), F.length(v).alias("l"), (-F.array_position(ne, v)).alias("p"), v.alias("v")),
    )
    return F.array_max(ranked)["v"]


def is_total(cells: Column) -> Column:
    """Any cell that starts as an aggregate label, wherever the report puts it."""
    return F.exists(cells, lambda c: c.rlike(TOTAL_LABEL))


def is_note(cells: Column) -> Column:
    return (F.size(cells) >= 4) & (F.size(filled(cells)) == 1)


def column_selection(body: DataFrame) -> DataFrame:
    """For each block the columns to keep: not empty, not a repeat of the last kept one.

    Only columns that may stand next to each other once others are gone are compared.
    Taking for granted that all filled columns stay, these are the neighbours; where some
    turn out to be repeats, the pairs that this opens are compared in a further round, in
    the blocks concerned alone. So a row of W cells is looked at about twice W times, not
    W * W, and there are as many rounds as columns repeat one another in a row.
    """
    bits = 62
    parts = F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / bits).cast("int"))
    part = F.transform(F.slice("cells", F.col("part") * bits + 1, F.lit(bits)), lambda c, i: F.when(c != "", F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    mask = F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    filled_in = body.select(*BLOCK, "cells", F.explode(parts).alias("part")).groupBy(*BLOCK, "part").agg(F.max(F.size("cells")).alias("w"), F.bit_or(mask).alias("mask"))
    masks = F.transform(F.sort_array(F.collect_list(F.struct("part", "mask"))), lambda x: x["mask"])
    blocks = settled(filled_in.groupBy(*BLOCK).agg(F.max("w").alias("w"), masks.alias("masks")))
    known: DataFrame | None = None

    def step(acc: Column, j: Column) -> Column:
        word = F.get("masks", F.floor(j / bits).cast("int"))
        there = F.call_function("shiftright", word, j % bits).bitwiseAND(F.lit(1)) == 1
        key = acc["last"] * F.col("w") + j
        repeat = F.try_element_at("known", key)
        keeps = F.struct(j.alias("last"), F.concat(acc["kept"], F.array(j)).alias("kept"), F.concat(acc["open"], F.when((acc["last"] >= 0) & repeat.isNull(), F.array(key)).otherwise(F.array().cast("array<int>"))).alias("open"))
        return F.when(~there | F.coalesce(repeat, F.lit(False)), acc).otherwise(keeps)

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(-1).alias("last"), none.alias("kept"), none.alias("open"))
    while True:
        if known is None:
            told = blocks.withColumn("known", F.create_map().cast("map<int,boolean>"))
        else:
            maps = known.groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("key", "repeat"))).alias("known"))
            told = blocks.join(maps, BLOCK, "left")
        chain = F.aggregate(F.sequence(F.lit(0), F.col("w") - 1), start, step)
        chains = settled(told.withColumn("c", chain).select(*BLOCK, "w", "c.kept", "c.open"))
        asked = chains.where(F.size("open") > 0)
        if asked.isEmpty():
            return chains.select(*BLOCK, "w", F.col("kept").alias("columns"))
        pair = body.join(asked.select(*BLOCK, "w", "open"), BLOCK).select(*BLOCK, "w", "cells", F.explode("open").alias("key"))
        x, y = F.get("cells", F.floor(F.col("key") / F.col("w")).cast("int")), F.get("cells", F.col("key") % F.col("w"))
        counted = pair.groupBy(*BLOCK, "key").agg(F.count_if((x != "") | (y != "")).alias("either"), F.count_if((x == y) & (x != "")).alias("same"))
        found = settled(counted.select(*BLOCK, "key", (F.col("same") >= SAME_COLUMN * F.col("either")).alias("repeat")))
        known = found if known is None else settled(known.unionByName(found))


def normalize(rows: DataFrame, pins: DataFrame | None = None, banners_in_body: bool = True) -> DataFrame:
    """Rows of a grid with their kind: doc_id, block_no, sheet, row_no, kind, cells.

    Kinds: preamble (one cell), header, row, note (one cell), total, blank,
    label (a lone field name above the table). ``pins`` (sheet, prefix; null
    sheet for all; with doc_id for that document alone) names the money column that
    must win over prior or range columns. ``banners_in_body`` keeps data rows such as ``Acme, 0, 0, 0`` that
    look like a banner; False drops them as kind banner.
    """
    block = Window.partitionBy(*BLOCK)
    ne = filled(F.col("cells"))
    lone = (F.size(ne) == 1) & ~is_numeric(F.get(ne, F.lit(0)))
    rows = rows.withColumn("_blank", F.size(ne) == 0).withColumn("_banner", is_banner(F.col("cells")))
    rows = rows.withColumn("_start", F.min(F.when(~F.col("_blank") & ~F.col("_banner") & ~lone, F.col("row_no"))).over(block))
    above = F.col("_start").isNull() | (F.col("row_no") < F.col("_start"))
    rows = rows.withColumn(
        "kind",
        F.when(F.col("_blank"), "blank").when(above & F.col("_banner"), "preamble").when(above, "label")
        .when(F.col("_banner") & F.lit(not banners_in_body), "banner").otherwise("body"),
    ).withColumn("cells", F.when(F.col("kind") == "preamble", F.array(banner_text(F.col("cells")))).otherwise(F.col("cells")))
    aside = rows.where("kind <> 'body'").select(*BLOCK, "sheet", "row_no", "kind", "cells")
    # All that follows looks at the body again and again: it is worked out once.
    body = swept(rows.where("kind = 'body'").select(*BLOCK, "sheet", "row_no", "cells"))
    picked = column_selection(body)
    body = body.join(picked.select(*BLOCK, "columns"), BLOCK).select(*BLOCK, "sheet", "row_no", F.transform("columns", lambda i: F.get("cells", i)).alias("cells"))

    # Header: of the first rows, the one with the most distinct labels and no number.
    head = body.withColumn("_nth", F.row_number().over(block.orderBy("row_no"))).where(F.col("_nth") <= HEADER_ROWS)
    labels = filled(F.col("cells"))
    fits = (F.size(labels) >= 4) & ~F.exists(labels, is_numeric)
    score = F.struct(F.when(fits, F.size(F.array_distinct(labels))).otherwise(0).alias("s"), (-F.col("row_no")).alias("r"))
    header = head.groupBy(*BLOCK).agg(F.max_by(F.struct("row_no", "cells"), score).alias("h")).select(
        *BLOCK, F.col("h.row_no").alias("_at"), F.col("h.cells").alias("_header")
    )
    if pins is not None:
        of = ["doc_id"] if "doc_id" in pins.columns else []
        own = pins.where("sheet IS NOT NULL").groupBy(*of, F.lower("sheet").alias("_s")).agg(F.max("prefix").alias("_own"))
        common = pins.where("sheet IS NULL").groupBy(*of).agg(F.max("prefix").alias("_all"))
        sheets = rows.groupBy(*BLOCK).agg(F.lower(F.first("sheet")).alias("_s"))
        pinned = sheets.join(own, [*of, "_s"], "left")
        pinned = pinned.join(common, of, "left") if of else pinned.join(common, F.lit(True), "left")
        header = header.join(pinned.select(*BLOCK, F.coalesce("_own", "_all").alias("_pin")), BLOCK, "left")
    else:
        header = header.withColumn("_pin", F.lit(None).cast("string"))
    starts = lambda c: F.startswith(F.lower(c), F.lower("_pin"))
    stay = F.filter(
        F.sequence(F.lit(0), F.size("_header") - 1),
        lambda i: starts(F.get("_header", i)) | ~F.get("_header", i).rlike(OTHER_PERIOD),
    )
    everything = F.sequence(F.lit(0), F.size("_header") - 1)
    header = header.withColumn("_stay", F.when(F.exists("_header", lambda h: F.coalesce(starts(h), F.lit(False))), stay).otherwise(everything))
    pick = lambda c: F.transform("_stay", lambda i: F.get(c, i))
    body = body.join(header, BLOCK).withColumn("cells", pick("cells")).withColumn("_header", pick("_header"))
    data = body.where(F.col("row_no") > F.col("_at"))

    # A nested pivot repeats its money once per level: only its grand total counts.
    data = data.withColumn("_grand", F.min(F.when(F.exists("cells", lambda c: c.rlike(GRAND_TOTAL)), F.col("row_no"))).over(block))
    others = data.where("_grand IS NOT NULL AND row_no <> _grand")
    shares = others.select(*BLOCK, F.posexplode("cells").alias("i", "c")).groupBy(*BLOCK, "i").agg(
        F.avg(is_numeric(F.col("c")).cast("int")).alias("share")
    ).where(F.col("share") >= NUMERIC_SHARE).groupBy(*BLOCK).agg(F.sort_array(F.collect_list("i")).alias("numeric"))
    prints = others.join(shares, BLOCK).withColumn("print", F.transform("numeric", lambda i: F.get("cells", i)))
    pivots = (
        prints.groupBy(*BLOCK, "print").agg(F.count("*").alias("n"))
        .groupBy(*BLOCK).agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.exists("print", lambda c: c != ""), F.col("n"))).alias("filled"),
            F.sum(F.when(F.exists("print", lambda c: c != ""), F.col("n") - 1)).alias("repeats"),
        ).where((F.col("rows") >= 5) & (F.col("repeats") >= REPEAT_SHARE * F.col("filled"))).select(*BLOCK, F.lit(True).alias("_pivot"))
    )
    data = data.join(pivots, BLOCK, "left").withColumn("_pivot", F.coalesce("_pivot", F.lit(False)))
    relabel = F.transform("cells", lambda c: F.when(c.rlike(GRAND_TOTAL), COMBINED).otherwise(c))
    dates = lambda i: F.get("_header", i).rlike(DATE_HEADER)
    cleaned = F.transform("cells", lambda c, i: clean_cell(c, dates(i)))
    kind = (
        F.when(F.col("_pivot"), F.when(F.col("row_no") == F.col("_grand"), "row").otherwise("total"))
        .when(is_total(F.col("cells")), "total").when(is_note(F.col("cells")), "note").otherwise("row")
    )
    data = data.withColumn("kind", kind).withColumn(
        "cells",
        F.when(F.col("kind") == "note", filled(F.col("cells")))
        .when(F.col("_pivot") & (F.col("kind") == "row"), relabel).otherwise(F.when(F.col("kind") == "row", cleaned).otherwise(F.col("cells"))),
    )
    upper = body.where(F.col("row_no") <= F.col("_at")).withColumn(
        "kind", F.when(F.col("row_no") == F.col("_at"), "header").otherwise("preamble")
    ).withColumn("cells", F.when(F.col("kind") == "preamble", F.array(F.array_join(F.array_distinct(filled(F.col("cells"))), " "))).otherwise(F.col("cells")))
    columns = [*BLOCK, "sheet", "row_no", "kind", "cells"]
    return data.select(columns).unionByName(upper.select(columns)).unionByName(aside.select(columns))


def metrics(normalized: DataFrame) -> DataFrame:
    """Counters of each block: rows, dropped totals, notes, columns, whether a pivot was collapsed."""
    return normalized.groupBy(*BLOCK).agg(
        F.count_if(F.col("kind") == "row").alias("rows"),
        F.count_if(F.col("kind") == "total").alias("dropped_totals"),
        F.count_if(F.col("kind") == "note").alias("notes"),
        F.coalesce(F.max(F.when(F.col("kind") == "header", F.size("cells"))), F.lit(0)).alias("columns"),
        F.coalesce(F.bool_or((F.col("kind") == "row") & F.array_contains("cells", F.lit(COMBINED))), F.lit(False)).alias("pivot"),
    )


def to_markdown(normalized: DataFrame) -> DataFrame:
    """Export only: one text per block. Pipes in cells are escaped."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |"))
    text = F.when(F.col("kind") == "header", F.concat(line, rule)).when(F.col("kind") == "row", line).when(
        F.col("kind").isin("preamble", "note"), F.get("cells", F.lit(0))
    )
    place = F.when(F.col("kind") == "preamble", 0).when(F.col("kind") == "header", 1).when(F.col("kind") == "row", 2).otherwise(3)
    kept = normalized.withColumn("_t", text).where("_t IS NOT NULL").withColumn("_p", place)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_p", "row_no", "_t"))), lambda s: s["_t"])
    return kept.groupBy(*BLOCK).agg(F.array_join(rows, "\n").alias("markdown"))


def separator_blocks(lines: DataFrame) -> DataFrame:
    """The lines of blocks that hold nothing but separators, as they are: doc_id, block_no, sheet, row_no, kind (verbatim), cells (the line)."""
    rows = classified(lines).where("is_row")
    only = rows.groupBy(*BLOCK).agg(F.bool_and("is_separator").alias("_only")).where("_only").select(*BLOCK)
    return rows.join(only, BLOCK, "left_semi").select(*BLOCK, "sheet", F.col("line_no").alias("row_no"), F.lit("verbatim").alias("kind"), F.array("line").alias("cells"))


def half_no(nth: Column, rows: Column, least: int = 4) -> Column:
    """The half of a chunk that its n-th row (from 1) goes to: 1 or 2; a chunk of fewer than ``least`` rows stays whole."""
    return F.when((rows >= least) & (nth > F.floor(rows / 2)), 2).otherwise(1)


def chunk_no(row_number: Column, rows: int = CHUNK_ROWS) -> Column:
    """The chunk of a table's n-th row, both from 1."""
    return F.floor((row_number - 1) / rows) + 1


def text_chunks(text: Column, most: int = TEXT_CHARS) -> Column:
    """Paragraphs packed greedily into chunks of at most ``most`` characters; a longer one stands alone."""
    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(last, F.lit("\n\n"), p)
        return F.when(last.isNotNull() & (F.length(joined) <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.split(text, "\n\n"), F.array().cast("array<string>"), add)


def sample_rows(rows: DataFrame, by: list[str], order: list[Column], head: int = 12, tail: int = 3) -> DataFrame:
    """The first rows of each table, and the last ones where there are more."""
    w = Window.partitionBy(*by)
    return (
        rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
        .where((F.col("_n") <= head) | ((F.col("_all") > head + tail) & (F.col("_n") > F.col("_all") - tail))).drop("_n", "_all")
    )


def pinned_values(rows: DataFrame, header_index: Column) -> DataFrame:
    """The pinned column's numbers; what is blank or no number stays null."""
    return rows.withColumn("pinned", net_double(F.get("cells", header_index)))
