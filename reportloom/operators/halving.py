"""Chunks that fail are tried again in halves, until what fails is too small to be cut.

Failures are rows, not exceptions: a round maps all parts that are still open in one job,
keeps the rows of those that went well and cuts the others. Parts shrink by half, so there
are as many rounds as a chunk has doublings, however many chunks fail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.operators.tables import half_no
from reportloom.session import settled

#: Maps parts: takes rows and the columns that tell parts apart, returns mapped rows (with these columns) and a row for each part that failed, with its ``message``.
Work = Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame]]


def in_halves(rows: DataFrame, by: list[str], work: Work, order: str = "nth", least: int = 4) -> tuple[DataFrame, DataFrame]:
    """All rows that could be mapped, and what was lost: by, part, n_rows, message.

    ``rows`` are chunks by ``by``, whose rows ``order`` numbers. ``part`` says which half of which
    half a row was mapped in (``12``: the second half of the first), so ordering by it, or by
    ``order`` alone, puts the halves together again. A part that fails with fewer than
    ``least`` rows is lost.
    """
    key = [*by, "part"]
    open_ = rows.withColumn("part", F.lit(""))
    kept: list[DataFrame] = []
    lost: list[DataFrame] = []
    while True:
        mapped, failures = work(open_, key)
        failures = settled(failures.select(*key, "message"))
        kept.append(settled(mapped.join(failures, key, "left_anti")))
        parts = Window.partitionBy(*key)
        again = open_.join(failures, key).withColumn("_n", F.count("*").over(parts)).withColumn("_at", F.row_number().over(parts.orderBy(order)))
        lost.append(settled(again.where(F.col("_n") < least).groupBy(*key).agg(F.count("*").alias("n_rows"), F.first("message").alias("message"))))
        halves = again.where(F.col("_n") >= least).withColumn("part", F.concat("part", half_no(F.col("_at"), F.col("_n"), least).cast("string")))
        open_ = settled(halves.select(*rows.columns, "part"))
        if open_.isEmpty():
            union = lambda frames: reduce(DataFrame.unionByName, frames)
            return union(kept), union(lost)
