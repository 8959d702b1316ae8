"""Column expressions for the report dialect's numbers, dates and keys.

Cells are strings; nothing here raises on a dirty cell, also under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Money is summed in this type, never as double.
MONEY = "decimal(18,4)"
CENTS = "decimal(18,2)"

#: The number syntax that counts as numeric.
NUMBER = r"^\s*[¤]?\s*([+-]?\s*[¤]?\s*([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*[¤]?\s*[+-]?|\(\s*[¤]?\s*([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\))\s*$"
#: Serial day numbers that may be dates, and day zero.
SERIALS = (20_000, 65_000)
SERIAL_EPOCH = "1899-12-30"


#: What Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def u_trim(c: Column) -> Column:
    """Trims all Unicode white space, not just U+0020."""
    return F.btrim(c, F.lit(WHITE))


def norm_key(c: Column) -> Column:
    """Null as empty, trimmed, upper case."""
    return F.upper(u_trim(F.coalesce(c, F.lit(""))))


#: Most cells: digits with at most a leading minus and a fraction, which a cast reads as they are.
PLAIN = r"^-?[0-9]+(\.[0-9]+)?$"


def net_double(c: Column) -> Column:
    """A cell as double, or null: signs before or after, parentheses, thousands commas, exponents."""
    return F.when(c.rlike(PLAIN), c.try_cast("double")).otherwise(_marked_double(c))


def _marked_double(c: Column) -> Column:
    signs = F.length(F.regexp_replace(c, r"[eE][+-]", "e")) - F.length(F.regexp_replace(F.regexp_replace(c, r"[eE][+-]", "e"), r"[+-]", ""))
    body = F.regexp_replace(c, r"[\s,()¤]", "")
    lead = F.regexp_replace(body, r"^[+-]|[+-]$", "")
    negative = c.rlike(r"^\s*\(|^[\s¤]*-|-[\s¤]*$")
    value = lead.try_cast("double")
    return F.when(c.rlike(NUMBER) & (signs <= 1), F.when(negative, -value).otherwise(value))


def is_numeric(c: Column) -> Column:
    return net_double(c).isNotNull()


def plain_number(d: Column) -> Column:
    """A double with at most four decimals, halves away from zero, no trailing zeros."""
    text = F.round(d, 4).cast("decimal(38,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def serial_date(d: Column) -> Column:
    """A spreadsheet's day number as date; the time of day is cut off."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), d.cast("int"))


def clean_cell(cell: Column, in_date_column: Column) -> Column:
    """Day numbers of date columns as ISO dates, float noise rounded away, anything else as it is."""
    d = net_double(cell)
    rounded = F.when(F.contains(cell, F.lit(".")), F.coalesce(plain_number(d), cell)).otherwise(cell)
    date = F.when((d >= SERIALS[0]) & (d <= SERIALS[1]), F.date_format(serial_date(d), "yyyy-MM-dd"))
    return F.when(in_date_column, F.coalesce(date, rounded)).otherwise(rounded)


def money(c: Column) -> Column:
    """A stored double or decimal for summing, null as zero."""
    return F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))


def total(c: Column) -> Column:
    """Sum of money in cents; an empty sum is zero."""
    return F.coalesce(F.sum(money(c)), F.lit(0)).cast(CENTS)


def two_decimals(c: Column) -> Column:
    """Banker's rounding to cents."""
    return F.bround(c, 2).cast(CENTS)
