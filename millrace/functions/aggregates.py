"""Aggregates over dynamic text: each is a combination of built-in aggregates, so partial sums travel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import failed, number

WHOLE = r"^[+-]?[0-9]{1,19}$"


def total(text: Column) -> Column:
    """struct<i long, d double>: i where all values are whole and their sum fits, else d; both null without values; other text ends the query."""
    trimmed = F.trim(text)
    whole = F.when(trimmed.rlike(WHOLE), trimmed.try_cast("long"))
    checked = F.when(text.isNotNull() & number(text).isNull(), failed("InvalidDataType", text, "double")).otherwise(number(text))
    longs = F.sum(whole.cast("decimal(38,0)"))
    exact = (F.count(text) == F.count(whole)) & (F.abs(longs) <= F.lit("9223372036854775807").cast("decimal(38,0)"))
    return F.struct(F.when(exact, longs.try_cast("long")).alias("i"), F.when(~exact, F.sum(checked)).alias("d"))


def mean(text: Column) -> Column:
    checked = F.when(text.isNotNull() & number(text).isNull(), failed("InvalidDataType", text, "double")).otherwise(number(text))
    return F.avg(checked)


def extreme(text: Column, greatest: bool = False) -> Column:
    """MIN or MAX of text: by number where all values read as numbers, else bytewise; the value keeps its own form.

    Equal numbers in several forms give the least form. A column of numbers and other text is compared bytewise.
    """
    n = number(text)
    sign = -1 if greatest else 1
    by_number = F.min(F.when(n.isNotNull(), F.struct((sign * n).alias("n"), text.alias("t"))))["t"]
    return F.when(F.count(text) == F.count(n), by_number).otherwise(F.max(text) if greatest else F.min(text))
