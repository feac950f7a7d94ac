"""Scalar semantics of dynamically typed text values, as plain Columns that stay inside code generation.

A CSV field is text until it is used as a number; nothing here raises on text that is no number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a number may consist of; keeps 'inf', 'nan' and '1d' as text.
NUMBER = r"^[0-9.eE+-]+$"


def number(text: Column) -> Column:
    """The double that a text reads as, or null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def integer(text: Column) -> Column:
    """The whole number that a text reads as, decimals cut off ('7.9' is 7), or null."""
    trimmed = F.trim(text)
    wide = number(text)
    return F.coalesce(F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("long")), F.when(F.abs(wide) < 9.2e18, wide.cast("long")))


def equals(text: Column, value: Column) -> Column:
    """text = number: false, not null, where the text is no number."""
    return F.when(text.isNull() | value.isNull(), None).otherwise(F.coalesce(number(text) == value, F.lit(False)))


def divide(a: Column, b: Column) -> Column:
    """Whole division that truncates toward zero; a zero divisor raises under ANSI."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def substring(text: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """The part of [start, start + length) that lies inside the text, counted from 1; a negative length is an error."""
    if isinstance(length, int) and length < 0:
        raise ValueError("negative length")
    begin = start if isinstance(start, Column) else F.lit(start)
    first = F.greatest(begin, F.lit(1))
    if length is None:
        return F.substring(text, first, F.lit(2147483647))
    size = length if isinstance(length, Column) else F.lit(length)
    found = F.substring(text, first, F.greatest(begin + size - first, F.lit(0)))
    return F.when(size < 0, failed("EvaluatorInvalidArguments", F.lit("negative length"))).otherwise(found) if isinstance(length, Column) else found


def failed(code: str, what: Column, kind: str = "string") -> Column:
    """Ends the query with `code: what` when a row evaluates it; a lazy branch, as in CASE, evaluates it only where taken."""
    return F.raise_error(F.concat(F.lit(f"{code}: "), F.coalesce(what, F.lit("null")))).cast(kind)


def compare(text: Column, op: str, value: Column) -> Column:
    """text op number: null, not false, where the text is no number; != is the opposite of equals()."""
    n = number(text)
    return {"<": n < value, "<=": n <= value, ">": n > value, ">=": n >= value, "!=": ~equals(text, value)}[op]


def truth(text: Column) -> Column:
    """true or false of any case, null of null; any other text ends the query."""
    low = F.lower(text)
    return F.when(low == "true", True).when(low == "false", False).when(text.isNotNull(), failed("InvalidDataType", text, "boolean"))


def is_true(text: Column) -> Column:
    """IS TRUE: false where the text is no truth value at all."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def both(first: Column, second: Column) -> Column:
    """AND whose second side is evaluated only where the first is not false, so that its errors do not show there."""
    return F.when(~F.coalesce(first, F.lit(True)), False).otherwise(first & second)


def either(first: Column, second: Column) -> Column:
    """OR whose second side is evaluated only where the first is not true."""
    return F.when(F.coalesce(first, F.lit(False)), True).otherwise(first | second)


def contained(text: Column, values: Sequence[Column]) -> Column:
    """IN over dynamic text: true on a hit; null if there is none but some value, or the text, is null."""
    hits = [equals(text, x) if not isinstance(x, str) else text == x for x in values]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def nullif(text: Column, value: Column) -> Column:
    """Null where text equals the number value, else text."""
    return F.when(equals(text, value), None).otherwise(text)


def cast(text: Column, kind: str) -> Column:
    """CAST of dynamic text to int, float, bool or string; text that can't be read ends the query, null stays null."""
    if kind == "string":
        return text
    low = F.lower(F.trim(text))
    spark_type = {"int": "long", "float": "double", "bool": "boolean"}[kind]
    found = {"int": integer(text), "float": number(text), "bool": F.when(low == "true", True).when(low == "false", False).otherwise(number(text) != 0)}[kind]
    return F.when(text.isNull(), None).when(found.isNull(), failed("CastFailed", text, spark_type)).otherwise(found)


def modulo(a: Column, b: Column) -> Column:
    """The remainder of truncating division: it has the dividend's sign; a zero divisor raises under ANSI."""
    return a.cast("long") % b.cast("long")


def rounded(x: Column) -> Column:
    """A double rounded to a whole one, halves away from zero; what comes to zero keeps its sign."""
    return F.signum(x) * F.round(F.abs(x))


def float_text(x: Column) -> Column:
    """A double as text: always with a point below 1e16 and from 1e-5 up, else with a plain exponent (1e300, 1.5e-7)."""
    raw = x.cast("string")
    parts = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, tail = F.regexp_extract(raw, parts, 1), F.regexp_extract(raw, parts, 3)
    digits, e = F.concat(F.regexp_extract(raw, parts, 2), F.when(tail == "0", "").otherwise(tail)), F.regexp_extract(raw, parts, 4).try_cast("int")
    whole = F.concat(sign, F.substring(F.rpad(digits, F.greatest(F.length(digits), e + 1), "0"), F.lit(1), e + 1), F.lit("."), F.coalesce(F.nullif(F.substring(digits, e + 2, F.lit(99)), F.lit("")), F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    far = F.concat(sign, F.regexp_extract(raw, parts, 2), F.when(tail == "0", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), e.cast("string"))
    return F.when(e.isNull(), raw).when(e.between(0, 15), whole).when(e.between(-5, -1), small).otherwise(far)


def joined(*parts: Column) -> Column:
    """|| of texts and numbers: null if any is null; doubles by float_text()."""
    return F.concat(*[p.cast("string") for p in parts])


def trim(text: Column, chars: str = " ", side: str = "both") -> Column:
    """Removes any of the characters in chars from the named side; only the space by default."""
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](text, F.lit(chars))


def like(text: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without a default escape: % and _ are wild, all else literal; an escaped character stands for itself."""
    if escape is not None and len(escape) != 1:
        raise ValueError("escape must be one character")
    out, at = [], 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == escape:
            at += 1
            if at == len(pattern):
                raise ValueError("pattern ends in its escape")
            out.append(re.escape(pattern[at]))
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or re.escape(ch))
        at += 1
    return text.rlike(f"(?s)\\A{''.join(out)}\\z")


def month_diff(a: Column, b: Column) -> Column:
    """Whole months from a to b, truncated toward zero, month ends not rounded."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)

    def rest(ts: Column) -> Column:
        return F.struct(F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.date_format(ts, "ss.SSSSSS"))

    return months + F.when((months > 0) & (rest(b) < rest(a)), -1).when((months < 0) & (rest(b) > rest(a)), 1).otherwise(0)
