"""Timestamps that keep their offset and the precision they were written with.

A value is struct<ts timestamp_ntz (the instant in UTC), off int (minutes), prec int>: precision 0 year, 1 month, 2 day,
3 minute, 4 second, 4 + n for n digits of a fraction. Instants are kept to the microsecond. No session time zone matters.
Bind a value to a column (withColumn) before several functions use it: each use repeats the expression it is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import failed

#: Fixed value: the forms that are read, with and without separators.
FULL = r"^(\d{4})(?:T?|-(\d{2})(?:T?|-(\d{2})(?:T?|[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?([Zz]|[+-]\d{2}:?\d{2})?)))$"
BASIC = r"^(\d{4})(\d{2})(\d{2})(?:T?|[Tt ](\d{2})(\d{2})(?:(\d{2})(?:\.(\d{1,9}))?)?([Zz]|[+-]\d{2}:?\d{2})?)$"
PARTS = {"year": 0, "month": 1, "day": 2, "hour": 3, "minute": 3, "second": 4}


def parse(text: Column) -> Column:
    """TO_TIMESTAMP: years, months, days, minutes, seconds, fractions, offsets (none is UTC); other text ends the query."""
    trimmed = F.trim(text)
    rule = F.when(trimmed.rlike(FULL), 0).when(trimmed.rlike(BASIC), 1)

    def part(i: int) -> Column:
        return F.nullif(F.when(rule == 0, F.regexp_extract(trimmed, FULL, i)).otherwise(F.regexp_extract(trimmed, BASIC, i)), F.lit(""))

    year, month, day, hour, minute, second = (part(i).cast("int") for i in range(1, 7))
    fraction, zone = part(7), part(8)
    seconds = F.coalesce(second, F.lit(0)) + F.coalesce(F.concat(F.lit("0."), F.substring(fraction, 1, 6)).cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    local = F.try_make_timestamp_ntz(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)), F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)), seconds)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    plain = F.regexp_replace(zone, "[^0-9]", "")
    off = F.when(zone.isNull() | (F.lower(zone) == "z"), 0).otherwise(sign * (F.substring(plain, 1, 2).cast("int") * 60 + F.substring(plain, 3, 2).cast("int")))
    prec = F.when(month.isNull(), 0).when(day.isNull(), 1).when(hour.isNull(), 2).when(second.isNull(), 3).when(fraction.isNull(), 4).otherwise(4 + F.length(fraction))
    made = value(local - F.make_dt_interval(mins=off), off, prec)
    return _or_failed(text, rule.isNull() | local.isNull(), made)


def _or_failed(text: Column, bad: Column, made: Column) -> Column:
    checked = F.when(bad, failed("CastFailed", text)).otherwise(F.lit(""))
    return F.when(text.isNotNull() & (checked == ""), made)


def value(ts: Column, off: Column | None = None, prec: Column | None = None) -> Column:
    """A value from a timestamp_ntz in UTC."""
    return F.struct(ts.cast("timestamp_ntz").alias("ts"), (F.lit(0) if off is None else off).cast("int").alias("off"), (F.lit(10) if prec is None else prec).cast("int").alias("prec"))


def of_date(date: Column) -> Column:
    """A day, at its midnight in UTC."""
    return F.when(date.isNotNull(), value(date, prec=F.lit(2)))


def local(t: Column, off: Column | None = None) -> Column:
    """The clock of the value's own offset, or of another."""
    return t["ts"] + F.make_dt_interval(mins=t["off"] if off is None else off)


def extract(part: str, t: Column) -> Column:
    """A part of the value in its own offset; seconds are whole; timezone_hour and timezone_minute carry the offset's sign."""
    if part in ("timezone_hour", "timezone_minute"):
        return (t["off"] / 60).cast("long") if part == "timezone_hour" else (t["off"] % 60).cast("long")
    take = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[part]
    return take(local(t)).cast("long")


def date_add(part: str, n: Column, t: Column) -> Column:
    """Calendar months clamp to the month's end; the precision becomes at least that of the part."""
    clock = local(t)
    if part in ("year", "month"):
        moved = clock + F.make_ym_interval(F.lit(0), (n * (12 if part == "year" else 1)).cast("int"))
    else:
        moved = clock + F.make_dt_interval(**{{"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}[part]: n})
    made = value(moved - F.make_dt_interval(mins=t["off"]), t["off"], F.greatest(t["prec"], F.lit(PARTS[part])))
    return F.when(t.isNotNull() & n.isNotNull(), made)


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Whole parts from a to b, truncated toward zero; both clocks in a's offset, month ends not rounded."""
    x, y = local(a), local(b, a["off"])
    if part in ("year", "month"):
        months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
        rest = lambda ts: _micros(ts) - _micros(F.date_trunc("MONTH", ts).cast("timestamp_ntz"))
        whole = months + F.when((months > 0) & (rest(y) < rest(x)), -1).when((months < 0) & (rest(y) > rest(x)), 1).otherwise(0)
        return (whole if part == "month" else F.call_function("div", whole, F.lit(12))).cast("long")
    micros = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}[part]
    return F.call_function("div", _micros(b["ts"]) - _micros(a["ts"]), F.lit(micros))


def _offset(off: Column, letter: str, n: int) -> Column:
    sign, h, m = F.when(off < 0, "-").otherwise("+"), F.abs(off) / 60, F.abs(off) % 60
    hours, minutes = F.lpad(F.floor(h).cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")
    text = {1: F.when(m == 0, F.concat(sign, hours)).otherwise(F.concat(sign, hours, minutes)), 2: F.concat(sign, hours, minutes), 4: F.concat(sign, hours, minutes)}.get(n, F.concat(sign, hours, F.lit(":"), minutes))
    return F.when(off == 0, "Z").otherwise(text) if letter == "X" else text


def to_string(t: Column, pattern: str) -> Column:
    """TO_STRING: letters y M d a h H m s S n X x by count, quoted text as it is, other letters are an error."""
    clock = local(t)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    micros = pad(_micros(clock) % 1_000_000 + F.when(_micros(clock) % 1_000_000 < 0, 1_000_000).otherwise(0), 6)
    nanos = F.concat(micros, F.lit("000"))
    hour12 = F.when(F.hour(clock) % 12 == 0, 12).otherwise(F.hour(clock) % 12)
    simple = {"d": F.dayofmonth(clock), "h": hour12, "H": F.hour(clock), "m": F.minute(clock), "s": F.second(clock), "M": F.month(clock)}
    out, at = [F.lit("")], 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "'":
            stop = pattern.find("'", at + 1)
            if stop < 0:
                raise ValueError("EvaluatorUnterminatedTimestampFormatPatternToken")
            out.append(F.lit(pattern[at + 1 : stop]))
            at = stop + 1
            continue
        n = 1
        while ch.isascii() and ch.isalpha() and at + n < len(pattern) and pattern[at + n] == ch:
            n += 1
        at += n
        if not (ch.isascii() and ch.isalpha()):
            out.append(F.lit(ch))
        elif ch == "y":
            out.append(pad(F.year(clock) % 100, 2) if n == 2 else F.year(clock).cast("string") if n in (1, 3) else pad(F.year(clock), n))
        elif ch in simple and n <= 2:
            out.append(simple[ch].cast("string") if n == 1 else pad(simple[ch], 2))
        elif ch == "M" and n <= 5:
            name = F.date_format(clock, "MMMM")
            out.append(name if n == 4 else F.substring(name, 1, 3 if n == 3 else 1))
        elif ch == "a" and n == 1:
            out.append(F.when(F.hour(clock) < 12, "AM").otherwise("PM"))
        elif ch == "S" and n <= 9:
            out.append(F.substring(nanos, 1, n))
        elif ch == "n" and n == 1:
            out.append(nanos.cast("long").cast("string"))
        elif ch in "Xx" and n <= 5:
            out.append(_offset(t["off"], ch, n))
        else:
            raise ValueError(f"EvaluatorInvalidTimestampFormatPatternSymbol: {ch * n}")
    return F.concat(*out)


def utcnow() -> Column:
    """The instant at which the query began, to the millisecond."""
    return value(F.date_trunc("MILLISECOND", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))), prec=F.lit(7))
