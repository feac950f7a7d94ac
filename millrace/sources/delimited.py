"""Delimited text and JSON records as DataFrames, by the built-in readers and expressions only.

Fields of delimited text stay text in an array column, so rows may be ragged: a field that is there but empty is '', one
that is not there is null. Compressed files (.gz, .bz2, ...) are read by their ending.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fields_of(line: Column, delimiter: str = ",", quote: str = '"', escape: str = '"') -> Column:
    """The fields of one record. A quote counts only at a field's start; inside, the escape makes the next character plain."""
    d, q, e = (re.escape(x) for x in (delimiter, quote, escape))
    inner = f"(?:{q}{q}|[^{q}])*+" if quote == escape else f"(?:{e}.|[^{q}{e}])*+"
    # each field begins with a delimiter, so that no match is empty
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"(?s){d}(?:{q}{inner}{q}[^{d}]*|[^{d}]*)"), F.lit(0))
    plain = f"{q}{q}" if quote == escape else f"{e}(.)"

    def value(x: Column) -> Column:
        body = F.substring(x, 2, 2147483647)
        whole = F.regexp_extract(body, f"(?s)^{q}({inner}){q}([^{d}]*)$", 1)
        unquoted = F.regexp_replace(whole, plain, _literal(quote) if quote == escape else "$1")
        return F.when(body.rlike(f"(?s)^{q}{inner}{q}"), F.concat(unquoted, F.regexp_extract(body, f"(?s)^{q}{inner}{q}([^{d}]*)$", 1))).otherwise(body)

    return F.transform(raw, value)


def _literal(text: str) -> str:
    """text as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def read_delimited(spark: SparkSession, path: str, *, header: str = "NONE", delimiter: str = ",", quote: str = '"', escape: str = '"', comment: str = "#", record_delimiter: str = "\n", quoted_records: bool = False, width: int = 64) -> tuple[DataFrame, list[str]]:
    """A DataFrame with the column `fields` (array of text) and the header's names.

    header: NONE, IGNORE or USE; the latter two take the first record of a single file away. Blank records and those that
    begin with the comment mark are skipped, a byte order mark is dropped. quoted_records lets quoted fields hold record
    delimiters: then at most `width` fields are read and empty fields at a record's end count as absent.
    """
    if quoted_records:
        reader = spark.read.schema(", ".join(f"_{i + 1} string" for i in range(width))).options(sep=delimiter, quote=quote, escape=escape, multiLine=True, emptyValue="", mode="PERMISSIVE")
        raw = (reader.option("comment", comment) if comment else reader).csv(path)
        last = F.greatest(*(F.when(F.col(f"_{i + 1}").isNotNull(), i + 1).otherwise(0) for i in range(width)))
        rows = raw.select(F.slice(F.array(*(F.coalesce(F.col(f"_{i + 1}"), F.lit("")) for i in range(width))), F.lit(1), last).alias("fields"), F.lit(0).alias("_start"))
    else:
        line = F.regexp_replace("value", "^\ufeff", "")
        if record_delimiter == "\n":
            line = F.regexp_replace(line, "\r$", "")
        lines = spark.read.text(path, lineSep=record_delimiter).select(line.alias("line"), F.col("_metadata.file_block_start").alias("_start")).filter("line <> ''")
        lines = lines.filter(~F.col("line").startswith(comment)) if comment else lines
        rows = lines.select(fields_of(F.col("line"), delimiter, quote, escape).alias("fields"), "_start")
    if header == "NONE":
        return rows.select("fields"), []
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    first = rows.filter(F.col("_start") == 0).agg(F.min(F.struct("_id", "fields")).alias("x")).first()["x"]
    if first is None:
        return rows.select("fields"), []
    return rows.filter(F.col("_id") != first["_id"]).select("fields"), list(first["fields"]) if header == "USE" else []


def column(name: str, names: Sequence[str] = (), quoted: bool = False) -> Column:
    """A field by its header name (exact first, then in any ASCII case unless quoted) or by its place _1, _2, ...; null where a row has no such field."""
    found = [i for i, x in enumerate(names) if x == name] or ([] if quoted else [i for i, x in enumerate(names) if x.lower() == name.lower()])
    if found:
        return F.get("fields", F.lit(found[0]))
    place = re.fullmatch(r"_(\d+)", name)
    if place and not quoted:
        if int(place[1]) == 0:
            raise ValueError("InvalidColumnIndex")
        return F.get("fields", F.lit(int(place[1]) - 1))
    raise ValueError(f"MissingHeaders: {name}")


def select(rows: DataFrame, items: Sequence[tuple[str, Column]], where: Column | None = None) -> DataFrame:
    """Named expressions, each of which may use the names before it, as may where: a name is one more column of the rows."""
    for name, item in items:
        rows = rows.withColumn(name, item)
    return (rows if where is None else rows.filter(where)).select(*(name for name, _ in items))


def first_records(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n records in the named order: a bounded top-k, not a sort of all."""
    if n < 0:
        raise ValueError("EvaluatorNegativeLimit")
    return rows.orderBy(*order).limit(n)


def read_json(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """One variant column `record`: a record a line, or (document) records that span lines; the elements of a top-level array are records."""
    return spark.read.option("singleVariantColumn", "record").option("multiLine", document).json(path)


def walk(rows: DataFrame, steps: Sequence[str | int]) -> DataFrame:
    """Follows a path from `record`: names, places, "[*]" for each element and ".*" for each member; rows without it go."""
    for step in steps:
        if step == "[*]":
            rows = rows.withColumn("record", F.explode(F.try_variant_get("record", "$", "array<variant>")))
        elif step == ".*":
            rows = rows.withColumn("record", F.explode(F.map_values(F.try_variant_get("record", "$", "map<string,variant>"))))
        else:
            rows = rows.withColumn("record", member(F.col("record"), step)).filter(F.col("record").isNotNull())
    return rows


def member(value: Column, step: str | int) -> Column:
    """A member by name (exact first, then in any case) or an element by place; null where there is none (MISSING)."""
    if isinstance(step, int):
        return F.try_variant_get(value, f"$[{step}]", "variant")
    members = F.try_variant_get(value, "$", "map<string,variant>")
    near = F.get(F.map_values(F.map_filter(members, lambda k, _: F.lower(k) == step.lower())), F.lit(0))
    return F.coalesce(F.element_at(members, step), near)


def is_missing(value: Column) -> Column:
    return value.isNull()


def is_null(value: Column) -> Column:
    """IS NULL: a JSON null, or nothing at all."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def scalar(value: Column) -> Column:
    """A variant's text: text as it is, other values as JSON; null for null and missing."""
    return F.try_variant_get(value, "$", "string")
