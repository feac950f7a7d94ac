"""Records as lines of delimited text or JSON; write them with df.write.text()."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import float_text


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text: doubles by float_text(), nested values as JSON."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float"):
        return float_text(F.col(name).cast("double"))
    return F.to_json(F.col(name)) if kind in ("struct", "array", "map") else F.col(name).cast("string")


def delimited(values: Sequence[Column], *, always: bool = False, delimiter: str = ",", quote: str = '"', escape: str = '"', record_delimiter: str = "\n") -> Column:
    """One record: fields that hold a delimiter, a line break or the quote are quoted (or all are); null is empty."""

    def field(x: Column) -> Column:
        quoted = F.concat(F.lit(quote), F.replace(x, F.lit(quote), F.lit(escape + quote)), F.lit(quote))
        if always:
            return F.when(x.isNull(), F.lit(quote * 2)).otherwise(quoted)
        marks = [delimiter, record_delimiter, "\r", "\n", quote]
        needs = F.lit(False)
        for m in marks:
            needs = needs | F.contains(x, F.lit(m))
        return F.when(x.isNull(), "").when(needs, quoted).otherwise(x)

    return F.concat_ws(delimiter, *map(field, values))


def json_object(df: DataFrame, names: Sequence[str] | None = None, missing: Mapping[str, Column] | None = None) -> Column:
    """One JSON object: nulls stay, members whose condition in `missing` holds are left out, NaN and infinities are text."""
    missing = missing or {}
    members = []
    for name in names or df.columns:
        kind, x = df.schema[name].dataType.typeName(), F.col(name)
        if kind in ("double", "float"):
            value = F.when(x.isNull(), "null").when(F.isnan(x) | (F.abs(x) == float("inf")), F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(float_text(x.cast("double")))
        elif kind in ("struct", "array", "map"):
            value = F.coalesce(F.to_json(x), F.lit("null"))
        elif kind in ("string", "timestamp", "timestamp_ntz", "date"):
            value = F.coalesce(F.regexp_extract(F.to_json(F.struct(x.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
            value = F.when(x.isNull(), "null").otherwise(value)
        else:
            value = F.coalesce(x.cast("string"), F.lit("null"))
        member = F.concat(F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(name)))) - 2), F.lit(":"), value)
        members.append(F.when(~missing[name], member) if name in missing else member)
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def output_names(items: Sequence[tuple[str | None, str | None]]) -> list[str]:
    """Names of a select list from (alias, last key of the path): the alias, else the key, else _N."""
    return [alias or key or f"_{i + 1}" for i, (alias, key) in enumerate(items)]
