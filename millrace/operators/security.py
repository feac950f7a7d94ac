"""Column and row security of tables: what a principal may see, enforced as projections and filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(df: DataFrame, filters: Sequence[Mapping[str, Iterable[str]]]) -> DataFrame:
    """The columns that all filters leave: each names those `allowed` (none named: all) and those `excluded`, which wins."""
    names = df.columns
    for f in filters:
        allowed, excluded = set(f.get("allowed", ())), set(f.get("excluded", ()))
        names = [n for n in names if (not allowed or n in allowed) and n not in excluded]
    return df.select(*(F.col(f"`{n}`") for n in names))


def bound(expression: str, user: str, groups: Iterable[str] = ()) -> str:
    """An expression with current_user(), is_member(g) and is_account_group_member(g) bound to a caller."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = re.sub(r"(?i)\bcurrent_user\s*\(\s*\)", lambda _: quote(user), expression)
    held = {g.lower() for g in groups}
    return re.sub(r"(?i)\bis_(?:account_group_)?member\s*\(\s*'([^']*)'\s*\)", lambda m: "true" if m[1].lower() in held else "false", out)


def rows_for(df: DataFrame, filters: Sequence[str], user: str = "", groups: Iterable[str] = ()) -> DataFrame:
    """The rows that the last row filter keeps: a later filter takes the place of an earlier one; a row for which it is null goes."""
    return df.filter(F.expr(bound(filters[-1], user, groups))) if filters else df


def masked(df: DataFrame, masks: Mapping[str, str], user: str = "", groups: Iterable[str] = ()) -> DataFrame:
    """Columns replaced by their mask, an expression over the unmasked row."""
    return df.select(*(F.expr(bound(masks[n], user, groups)).alias(n) if n in masks else F.col(f"`{n}`") for n in df.columns))


def register(spark, name: str, parameters: str, body: str, returns: str) -> None:
    """A stored SQL function under its own name, for filters and masks to call."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
