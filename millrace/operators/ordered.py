"""Ranks and running counts inside hot keys, and merges of ordered parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, modified: str, version: str, takes: Mapping[str, Column] | None = None, slice_: str = "day") -> DataFrame:
    """Adds _rank (1: the newest of its key by time, then version), _superseded (time of the next newer row), _n (rows of the key)
    and, under each name in takes, how many newer rows but the newest it holds for.

    A key's rows are ordered within slices of time (`slice_`: a unit of date_trunc), and what newer slices hold is added from
    one row a slice: no task meets all rows of a hot key, only those of one of its slices. Null keys are one key; rows
    without a time count as the oldest.
    """
    takes = {n: F.coalesce(x, F.lit(False)) for n, x in (takes or {}).items()}
    # fields of a struct may be null and still be equal, so one column deals, ranks and joins
    place = F.struct(F.col(key).alias("key"), F.date_trunc(slice_, F.col(modified)).alias("slice"))
    rows = rows.select("*", place.alias("_place"), *(x.alias(f"_take_{n}") for n, x in takes.items()))
    newest = F.struct(F.col(modified).alias("m"), F.col(version).alias("v"))
    flags = [F.max_by(f"_take_{n}", newest).alias(f"_first_{n}") for n in takes]
    slices = rows.groupBy("_place").agg(F.count("*").alias("_in"), F.min(modified).alias("_oldest"), *(F.count_if(F.col(f"_take_{n}")).alias(f"_sum_{n}") for n in takes), *flags)
    own = Window.partitionBy("_place.key")
    newer = own.orderBy(F.col("_place.slice").desc_nulls_last())
    before = newer.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    slices = slices.select(
        "_place", F.coalesce(F.sum("_in").over(before), none).alias("_before"), F.lag("_oldest").over(newer).alias("_last"), F.sum("_in").over(own).alias("_n"),
        *(F.coalesce(F.sum(f"_sum_{n}").over(before), none).alias(f"_had_{n}") for n in takes), *(F.first(f"_first_{n}").over(newer).alias(f"_top_{n}") for n in takes),
    )
    inside = Window.partitionBy("_place").orderBy(F.col(modified).desc(), F.col(version).desc())
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.row_number().over(inside).alias("_at"), F.lag(modified).over(inside).alias("_newer"), *(F.count_if(F.col(f"_take_{n}")).over(so_far).alias(f"_run_{n}") for n in takes))
    out = rows.join(slices, "_place")
    rank = F.col("_before") + F.col("_at")
    counts = [(F.col(f"_had_{n}") + F.col(f"_run_{n}") - F.when((rank > 1) & F.col(f"_top_{n}"), 1).otherwise(0)).alias(n) for n in takes]
    made = {"_place", "_at", "_newer", "_before", "_last", "_n", *(f"{p}{n}" for n in takes for p in ("_take_", "_run_", "_had_", "_top_"))}
    superseded = F.when(F.col("_at") > 1, F.col("_newer")).otherwise(F.col("_last"))
    return out.select(*(F.col(f"`{x}`") for x in out.columns if x not in made), rank.alias("_rank"), superseded.alias("_superseded"), "_n", *counts)


def union_page(parts: Sequence[DataFrame], key: str, most: int, start_after: str | None = None) -> DataFrame:
    """The first `most` distinct keys, in order, of parts that may overlap; each part gives at most `most` keys of its own."""
    column = F.col(key)
    own = [p.select(column).filter(column.isNotNull() if start_after is None else column > start_after).distinct().orderBy(key).limit(most) for p in parts]
    return reduce(DataFrame.unionByName, own).distinct().orderBy(key).limit(most)


def first_seen(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """Distinct keys with the least position they have, `first_at`; a combining aggregate, so repeats cost nothing past their task."""
    return df.groupBy(*keys).agg(F.min(position).alias("first_at"))
