"""Ordered, paged listings with delimiter roll-up, and version histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def list_objects(df: DataFrame, key: str, *, prefix: str = "", delimiter: str = "", start_after: str = "", max_keys: int = 1000) -> DataFrame:
    """entry, is_prefix, n_keys: a page of keys and common prefixes in one byte order.

    Prefix and marker are range filters on the key and reach the scan; the page is a top-k, so only max_keys rows a task
    travel. A common prefix appears once, and a marker that is one excludes all that it prefixes.
    """
    column = F.col(key)
    rows = df.select(column.alias("_key")).filter(column.isNotNull())
    if prefix:
        rows = rows.filter(F.col("_key").startswith(prefix))
    if start_after:
        rows = rows.filter(F.col("_key") > start_after)
    rolled = F.lit(None).cast("string")
    if delimiter:
        tail = F.substring("_key", len(prefix) + 1, 2147483647)
        rolled = F.when(F.instr(tail, delimiter) > 0, F.concat(F.lit(prefix), F.substring_index(tail, delimiter, 1), F.lit(delimiter)))
    rows = rows.select(F.coalesce(rolled, "_key").alias("entry"), rolled.isNotNull().alias("is_prefix"))
    if start_after:
        rows = rows.filter(F.col("entry") != start_after)
    return rows.groupBy("entry").agg(F.max("is_prefix").alias("is_prefix"), F.count("*").alias("n_keys")).orderBy("entry").limit(max_keys)


def list_page(df: DataFrame, key: str, *, token: str | None = None, start_after: str = "", max_keys: int = 1000, **options) -> DataFrame:
    """list_objects() with is_truncated and next_token on each row: one row more than the page is taken to see whether any is left.

    A continuation token outranks start_after; no page holds more than 1000 entries.
    """
    most = min(max_keys, 1000)
    rows = list_objects(df, key, start_after=start_after if token is None else token, max_keys=most + 1, **options)
    if most == 0:
        return rows.limit(0).select("*", F.lit(False).alias("is_truncated"), F.lit(None).cast("string").alias("next_token"))
    page = Window.orderBy("entry")  # most + 1 rows at most
    counted = rows.withColumn("_n", F.row_number().over(page)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    counted = counted.withColumn("_last", F.max(F.when(F.col("_n") == most, F.col("entry"))).over(Window.partitionBy())).filter(F.col("_n") <= most)
    more = F.col("_all") > most
    return counted.select("entry", "is_prefix", "n_keys", more.alias("is_truncated"), F.when(more, F.col("_last")).alias("next_token"))


def url_encoded(key: Column) -> Column:
    """A key for listings that ask for encoding: spaces as %20, unreserved marks as they are."""
    return F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def list_versions(df: DataFrame, key: str, version: str, modified: str | None = None, *, prefix: str = "", key_marker: str = "", version_marker: str | None = None, max_keys: int | None = None) -> DataFrame:
    """df's distinct (key, version) rows with is_latest: the newest by time, then by version; delete markers are rows like others.

    The newest version is found by a combining aggregate, not by a sort of each key. A page runs in order of key, newest
    first, and resumes behind (key_marker, version_marker).
    """
    time = modified or version
    rows = df.dropDuplicates([key, version])
    if prefix:
        rows = rows.filter(F.col(key).startswith(prefix))
    newest = rows.groupBy(key).agg(F.max(F.struct(F.col(time).alias("t"), F.col(version).alias("v"))).alias("_newest"))
    out = rows.join(newest, key).withColumn("is_latest", F.col(version) == F.col("_newest.v")).drop("_newest")
    if key_marker:
        behind = F.col(key) > key_marker
        if version_marker is not None:
            at = rows.filter((F.col(key) == key_marker) & (F.col(version) == version_marker)).select(F.col(time).alias("_t")).limit(1)
            out = out.join(F.broadcast(at), F.lit(True), "left")
            behind = behind | ((F.col(key) == key_marker) & ((F.col(time) < F.col("_t")) | ((F.col(time) == F.col("_t")) & (F.col(version) < version_marker))))
            out = out.filter(behind).drop("_t")
        else:
            out = out.filter(behind)
    return out if max_keys is None else out.orderBy(F.col(key), F.col(time).desc(), F.col(version).desc()).limit(max_keys)


def list_uploads(df: DataFrame, key: str, upload: str, *, prefix: str = "", key_marker: str = "", upload_marker: str = "", max_uploads: int = 1000) -> DataFrame:
    """Unfinished uploads in order of key and upload id, behind the markers."""
    rows = df.filter(F.col(key).startswith(prefix))
    if key_marker:
        rows = rows.filter((F.col(key) > key_marker) | ((F.col(key) == key_marker) & (F.lit(bool(upload_marker)) & (F.col(upload) > upload_marker))))
    return rows.orderBy(key, upload).limit(max_uploads)


def list_parts(df: DataFrame, number: str, *, marker: int = 0, max_parts: int = 1000) -> DataFrame:
    """Parts of one upload by number, behind the marker."""
    return df.filter(F.col(number) > marker).orderBy(number).limit(max_parts)


def lifecycle_due(df: DataFrame, key: str, version: str, modified: str, *, now: str, expire_days: int, noncurrent_days: int, keep_newest: int) -> DataFrame:
    """key, version, action of what a rule removes at `now`.

    A current version expires expire_days after it was written. A noncurrent one goes when keep_newest newer noncurrent
    ones exist and noncurrent_days have passed since the next version superseded it.
    """
    rows = ranked(df.select(key, version, modified), key, modified, version)
    at = F.lit(now).cast("timestamp")

    def old(column: str, days: int):
        return F.col(column) + F.make_dt_interval(F.lit(days)) <= at

    action = F.when((F.col("_rank") == 1) & old(modified, expire_days), "expire").when((F.col("_rank") > 1 + keep_newest) & old("_superseded", noncurrent_days), "delete_noncurrent")
    return rows.withColumn("action", action).filter(F.col("action").isNotNull()).select(key, version, "action")
