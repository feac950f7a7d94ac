"""Lifecycle and replication rules over object versions.

Rules are compiled into the plan as predicates, so versions meet no table of rules. A rule is a mapping: id, enabled
(true), prefix, tags, size_over, size_under, days, date (text), lone_marker, noncurrent_days, keep_newest; for
replication: target, priority, prefix, tags, enabled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked


def covers(rule: Mapping) -> Column:
    """Whether a rule's filters take an object (columns key, size, tags)."""
    found = F.col("key").startswith(rule.get("prefix", ""))
    for k, v in rule.get("tags", {}).items():
        found = found & F.coalesce(F.col("tags")[k] == v, F.lit(False))
    if rule.get("size_over"):
        found = found & (F.col("size") > rule["size_over"])
    if rule.get("size_under"):
        found = found & (F.col("size") < rule["size_under"])
    return found


def covers_marker(rule: Mapping) -> Column:
    """Delete markers have no size and no tags: only a rule without such filters takes them."""
    plain = not (rule.get("tags") or rule.get("size_over") or rule.get("size_under"))
    return F.col("key").startswith(rule.get("prefix", "")) & F.lit(plain)


def _first(found: list[Column]) -> Column:
    return F.coalesce(*found, F.lit(None).cast("string"))


def due(versions: DataFrame, rules: Sequence[Mapping], now: str, versioned: bool = True) -> DataFrame:
    """key, version, action, rule of all that is due at `now`: expire, remove_marker or delete_noncurrent; the first rule in order counts.

    versions: key, version, modified, size, tags, is_marker. A key's versions are ranked newest first, by slices of time.
    """
    rules = [r for r in rules if r.get("enabled", True)]
    at = F.lit(now).cast("timestamp")
    takes = [F.when(F.col("is_marker"), covers_marker(r)).otherwise(covers(r)) for r in rules]
    # how many newer ones a rule keeps
    rows = ranked(versions, "key", "modified", "version", {f"_kept{i}": t for i, (r, t) in enumerate(zip(rules, takes, strict=True)) if r.get("noncurrent_days")})

    def old(column: str, days: int) -> Column:
        return F.col(column) + F.make_dt_interval(F.lit(days)) <= at

    expire, marker, noncurrent = [], [], []
    for i, (r, t) in enumerate(zip(rules, takes, strict=True)):
        id_, days = F.lit(r["id"]), r.get("days")
        ages = F.lit(False)
        if days:
            ages = ages | old("modified", days)
        if r.get("date"):
            ages = ages | (at >= F.lit(r["date"]).cast("timestamp"))
        expire.append(F.when(covers(r) & ages, id_))
        lone = F.lit(bool(r.get("lone_marker"))) | (old("modified", days) if days and versioned else F.lit(False))
        marker.append(F.when(covers_marker(r) & lone, id_))
        if r.get("noncurrent_days"):
            noncurrent.append(F.when(t & (F.col(f"_kept{i}") >= r.get("keep_newest", 0)) & old("_superseded", r["noncurrent_days"]), id_))
    current = F.col("_rank") == 1
    rule = F.when(current & ~F.col("is_marker"), _first(expire)).when(current & (F.col("_n") == 1), _first(marker)).when(~current, _first(noncurrent))
    action = F.when(current, F.when(F.col("is_marker"), "remove_marker").otherwise("expire")).otherwise("delete_noncurrent")
    return rows.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select("key", "version", action.alias("action"), "rule")


def expiry(rules: Sequence[Mapping], modified: Column) -> Column:
    """struct<at timestamp, rule>: when the earliest rule expires a current object; days end at the next midnight in UTC. Null without one."""
    found = []
    for i, r in enumerate(x for x in rules if x.get("enabled", True)):
        if r.get("days"):
            seconds = F.unix_timestamp(modified.cast("timestamp")) + 86400 * r["days"]
            at = F.timestamp_seconds(F.ceil(seconds / 86400) * 86400)
        elif r.get("date"):
            at = F.lit(r["date"]).cast("timestamp")
        else:
            continue
        found.append(F.when(covers(r), F.struct(at.alias("at"), F.lit(i).alias("_i"), F.lit(r["id"]).alias("rule"))))
    first = F.array_min(F.array(*found)) if found else F.lit(None).cast("struct<at:timestamp,_i:int,rule:string>")
    return F.when(first.isNotNull(), F.struct(first["at"].alias("at"), first["rule"].alias("rule")))


def stale_uploads(uploads: DataFrame, initiated: str, now: str, days: int, prefix: str = "") -> DataFrame:
    """Unfinished uploads that a rule aborts: begun `days` days before `now` or earlier."""
    return uploads.filter(F.col("key").startswith(prefix) & (F.col(initiated) + F.make_dt_interval(F.lit(days)) <= F.lit(now).cast("timestamp")))


def scan_prefix(rules: Sequence[Mapping]) -> str:
    """The longest prefix that all enabled rules share: a filter that reaches the scan."""
    prefixes = [r.get("prefix", "") for r in rules if r.get("enabled", True)]
    if not prefixes:
        return ""
    low, high = min(prefixes), max(prefixes)
    return low[: next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))]


def replication_marks(rules: Sequence[Mapping], marks: Column, replica_of: Column, version: Column) -> Column:
    """The map target -> status of a new version: PENDING for each target a rule sends it to, what is there stays; replicas and unversioned objects get none."""
    ordered = sorted((r for r in rules if r.get("enabled", True)), key=lambda r: -r.get("priority", 0))
    held = F.coalesce(marks, F.create_map().cast("map<string,string>"))
    new = held
    for r in ordered:
        own = F.create_map(F.lit(r["target"]), F.lit("PENDING"))
        new = F.when(covers(r) & ~F.map_contains_key(new, r["target"]), F.map_concat(new, own)).otherwise(new)
    skip = (F.coalesce(replica_of, F.lit("")) != "") | (F.coalesce(version, F.lit("")) == "")
    return F.when(skip, held).otherwise(new)


def replication_status(marks: Column, replica_of: Column) -> Column:
    """REPLICA, else the least advanced of the targets: FAILED, PENDING, COMPLETED; null without targets."""
    states = F.map_values(F.coalesce(marks, F.create_map().cast("map<string,string>")))
    least = F.when(F.size(states) == 0, None).when(F.array_contains(states, "FAILED"), "FAILED").when(F.array_contains(states, "PENDING"), "PENDING").otherwise("COMPLETED")
    return F.when(F.coalesce(replica_of, F.lit("")) != "", "REPLICA").otherwise(least)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
