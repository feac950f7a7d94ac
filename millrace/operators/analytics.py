"""Usage reports, quotas, histograms, percentiles, metrics and duplicate share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_report(facts: DataFrame, buckets: DataFrame, bucket: str, tenant: str, size: Column, modified: Column) -> DataFrame:
    """tenant, n_buckets, objects, bytes, last_modified; buckets without facts count as zero, facts of unknown buckets are dropped.

    Facts are summed by bucket before the join, so the join meets one row a bucket.
    """
    per = facts.groupBy(bucket).agg(F.count("*").alias("objects"), F.sum(size).alias("bytes"), F.max(modified).alias("last_modified"))
    joined = buckets.select(bucket, tenant).join(per, bucket, "left")
    return joined.groupBy(tenant).agg(
        F.count("*").alias("n_buckets"),
        F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.max("last_modified").alias("last_modified"),
    )


def histogram(df: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """le, n, total: how many values are at most each bound, +Inf last (null bound), and the sum of all; one pass, one combined row."""
    counts = [F.count_if(value <= b) for b in bounds] + [F.count(value)]
    total = F.sum(value.cast("double"))
    rows = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), n.alias("n"), total.alias("total")) for b, n in zip([*bounds, None], counts, strict=True)])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


COUNTERS = ("objects", "logical_bytes", "stored_bytes", "noncurrent_versions", "noncurrent_bytes")


def usage_by_bucket(reports: DataFrame, buckets: DataFrame) -> DataFrame:
    """The five counters and the latest change of every known bucket (bucket, tenant), summed over the reports of all nodes; none counts as zero."""
    per = reports.groupBy("bucket").agg(*(F.sum(k).alias(k) for k in COUNTERS), F.max("last_modified").alias("last_modified"))
    joined = buckets.select("bucket", "tenant").join(per, "bucket", "left")
    return joined.select("bucket", "tenant", *(F.coalesce(k, F.lit(0)).alias(k) for k in COUNTERS), "last_modified")


def usage_by_tenant(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """Sums by tenant: tenants without buckets count as zero, tenants found only in the rows have their row too."""
    per = rows.groupBy("tenant").agg(F.count("*").alias("buckets"), *(F.sum(k).alias(k) for k in COUNTERS[:3]), F.max("last_modified").alias("last_modified"))
    joined = tenants.select("tenant").distinct().join(per, "tenant", "full")
    return joined.select("tenant", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("buckets", *COUNTERS[:3])), "last_modified")


def usage_of_cluster(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("buckets"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in COUNTERS[:3]))


def version_counters(versions: DataFrame) -> DataFrame:
    """Per bucket: current objects and bytes, noncurrent versions and bytes; versions: bucket, size, is_latest, is_marker."""
    current = F.col("is_latest") & ~F.col("is_marker")
    return versions.groupBy("bucket").agg(
        F.count_if(current).alias("objects"), F.coalesce(F.sum(F.when(current, F.col("size"))), F.lit(0)).alias("logical_bytes"),
        F.count_if(~F.col("is_latest")).alias("noncurrent_versions"), F.coalesce(F.sum(F.when(~F.col("is_latest"), F.col("size"))), F.lit(0)).alias("noncurrent_bytes"),
    )


def stored_bytes(stripes: Column) -> Column:
    """Bytes on disk of an object's stripes (array of size, k, m): each is cut into k shards, and m more are stored."""
    return F.aggregate(stripes, F.lit(0).cast("long"), lambda acc, s: acc + F.ceil(s["size"] / s["k"]) * (s["k"] + s["m"]))


def admitted(writes: DataFrame, group: str, order: str, size: str, used: str, quota: str) -> DataFrame:
    """Adds `admitted` to writes, replayed in order within each group: a write goes in if what is used, what went in since and it fit the quota (null or 0: none).

    A refused write takes no room, so this is a fold, not a running sum: rows stream through the task in order, and one
    number is held, never a group.
    """
    schema = writes.schema.add("admitted", "boolean")

    def replay(batches):
        at, since = object(), 0
        for df in batches:
            out = []
            for g, n, base, most in zip(df[group].tolist(), df[size].tolist(), df[used].tolist(), df[quota].tolist(), strict=True):
                if g != at:
                    at, since = g, 0
                fits = not most or most != most or base + since + n <= most
                since += n if fits else 0
                out.append(fits)
            yield df.assign(admitted=out)

    return writes.repartition(group).sortWithinPartitions(group, order).mapInPandas(replay, schema)


def percentiles(df: DataFrame, group: str, value: str, shares: Sequence[float], nearest_rank: bool = True) -> DataFrame:
    """group, share, value: the value of nearest rank (ceil(n p)), or else at place round((n - 1) p) from 0.

    Values are counted first, so a window runs over distinct values of a group, not over its rows.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    ranked = counted.withColumn("_to", F.sum("_n").over(own.orderBy(value))).withColumn("_all", F.sum("_n").over(own))
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in shares))).alias("share")
    rows = ranked.select(group, value, "_n", "_to", "_all", wanted)
    place = F.greatest(F.ceil(F.col("_all") * F.col("share")), F.lit(1)) if nearest_rank else F.round((F.col("_all") - 1) * F.col("share")).cast("long") + 1
    return rows.filter((F.col("_to") >= place) & (F.col("_to") - F.col("_n") < place)).select(group, "share", value)


def throughput(df: DataFrame, ok: Column, size: Column, seconds: float) -> DataFrame:
    """Operations and megabytes a second by wall clock, over successes only."""
    return df.agg((F.count_if(ok) / F.lit(float(seconds))).alias("ops"), (F.coalesce(F.sum(F.when(ok, size)), F.lit(0)) / 1e6 / F.lit(float(seconds))).alias("megabytes"), F.count_if(~ok).alias("failed"))


def merged_metrics(lines: DataFrame, label: str) -> DataFrame:
    """family, series, value of text metrics (columns node, n: line number, line): the node goes in as a label; of equal series the first node's stays."""
    rule = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    rows = lines.filter(~F.col("line").startswith("#") & F.col("line").rlike(rule))
    family, inner, value = (F.regexp_extract("line", rule, i) for i in (1, 2, 3))
    has = inner.rlike(f"(?:^|,){label}=")
    labels = F.when(has, inner).otherwise(F.concat(F.lit(f'{label}="'), F.col("node"), F.lit('"'), F.when(inner == "", "").otherwise(F.concat(F.lit(","), inner))))
    series = F.concat(family, F.lit("{"), labels, F.lit("}"))
    return rows.select(family.alias("family"), series.alias("series"), value.alias("value"), "node", "n").groupBy("family", "series").agg(F.min_by("value", F.struct("node", "n")).alias("value"))


def duplicate_share(df: DataFrame, text: str, chunk: int) -> DataFrame:
    """chunks, bytes, unique_chunks, duplicate_bytes, zero_bytes of texts cut into aligned blocks of `chunk` bytes, by fingerprint; blocks of zero bytes count apart.

    A fingerprint's copies are counted map-side first, so a block that a third of all texts share costs one row a task.
    """
    raw = F.col(text).cast("binary")
    blocks = df.filter(F.octet_length(text) > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(text) - 1) / chunk)), lambda i: F.substring(raw, i.cast("int") * chunk + 1, F.lit(chunk)))).alias("block"))
    return share_of(blocks)


def share_of(blocks: DataFrame) -> DataFrame:
    """The counts of duplicate_share() over rows of a column `block`."""
    zero = F.hex("block").rlike("^0*$").alias("zero")
    by_print = blocks.groupBy(F.sha2("block", 256).alias("print"), F.octet_length("block").alias("len"), zero).agg(F.count("*").alias("n"))
    return by_print.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("zero")).alias("unique_chunks"),
        F.coalesce(F.sum(F.when(~F.col("zero"), (F.col("n") - 1) * F.col("len"))), F.lit(0)).alias("duplicate_bytes"),
        F.coalesce(F.sum(F.when(F.col("zero"), F.col("n") * F.col("len"))), F.lit(0)).alias("zero_bytes"),
    )
