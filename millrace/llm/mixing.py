"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target number of words. With S words in a source and a target of T, every document is taken
floor(T / S) times, and documents whose hash lies under the source's threshold once more. The threshold comes from sums
of words by source and leading hash bits: the bucket in which the budget runs out is found, only that bucket is refined
by further bits, and after the last level the threshold lies within one hash value of the budget. Nothing is sorted by
document, no document leaves its task but as part of a sum, and thresholds nest: a larger budget takes a superset.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id hashes as the empty
text. Rows that repeat a doc_id share its hash and are taken together. A source of size 0 has target 0. Extra columns
are ignored (mix) or kept (sample_documents).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Weights that the sources take in turn, and the most that a source may be repeated.
WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3
#: Bits of the hash, and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space, as long: positions where such a run begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the md5 of the id's text: the same on any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds target to the rows of sources (_source, source, source_size, n; a row a source): the words that each shall give.

    All words are shared by weight, no source gets over most times its own, the excess is shared again. A source is full
    where level * weight passes its cap, so only two sums a round reach the driver, and the level only rises.
    """
    # the place of each source in the order of code points, null last: rows before its partition and rows before it there
    ordered = sources.orderBy(F.col("source").isNull(), F.col("source"))
    ordered = c.written(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "mix-sources")
    parts = sorted((r["_part"], r["count"], r["first"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("count"), F.min("_at").alias("first")).collect())
    shift, before = [], 0
    for part, n, first in parts:  # one row a shuffle partition
        shift.append((part, before - first))
        before += n
    shifts = sources.sparkSession.createDataFrame(shift, "_part int, _shift long")
    place = F.pmod(F.col("_at") + F.col("_shift"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    weighed = c.written(ordered.join(F.broadcast(shifts), "_part").select("_source", "source", "source_size", "n", weight.alias("_weight"), cap.alias("_cap")), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_weight")
        held = weighed.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if held[0] == full or not held[2]:
            break
        full, level = held[0], (total - (held[1] or 0.0)) / held[2]
    return weighed.select("_source", "source", "source_size", "n", F.least(F.lit(level) * F.col("_weight"), F.col("_cap")).alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, threshold: the hashes under it hold the words nearest to the source's extra budget.

    plan: source, epochs, extra (words still wanted after whole epochs). Each level keeps one open bucket a source.
    """
    few, rows = c.small(plan, "_source"), plan.agg(F.sum("n")).first()[0] or 0
    at = plan.select("_source", "n", F.col("extra").alias("_left"), F.lit(0).cast("long").alias("_low"))
    order = Window.partitionBy("_source").orderBy("_bucket")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = _joined(sized, at, few, rows)
        inside = inside.filter(F.shiftrightunsigned("_hash", shift + LEVEL_BITS) == F.shiftrightunsigned("_low", shift + LEVEL_BITS))
        sums = inside.groupBy("_source", "n", "_left", "_low", F.shiftrightunsigned("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        # at most 2^LEVEL_BITS buckets a source
        running = sums.withColumn("_before", F.sum("_sum").over(order) - F.col("_sum"))
        # the bucket in which the budget runs out, or the last one
        crossing = running.filter(F.col("_before") <= F.col("_left")).groupBy("_source", "n").agg(F.max_by(F.struct("_bucket", "_before", "_left", "_sum"), "_bucket").alias("_x"))
        at = c.written(crossing.select("_source", "n", (F.col("_x._left") - F.col("_x._before")).alias("_left"), F.shiftleft("_x._bucket", shift).alias("_low"), F.col("_x._sum").alias("_sum")), f"mix-level{level}")
        last = at
        at = at.select("_source", "n", "_left", "_low")
    # one hash value is left open: it is taken if that comes nearer to the budget
    return last.select("_source", F.when(F.col("_left") * 2 >= F.col("_sum"), F.col("_low") + 1).otherwise(F.col("_low")).alias("_threshold"))


def _joined(rows: DataFrame, plan: DataFrame, few: bool, n_rows: int) -> DataFrame:
    """rows with the one row of plan (a written table) of their source: broadcast where plan is small, else only the sources of many rows are."""
    return rows.join(F.broadcast(plan), "_source") if few else c.with_key(rows, plan, "_source", n_rows)


def _planned(sized: DataFrame, weights: Sequence[float]) -> tuple[DataFrame, bool, int]:
    """_source, n, source_size, target, epochs, _threshold of each source; whether it may be broadcast, and how many rows all sources have."""
    totals = c.written(sized.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-totals")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0).cast("long")
    wanted = targets(totals, weights).withColumn("epochs", epochs).withColumn("extra", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = c.written(wanted, "mix-plan")
    out = c.written(plan.join(_thresholds(sized, plan), "_source", "left").drop("source", "extra"), "mix-thresholds")
    return out, c.small(out, "_source"), out.agg(F.sum("n")).first()[0] or 0


def _sized(docs: DataFrame) -> DataFrame:
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    # a key that is never null, so that joins keep the null source
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), key.alias("_source"), n_words(F.col("text").cast("string")).alias("size"), hash_of(doc_id).alias("_hash"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) of every row."""
    sized = c.written(_sized(docs), "mix-sizes")
    copies = F.col("epochs") + F.when(F.col("_hash") < F.col("_threshold"), 1).otherwise(0)
    return _joined(sized, *_planned(sized, weights)).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def sample_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The rows of docs as the mix takes them: a row as often as it is taken, with docs' own columns."""
    plan, few, n_rows = _planned(c.written(_sized(docs), "mix-sizes"), weights)
    source = F.col("_mr_row.source").cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    # a row travels as one column, so that none of its names can clash with the plan's
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_mr_row")).withColumn("_source", key)
    copies = F.col("epochs") + F.when(hash_of(F.col("_mr_row.doc_id").cast("long")) < F.col("_threshold"), 1).otherwise(0)
    joined = _joined(rows, plan, few, n_rows).filter(copies > 0)
    return joined.withColumn("_mr_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("_mr_row.*")
