"""Links among the members of colliding buckets.

Buckets of at most SMALL members are compared pair by pair, each pair once however many buckets it shares. Larger ones
are cut into blocks of BLOCK members; a task compares two blocks by one matrix product and gives back links that span
what it finds connected, never all pairs. Buckets beyond BLOCK members are first dealt anew where the caller can do so:
each member goes under its rarest elements, as many as two alike members must have one of in common, so members that
meet by one common element and are otherwise unlike part, and none that are alike do.

Buckets beyond MOST members would make too many block pairs: they first go in rounds, in which the least member of a
bucket leads it and is compared with the others; those alike are linked and leave. A bucket goes on while a round takes
half of it and it is beyond MOST; what is then left of it is compared in blocks, however many it takes. Leaders of a
bucket are unlike one another, so two members of different leaders can only be alike if their leaders are near (the
distance 1 - similarity obeys the triangle inequality); what has no leader counts as its own. Only such members, and
only if no chain of links joins them yet, are compared directly. So members that share a bucket and are alike end in
one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected


#: Members of a bucket that is compared pair by pair, of a block, and of a bucket that is compared in blocks.
SMALL, BLOCK, MOST = 12, 512, 16384


def linked(buckets: DataFrame, alike: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame], least: float, name: str, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links a, b of similarity `least` or more, from buckets (key, node).

    alike adds `similarity` to distinct pairs a, b; blocks finds the links among the rows of each (key, i, j). finer deals
    the rows key, node of large buckets to smaller ones, so that alike members of a bucket still share one.
    """
    rest = c.written(_sized(buckets.select("key", "node").distinct()), f"{name}-rest")
    if finer and not (large := rest.filter(F.col("n") > BLOCK).select("key", "node")).isEmpty():
        dealt = c.written(_sized(finer(large).distinct()), f"{name}-finer")
        rest = rest.filter(F.col("n") <= BLOCK).unionByName(dealt)
    few = rest.filter(F.col("n") <= SMALL)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter(F.col("a") > F.col("b")).select("a", "b").distinct()
    links = c.written(alike(pairs).filter(F.col("similarity") >= least), f"{name}-pairs")
    large = rest.filter(F.col("n") > SMALL)
    most = large.agg(F.max("n")).first()[0] or 0
    if most:
        links = links.unionByName(c.written(blocks(_block_pairs(large.filter(F.col("n") <= MOST))), f"{name}-blocks"))
    if most > MOST:
        links = links.unionByName(_led(large.filter(F.col("n") > MOST), alike, blocks, least, name))
    return links


def _sized(rows: DataFrame) -> DataFrame:
    """key, node and n, the size of the bucket; buckets of one member go."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "key")


def _block_pairs(sized: DataFrame) -> DataFrame:
    """key, i, j, node: every member of a bucket of n under each pair of blocks that its own belongs to."""
    own = sized.withColumn("_of", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_of")).cast("int"))
    other = F.explode(F.when(F.col("_of") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("_of") - 1), F.array("_own"))))
    return own.withColumn("_other", other).select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node")


def spanning(nodes: list, sets: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple]:
    """Links (a, b, similarity) that span the components of weighted sets alike by `least`: distinct keys and whole weights each.

    The shared weight of all pairs is a product of matrices whose columns are the keys that two sets or more hold.
    """
    c.one_blas_thread()
    total = np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
    keys, weights = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets])
    unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    column = np.full(len(unique), -1)
    shared = np.flatnonzero(count > 1)
    column[shared] = np.arange(len(shared))
    use = column[place] >= 0
    owner, place, weights = owner[use], column[place][use], weights[use]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), 4096):
        inside = (place >= at) & (place < at + 4096)
        x = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        x[owner[inside], place[inside] - at] = np.sqrt(weights[inside])
        common += x @ x.T
    similarity = common / np.maximum(total[:, None] + total[None, :] - common, 1e-9)
    near = similarity >= least - 1e-6
    out, seen = [], np.zeros(len(sets), bool)
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            front += new.tolist()
            out += [(max(nodes[i], nodes[x]), min(nodes[i], nodes[x]), float(similarity[i, x])) for x in new.tolist() if nodes[i] != nodes[x]]
    return out


def grouped(batches: Iterable[pa.RecordBatch], sets_of: Callable[[pa.RecordBatch], list], node_of: Callable, least: float) -> Iterator[list[tuple]]:
    """spanning() for each run of equal key, i, j in sorted rows; a run is at most two blocks."""
    at, nodes, sets = None, [], []
    for batch in batches:
        own = list(zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
        for group, node, found in zip(own, batch.column("node").to_pylist(), sets_of(batch), strict=True):
            if group != at and nodes:
                yield spanning(nodes, sets, least)
                nodes, sets = [], []
            at = group
            nodes.append(node_of(node))
            sets.append(found)
    if nodes:
        yield spanning(nodes, sets, least)


def _led(rest: DataFrame, alike: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame], least: float, name: str) -> DataFrame:
    """Links inside the largest buckets (key, node, n), by leaders, and by blocks where a leader finds too few."""
    tested = led = unled = None
    while not rest.isEmpty():
        led_now = rest.join(rest.groupBy("key").agg(F.min("node").alias("leader")), "key")
        pairs = led_now.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        now = c.written(alike(pairs), f"{name}-tested")
        tested = now if tested is None else tested.unionByName(now)
        judged = led_now.join(tested.select(F.col("a").alias("node"), F.col("b").alias("leader"), "similarity"), ["node", "leader"], "left")
        judged = c.written(judged.withColumn("similarity", F.when(F.col("node") == F.col("leader"), F.lit(1.0)).otherwise(F.col("similarity"))), f"{name}-judged")
        taken = judged.filter(F.col("similarity") >= least).select("key", "node", "leader", "similarity")
        left = judged.filter(F.col("similarity") < least)
        sizes = left.groupBy("key").agg(F.first("n").alias("before"), F.count("*").alias("n"))
        left = c.written(left.select("key", "node").join(sizes, "key").withColumn("on", (F.col("n") > MOST) & (2 * F.col("n") <= F.col("before"))), f"{name}-left")
        rest, stay = left.filter("on").select("key", "node", "n"), left.filter(~F.col("on"))
        taken = taken.unionByName(stay.select("key", "node", F.col("node").alias("leader"), F.lit(1.0).alias("similarity")))
        led = taken if led is None else led.unionByName(taken)
        unled = stay if unled is None else unled.unionByName(stay)
    links = tested.filter(F.col("similarity") >= least)
    among = c.written(blocks(_block_pairs(_sized(unled.select("key", "node")))), f"{name}-unled")
    near = tested.filter((F.col("similarity") < least) & (F.col("similarity") >= 3 * least - 2))
    if near.isEmpty():
        return links.unionByName(among)
    roots = c.written(connected(links.select("a", "b"), f"{name}-part"), f"{name}-roots")
    held = led.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = held.select("key", F.col("node").alias("a"), F.col("leader").alias("la"), F.col("root").alias("ra"), F.col("similarity").alias("sa"))
    right = held.select("key", F.col("node").alias("b"), F.col("leader").alias("lb"), F.col("root").alias("rb"), F.col("similarity").alias("sb"))
    ends = near.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("similarity").alias("sl"))
    ends = ends.unionByName(ends.select(F.col("lb").alias("la"), F.col("la").alias("lb"), "sl"))
    across = left.join(ends, "la").join(right, ["key", "lb"]).filter((F.col("ra") != F.col("rb")) & (F.col("a") > F.col("b")) & (F.col("sl") >= F.col("sa") + F.col("sb") + least - 2))
    across = across.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return links.unionByName(among).unionByName(c.written(alike(across), f"{name}-across").filter(F.col("similarity") >= least))
