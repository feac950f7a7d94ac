"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its 5-word shingles: how often a shingle occurs in it times a rarity that falls with the
number of documents that hold it. Document frequencies are counted over all documents in a count-mean sketch of SKETCH
counters (a fixed size; hot shingles stand out, the common noise level is taken off). The weight of rarity is kept
mild, 1 to 1 + RARITY, so that what thousands of copies share is not outweighed by the words in which they differ.
BANDS bands of ROWS samples each find pairs; every pair is verified by exact weighted Jaccard similarity, and classes are
the components of the verified links. Exact copies collapse to one node first and cost nothing more.

Nulls: a null text counts as empty; texts without words are alike only if equal; a null doc_id belongs to its text's
class but never names one unless all ids in it are null. Rows that repeat a doc_id and text are one document. Extra
columns are ignored (classes) or kept (drop_duplicates).
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected
from .leaders import grouped, linked

#: Words in a shingle, least similarity, bands and samples in a band: recall at 0.8 is 1 - (1 - 0.8^4)^14 > 0.999.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 14, 4
#: Counters of the document-frequency sketch, how it is cut for adding up, and how much rarity may add to a weight.
SKETCH, SLICES, RARITY = 1 << 19, 64, 0.25
#: Random tables of the sampling: TABLE triples (r, log c, beta), reached by double hashing.
TABLE = 1 << 16


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(719)
    r, cc, beta = rng.gamma(2, 1, TABLE), rng.gamma(2, 1, TABLE), rng.random(TABLE)
    return r.astype(np.float32), (np.log(cc) - r).astype(np.float32), beta.astype(np.float32)


def weighted_samples(keys: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples of a set: equal in each place with probability of the weighted Jaccard similarity.

    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the key of least a is drawn, with its t.
    """
    r, ln_c_less_r, beta = _draws()
    ln_w = np.log(weights).astype(np.float32)
    best = np.full(samples, np.inf, np.float32)
    drawn = np.zeros(samples, np.uint64)
    mask = np.uint64(TABLE - 1)
    for at in range(0, len(keys), 512):
        k, w = keys[at : at + 512], ln_w[at : at + 512]
        one, step = k & mask, (k >> np.uint64(16)) | np.uint64(1)
        place = ((one[None, :] + np.arange(1, samples + 1, dtype=np.uint64)[:, None] * step[None, :]) & mask).astype(np.int32)
        rr, bb = r[place], beta[place]
        t = np.floor(w[None, :] / rr + bb)
        ln_a = ln_c_less_r[place] - rr * (t - bb)
        i = ln_a.argmin(axis=1)
        rows = np.arange(samples)
        a = ln_a[rows, i]
        less = a < best
        best[less] = a[less]
        drawn[less] = c.mix(k[i] ^ (t[rows, i].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[less]
    return drawn


def _shingled(part: pa.RecordBatch):
    """Distinct shingles and how often they occur, for each text of a chunk; None for a text without words."""
    data, limits = c.buffers(part.column("text"))
    starts, ends, places = c.word_spans(data, limits)
    hashes, at = c.shingle_hashes(c.span_hashes(data, starts, ends), places, WORDS)
    for d in range(part.num_rows):
        yield np.unique(hashes[at[d] : at[d + 1]], return_counts=True) if at[d + 1] > at[d] else None


def _sketch(batches):
    total, n = np.zeros(SKETCH, np.int64), 0
    for part in c.text_chunks(batches):
        for found in _shingled(part):
            if found is not None:
                n += 1
                np.add.at(total, (found[0] >> np.uint64(45)).astype(np.int64), 1)
    if n:
        cut = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "n": pa.array([n] * SLICES, pa.int64()), "counts": pa.array([x.astype("<i8").tobytes() for x in cut], pa.binary())})


def _added(df: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // SLICES, np.int64)
    for raw in df["counts"]:
        total += np.frombuffer(raw, "<i8")
    return pd.DataFrame({"slice": df["slice"].iloc[:1], "n": [df["n"].sum()], "counts": [total.astype("<i8").tobytes()]})


def rarity(docs: DataFrame) -> np.ndarray:
    """The weight that each counter of the sketch gives: 1 for shingles in all documents to 1 + RARITY for those in one."""
    sums = "slice int, n long, counts binary"
    parts = docs.select("text").mapInArrow(_sketch, sums)
    # added up in two steps, so that no task meets all tasks' sketches
    parts = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("slice", "_salt").applyInPandas(lambda df: _added(df.drop(columns="_salt")), sums)
    rows = parts.groupBy("slice").applyInPandas(_added, sums).collect()  # SLICES rows, SKETCH counters in all
    total = np.zeros((SLICES, SKETCH // SLICES))
    n = 1
    for r in rows:
        total[r["slice"]], n = np.frombuffer(r["counts"], "<i8"), r["n"]
    total = total.ravel()
    df = np.maximum(total - np.median(total), 1.0)
    return (1 + RARITY * np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + n)).astype(np.float32)


def _weights(found: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> np.ndarray:
    return found[1] * table[(found[0] >> np.uint64(45)).astype(np.int64)].astype(float)


def _signatures(held):
    def run(batches):
        for part in c.text_chunks(batches):
            nodes, keys = [], []
            for node, found in zip(part.column("node").to_pylist(), _shingled(part), strict=True):
                if found is None:
                    continue
                drawn = weighted_samples(found[0], _weights(found, held.value), BANDS * ROWS).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ drawn[:, j])
                nodes.append(node)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _similarity(held):
    """Exact weighted Jaccard similarity of each pair of texts."""

    def sets(column):
        names = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        found = list(_shingled(pa.RecordBatch.from_arrays([names.dictionary], names=["text"])))
        return [found[i] for i in names.indices.to_pylist()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True):
                    wx, wy = _weights(x, held.value), _weights(y, held.value)
                    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
                    common = np.minimum(wx[i], wy[j]).sum()
                    out.append(float(common / (wx.sum() + wy.sum() - common)))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out)], names=["a", "b", "similarity"])

    return run


def _block_links(held):
    def sets(part):
        out = []
        for found in _shingled(part):
            # a shingle that occurs n times is n keys of equal weight, so that sums of shared keys are sums of minima
            nth = np.arange(found[1].sum()) - np.repeat(np.cumsum(found[1]) - found[1], found[1])
            once = np.repeat(found[0], found[1])
            out.append((c.mix(once + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(held.value[(found[0] >> np.uint64(45)).astype(np.int64)], found[1])))
        return out

    def run(batches):
        for links in grouped(c.text_chunks(batches), sets, lambda node: node, LEAST):
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary()), "similarity": pa.array([x[2] for x in links], pa.float64())})

    return run


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, root of texts with near duplicates, and the verified links between them; docs: doc_id, text, node."""
    held = docs.sparkSession.sparkContext.broadcast(rarity(docs))  # SKETCH floats
    signed = c.written(docs.select("node", "text").mapInArrow(_signatures(held), "node binary, keys array<long>"), "near-signatures")
    buckets = signed.select("node", F.explode("keys").alias("key")).distinct()
    several = buckets.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("key")
    buckets = c.written(buckets.join(several, "key", "left_semi"), "near-buckets")
    nodes = buckets.select("node").distinct()
    # copies go before the texts are dealt: each task sends a text once
    texts = c.written(docs.select("node", "text").dropDuplicates(["node"]).join(nodes, "node", "left_semi"), "near-texts")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_similarity(held), "a binary, b binary, similarity double")

    def blocks(met: DataFrame) -> DataFrame:
        rows = met.join(texts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "node", "text")
        return rows.mapInArrow(_block_links(held), "a binary, b binary, similarity double")

    links = c.written(linked(buckets, alike, blocks, LEAST, "near"), "near-links")
    return c.written(connected(links.select("a", "b"), "near-components"), "near-classes"), links


def _nodes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("node", c.digest(F.col("text")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, n_links (verified links of the text; those in larger buckets span what is alike and are not all pairs), kept, for every row."""
    docs = _nodes(docs)
    found, links = _classes(docs)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    ids = docs.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(found, "node", "left").join(degree, "node", "left")
    ids = c.written(ids.select("node", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "near-ids")
    whole = ids.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    # one row a text; the rows of texts that many documents are stay where they are
    ids = c.written(ids.select("node", "n", "root", "n_links").join(whole, "root"), "near-whole")
    return c.with_key(docs.select("doc_id", "node"), ids, "node", ids.agg(F.sum("n")).first()[0] or 0).select("doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of least doc_id, with docs' own columns; its repeated rows become one."""
    plain = _nodes(docs)
    found, _ = _classes(plain)
    ids = c.written(plain.groupBy("node", "doc_id").agg(F.count("*").alias("n")), "near-ids")
    # least doc_id, nulls last, then the text's digest: one node and one doc_id a class; first of each text, then of its class
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")
    rooted = ids.groupBy("node").agg(F.min(order).alias("x")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.node").alias("_mr_node"), F.col("x.doc_id").alias("_mr_id"), F.col("x.n").alias("_mr_n"))
    first = c.written(first, "near-kept")
    match = (c.digest(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_mr_node")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_mr_id"))
    kept = docs.join(first, match)
    own = [docs[x] for x in docs.columns]
    once = kept.filter("_mr_n = 1").select(*own)
    if first.filter("_mr_n > 1").isEmpty():
        return once
    return once.unionByName(kept.filter("_mr_n > 1").dropDuplicates(["_mr_node", "_mr_id"]).select(*own))
