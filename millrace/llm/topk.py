"""Exact top-k search by distributed histogram selection.

Vectors are packed in blocks once. Queries go in rounds of ROUND, a bounded number of bytes, which are broadcast; the
blocks of candidates stay where they are. A pass scores everything and sums, for each query, how many scores fall into
equal bins of the range that is still open; a task adds up its own blocks first, so what is shuffled is a histogram a
task. The bin that holds the kth best is opened next, until it is one score wide or holds few scores. The last pass keeps
the scores at or above that bound, at most k of them a task, ordered by score and then id, so that ties at the kth place
are broken by the smaller id exactly and thousands of equal vectors cost no more than k rows a task.

Vectors that are null, or hold a null or non-finite component, take no part. Of two vectors of unlike length the shorter
one counts as filled up with zeros; an empty vector scores 0. A null id takes no part. A repeated id counts as a vector
each time; as a query it is one, with the least of its vectors, and no row of its own id is its candidate. Fewer than k
candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Vectors in a block of candidates, queries and bytes of query vectors in a round at most, bins of a histogram, and the most scores that a bin may leave open.
BLOCK, ROUND, ROUND_BYTES, BINS, FEW = 2048, 2048, 1 << 25, 512, 64


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as double; null where the vector takes no part."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _pack(batches, size: int):
    """Blocks of at most size vectors of one task: ids and components as little-endian int64 bytes."""
    ids, rows, dim = [], [], -1

    def block():
        matrix = np.asarray(rows, "<i8").reshape(len(rows), -1)
        return pa.RecordBatch.from_pydict({"ids": pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()), "vectors": pa.array([matrix.tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32())})

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rows and (len(v) != dim or len(rows) == size):
                yield block()
                ids, rows = [], []
            dim = len(v)
            ids.append(i)
            rows.append(v)
    if rows:
        yield block()


def _blocks(df: DataFrame, size: int) -> DataFrame:
    return df.mapInArrow(lambda batches: _pack(batches, size), "ids binary, vectors binary, n int")


def _scores(q: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Candidate ids and the integer scores of the queries q against a block of candidates."""
    ids = np.frombuffer(row["ids"], "<i8")
    v = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)
    dim = min(q.shape[1], v.shape[1])  # beyond it one of the two is 0
    q, v = q[:, :dim], v[:, :dim]
    most = max(dim, 1) * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
    if most < 2**53:  # exact in doubles, and a BLAS product
        return ids, (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    return ids, q @ v.T


def _queries_of(rows: list, dim: int) -> dict[str, np.ndarray]:
    """Ids, vectors (filled up with zeros) and open ranges of a round's queries."""
    q = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        q[i, : len(r["vector"])] = r["vector"]
    return {"q": q} | {k: np.array([r[k] for r in rows], np.int64) for k in ("query_id", "low", "width", "end")}


def _histogram(held):
    def run(batches):
        c.one_blas_thread()
        m = held.value
        n, low, width, end = len(m["q"]), *(m[k][:, None] for k in ("low", "width", "end"))
        found = np.zeros(n * BINS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ids, scores = _scores(m["q"], row)
                at = (scores - low) // width
                sound = (at >= 0) & (at < BINS) & (scores < end) & (ids[None, :] != m["query_id"][:, None])
                found += np.bincount((np.arange(n)[:, None] * BINS + at)[sound], minlength=n * BINS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(m["query_id"][some // BINS]), "bin": pa.array(some % BINS, pa.int64()), "n": pa.array(found[some], pa.int64())})

    return run


def _survivors(held, k: int):
    def run(batches):
        c.one_blas_thread()
        m = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in m["q"]]
        for batch in batches:
            for row in batch.to_pylist():
                ids, scores = _scores(m["q"], row)
                for i, q in enumerate(m["query_id"]):
                    fit = np.flatnonzero((scores[i] >= m["low"][i]) & (ids != q))
                    if len(fit):
                        v, s = np.append(best[i][0], ids[fit]), np.append(best[i][1], scores[i][fit])
                        top = np.lexsort((v, -s))[:k]
                        best[i] = v[top], s[top]
        counts = [len(v) for v, _ in best]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(m["query_id"], counts)), "vec_id": pa.array(np.concatenate([*(v for v, _ in best), np.zeros(0, np.int64)])), "score": pa.array(np.concatenate([*(s for _, s in best), np.zeros(0, np.int64)]))})

    return run


def _round(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of the queries of one round (ROUND at most): query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    rows = [r.asDict() | {"wanted": k, "open": True} for r in queries.collect()]  # ROUND rows, ROUND_BYTES at most
    dim = max((len(r["vector"]) for r in rows), default=0)
    while rows and any(r["open"] for r in rows):
        active = [r for r in rows if r["open"]]
        held = spark.sparkContext.broadcast(_queries_of(active, dim))
        sums = candidates.mapInArrow(_histogram(held), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = sums.withColumn("above", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))) - F.col("n"))  # BINS rows a query at most
        kth = _kth(above, active)
        held.unpersist()
        for r in active:
            x = kth.get(r["query_id"])
            if x is None:  # no candidate, or all are above: the last pass takes what there is
                r["open"] = False
                continue
            low = r["low"] + x["bin"] * r["width"]
            # bins are rounded up, so the last ones reach past the open range: what lies there is already counted
            r["end"] = min(r["end"], low + r["width"])
            r["low"], r["wanted"] = low, r["wanted"] - x["above"]
            # a bin of few scores is narrow enough: the last pass takes them all
            r["open"] = r["width"] > 1 and x["n"] > FEW
            r["width"] = -(-r["width"] // BINS)
    held = spark.sparkContext.broadcast(_queries_of(rows, dim))
    kept = candidates.mapInArrow(_survivors(held, k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a task and query
    return kept.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(above: DataFrame, active: list[dict]) -> dict:
    """For each query the lowest bin that the best `wanted` scores reach into, and how many scores lie above it and in it."""
    wanted = above.sparkSession.createDataFrame([(r["query_id"], r["wanted"]) for r in active], "query_id long, wanted long")
    reached = above.join(F.broadcast(wanted), "query_id").filter(F.col("above") < F.col("wanted"))
    return {r["query_id"]: r["x"] for r in reached.groupBy("query_id").agg(F.min_by(F.struct("bin", "above", "n"), "bin").alias("x")).collect()}


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product for each query.

    queries: query_id long, vector array<long>; vectors: vec_id long, vector array<long> (both quantised, without nulls).
    """
    candidates = c.written(_blocks(vectors.select("vec_id", "vector"), BLOCK), "topk-blocks")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    most = vectors.agg(F.max(norm(F.col("vector")))).first()[0] or 0.0
    reach = F.ceil(norm(F.col("vector")) * most * 1.000001 + 1)  # no inner product is greater
    once = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))
    once = once.select("query_id", "vector", (-reach).alias("low"), F.ceil((2 * reach + 1) / BINS).cast("long").alias("width"), (reach + 1).alias("end"))
    once = c.written(once, "topk-queries")
    n, longest = once.agg(F.count("*"), F.max(F.size("vector"))).first()
    each = max(1, min(ROUND, ROUND_BYTES // (8 * max(longest or 1, 1))))
    # rounds are dealt by hash; twice as many as the mean needs keeps each of them below `each`
    rounds = max(1, -(-n // each))
    if rounds > 1:
        rounds = -(-n // (each // 2 or 1))
    if rounds == 1:
        return _round(candidates, once, k)
    path = c.scratch_path(once.sparkSession, "topk-found")
    for r in range(rounds):
        found = _round(candidates, once.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r), k)
        found.write.mode("append").parquet(path)
    return once.sparkSession.read.schema(found.schema).parquet(path)
