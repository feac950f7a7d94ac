"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: two sparse logistic regressions (quality, toxicity) on the distinct words of the whole text and a
few bands of style, trained on a bounded, hash-chosen sample of labelled rows. Sites add what their other documents show:
mean evidence by host and by path is shrunk, path to host and host to the whole corpus, by grouped sums over all
documents; how strongly is estimated from the spread between sites (method of moments), so a sparse site stays near its
prior and a large one speaks for itself. A document's posterior is its own evidence with the prior of the corpus replaced
by that of its path, itself left out of the path's sums.

Nulls: a null text is empty; a null host or path is a site of its own; a null doc_id is scored but never a training row;
null labels teach nothing. Without labels of both kinds evidence is the prior 0.5 and all is kept. Repeated rows each get
their row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import sparse_lr

#: Hash features of words, the rows that a fit reads at most (about), and the bounds of evidence and of site strength.
BUCKETS, SAMPLE, CLIP, MOST_STRENGTH = 1 << 18, 16384, 1e-4, 1000.0
#: Bands of style shares (upper case among letters, symbols and digits among characters, repeated words).
BANDS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
HEADS = ("quality", "toxic")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _UPPER = (_LOWER >= 97) & (_LOWER <= 122), (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SIGN = ~_LETTER & ~c.SPACES & (np.arange(256) < 128)


def _features(data: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    """Sorted feature numbers of each text: words without outer punctuation are what carries; style bands come last."""
    low = _LOWER[data]
    plain = np.where(_SIGN[low], np.uint8(32), low)
    starts, ends, places = c.word_spans(plain, limits)
    words = (c.span_hashes(plain, starts, ends) >> np.uint64(46)).astype(np.int64)
    n = np.maximum(np.diff(limits), 1)
    letters = np.maximum(c.per_text(_LETTER[data], limits), 1)
    shares = [c.per_text(_UPPER[data], limits) / letters, c.per_text(_SIGN[data], limits) / n]
    out = []
    for d in range(len(limits) - 1):
        own = np.unique(words[places[d] : places[d + 1]])
        repeats = 1 - len(own) / max(places[d + 1] - places[d], 1)
        style = [BUCKETS + 16 * k + int(np.searchsorted(BANDS, s, "right")) for k, s in enumerate((shares[0][d], shares[1][d], repeats))]
        out.append(np.append(own, style))
    return out


N_FEATURES = BUCKETS + 48


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray | None]:
    """Weights of each head; None where the labels do not hold both values."""
    taught = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    n = taught.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20))
    chosen = taught.filter(place < F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)) + 1))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # about SAMPLE rows of three numbers

    def featured(batches):
        for part in c.text_chunks(batches):
            found = _features(*c.buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(k) for k in ("doc_id", "quality", "toxic")] + [pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], names=["doc_id", "quality", "toxic", "at"])

    def train(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        weights = []
        for head in HEADS:
            own = [r for r in rows if r[head] is not None]
            y = np.asarray([r[head] for r in own], np.int64)
            if len(set(y.tolist())) < 2:
                weights.append(None)
                continue
            x = [np.frombuffer(r["at"], "<i4").astype(np.int64) for r in own]
            w = sparse_lr.fit_ftrl([(a, np.ones(len(a))) for a in x], y, 2, N_FEATURES, alpha=0.1, l1=2.0, l2=1.0, epochs=2)
            weights.append((w[:, 1] - w[:, 0]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"head": pa.array(HEADS), "weights": pa.array(weights, pa.binary())})

    columns = "doc_id long, quality int, toxic int, at binary"
    learnt = sample.mapInArrow(featured, columns).repartition(1).sortWithinPartitions("doc_id", "at").mapInArrow(train, "head string, weights binary").collect()
    return {r["head"]: None if r["weights"] is None else np.frombuffer(r["weights"], "<f4") for r in learnt} or dict.fromkeys(HEADS)


def evidence(docs: DataFrame, model: dict, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the classifiers' probabilities for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in c.text_chunks(batches):
            found = _features(*c.buffers(part.column("text")))
            columns = []
            for head in HEADS:
                w = held.value.get(head)
                logit = np.array([w[at].sum() + w[-1] for at in found], float) if w is not None else np.zeros(len(found))
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "host", "path")), *columns], names=["doc_id", "host", "path", *HEADS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, quality double, toxic double")


def _strength(mean: Column, overall: Column) -> Column:
    """Pseudo-documents of a prior, from how the means of groups spread against what their sizes explain."""
    within = F.sum("n") * overall * (1 - overall) / F.sum("n")
    between = F.greatest(F.sum(F.col("n") * (mean - overall) ** 2) / F.sum("n") - within / F.avg("n"), F.lit(1e-6))
    return F.least(within / between, F.lit(MOST_STRENGTH))


def posteriors(found: DataFrame) -> DataFrame:
    """Adds to written evidence the posterior of both heads; sums by path and by host only, groups are never gathered."""
    found = found.withColumns({k: F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col(k))) for k in HEADS})
    path = c.written(found.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(k).alias(f"s_{k}") for k in HEADS)), "quality-paths")
    host = path.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"s_{k}").alias(f"s_{k}") for k in HEADS))
    overall = host.agg(F.sum("n").alias("n"), *((F.sum(f"s_{k}") / F.sum("n")).alias(k) for k in HEADS)).first()
    if not overall["n"]:
        return found.withColumns({f"{k}_{x}": F.lit(0.5) for k in HEADS for x in ("host", "path", "posterior")})
    spread = lambda g: g.agg(*(_strength(F.col(f"s_{k}") / F.col("n"), F.lit(overall[k])).alias(k) for k in HEADS)).first()
    m_host, m_path = spread(host), spread(path)
    host = host.select(F.col("host").alias("_h"), *((F.col(f"s_{k}") + m_host[k] * overall[k]).alias(f"h_{k}") for k in HEADS), F.col("n").alias("h_n"))
    sites = path.join(host, F.col("host").eqNullSafe(F.col("_h"))).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "h_n", *(x for k in HEADS for x in (f"s_{k}", f"h_{k}")))
    out = found.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    logit = lambda p: F.log(p / (1 - p))
    for k in HEADS:
        own = F.col(k)
        of_host = (F.col(f"h_{k}") - own) / (F.col("h_n") - 1 + m_host[k])  # this document left out
        out = out.withColumn(f"{k}_host", of_host).withColumn(f"{k}_path", (F.col(f"s_{k}") - own + m_path[k] * F.col(f"{k}_host")) / (F.col("n") - 1 + m_path[k]))
        shift = logit(F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col(f"{k}_path")))) - logit(F.lit(min(max(overall[k], CLIP), 1 - CLIP)))
        out = out.withColumn(f"{k}_posterior", 1 / (1 + F.exp(-(logit(own) + shift))))
    return out


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, least_quality: float = 0.3, most_toxic: float = 0.5) -> DataFrame:
    """One row a document: evidence, site posteriors, posteriors and kept."""
    model = fit(docs, labels)
    found = c.written(evidence(docs, model, host, path), "quality-evidence")
    out = posteriors(found)
    kept = (F.col("quality_posterior") >= least_quality) if model.get("quality") is not None else F.lit(True)
    kept = kept & ((F.col("toxic_posterior") < most_toxic) if model.get("toxic") is not None else F.lit(True))
    return out.select("doc_id", "host", "path", *(f"{k}{x}" for k in HEADS for x in ("", "_host", "_path", "_posterior")), kept.alias("kept"))
