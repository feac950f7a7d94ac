"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of 1 to 3 lower-cased code points are hashed to BUCKETS features. Document frequencies are counted over
all training documents; the weights are trained by follow-the-regularised-leader with an elastic net on a bounded sample
of them (about SAMPLE rows, taken by hash, as many of each language, all rows of one that has fewer), of which every
eighth row of a language is kept back to calibrate a temperature, each weighted by its language's share of all rows.
Every whole text is scored by all its n-grams, weighted by frequency and rarity and scaled to unit length.

Nulls: a null text, or one without a letter, is `und` with score 0; a null lang teaches nothing; a null doc_id falls in
bucket 0 and is kept. Without any training row all is `und`. Repeated rows each get their row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import sparse_lr

#: Hash features, n-gram lengths, training rows at most (about), languages at most, characters worked on at once.
BUCKETS, GRAMS, SAMPLE, MOST_LANGUAGES, PIECE = 1 << 15, (1, 2, 3), 4096, 1024, 1 << 20
#: Training rows of a language at least (about), where it has as many.
FEWEST = 16


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    longest = max(GRAMS)
    for at in range(0, max(len(codes), 1), PIECE):
        part = codes[at : at + PIECE + longest - 1]
        for n in GRAMS:
            m = min(PIECE, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + m]) * np.uint32(0x9E3779B1)
            total += np.bincount((h >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    return total


def features(text: str, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and unit-length TF-IDF values."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * rarity[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _document_frequency(batches):
    total = np.zeros(BUCKETS, np.int64)
    for part in c.text_chunks(batches):
        for t in part.column("text").to_pylist():
            total += gram_counts(t) > 0
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.int64()), "df": pa.array(total[some])})


def fit(docs: DataFrame, training: Column) -> dict:
    """languages, rarity, weights and temperature, learnt from the rows of docs for which training holds."""
    spark = docs.sparkSession
    taught = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = [(r["lang"], r["count"]) for r in taught.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()]
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages, n = sorted(x for x, _ in counted), sum(x for _, x in counted)
    if not n:
        return {"languages": [], "rarity": None, "weights": None, "temperature": 1.0}
    df = np.zeros(BUCKETS)
    for r in taught.select("text").mapInArrow(_document_frequency, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["feature"]] = r["df"]  # BUCKETS rows at most
    rarity = np.log((1 + n) / (1 + df)) + 1.0
    held = spark.sparkContext.broadcast((languages, rarity))
    each = max(SAMPLE / len(counted), FEWEST)
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 40))
    parts = spark.createDataFrame([(x, int(min(1.0, each / k) * (1 << 40)) + 1) for x, k in counted], "lang string, _part long")
    sample = taught.join(F.broadcast(parts), "lang").filter(place < F.col("_part"))
    share = np.array([k for _, k in sorted(counted)], float)

    def train(batches):
        names, rare = held.value
        number = {x: i for i, x in enumerate(names)}
        rows, labels = [], []
        for part in c.text_chunks(batches):
            for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if has_letter(t):
                    rows.append(features(t, rare))
                    labels.append(number[lang])
        y = np.asarray(labels, np.int64)
        taken = np.bincount(y, minlength=len(names))
        nth = np.zeros(len(y), np.int64)  # number of each row among those of its language
        order = np.argsort(y, kind="stable")
        nth[order] = np.arange(len(y)) - np.repeat(np.cumsum(taken) - taken, taken)
        back = nth % 8 == 7
        w = sparse_lr.fit_ftrl([r for r, b in zip(rows, back, strict=True) if not b], y[~back], len(names), BUCKETS)
        logits = np.asarray([x @ w[at] + w[-1] for (at, x), b in zip(rows, back, strict=True) if b]).reshape(-1, len(names))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "temperature": pa.array([sparse_lr.fit_temperature(logits, y[back], (share / np.maximum(taken, 1))[y[back]])])})

    # about SAMPLE rows (or FEWEST of each language) at any input size, in a fixed order
    learnt = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "lang").mapInArrow(train, "weights binary, temperature double").first()
    return {"languages": languages, "rarity": rarity, "weights": np.frombuffer(learnt["weights"], "<f4").reshape(BUCKETS + 1, -1), "temperature": learnt["temperature"]}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id and held_out with lang_pred and score. docs: doc_id, held_out, text; nothing else is read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for part in c.text_chunks(batches):
            langs, scores = [], []
            for t in part.column("text").to_pylist():
                if not m["languages"] or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at, x = features(t, m["rarity"])
                p = sparse_lr.softmax((x @ m["weights"][at] + m["weights"][-1]) / m["temperature"])
                langs.append(m["languages"][int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Learns outside the held-out fold and predicts every row."""
    fold = c.crc_bucket(F.col("doc_id").cast("long"), folds)
    model = fit(docs, fold != held_fold)
    return predict(docs.select(F.col("doc_id").cast("long"), (fold == held_fold).alias("held_out"), F.col("text").cast("string")), model)
