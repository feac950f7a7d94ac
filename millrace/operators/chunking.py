"""Content-defined chunks: texts are cut where the bytes say so, so equal stretches give equal chunks wherever they stand."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import share_of

#: Bytes that a place's hash reads, and bytes that are hashed at once.
REACH, STRETCH = 64, 1 << 20


@functools.cache
def _gear() -> np.ndarray:
    """A fixed random word for each byte."""
    return np.random.default_rng(2024).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the words of the last REACH bytes, each shifted left by its age; doubled up in six steps."""
    out = _gear()[data]
    for k in (1, 2, 4, 8, 16, 32):
        out[k:] += out[:-k] << np.uint64(k)  # the right side is made before it is added
    return out


def _candidates(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a cut may lie: those of the strict mask (bits + 2) and of the loose one (bits - 2)."""
    strict, loose = [], []
    for at in range(0, len(data), STRETCH):
        lead = min(at, REACH - 1)
        top = _hashes(data[at - lead : at + STRETCH])[lead:]
        strict.append(np.flatnonzero(top >> np.uint64(64 - bits - 2) == 0) + at + 1)
        loose.append(np.flatnonzero(top >> np.uint64(64 - bits + 2) == 0) + at + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *strict]), np.concatenate([none, *loose])


def cuts(data: np.ndarray, least: int, mean: int, most: int) -> list[int]:
    """Ends of the chunks: the first strict place from `least` bytes up to `mean`, else the first loose one up to `most`, else there."""
    strict, loose = _candidates(data, mean.bit_length() - 1)
    ends, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        for found, low, high in ((strict, at + least, at + mean), (loose, at + mean, at + most)):
            i = np.searchsorted(found, low)
            if i < len(found) and found[i] < min(high, end):
                end = int(found[i])
                break
        ends.append(end)
        at = end
    return ends


def _chunked(least: int, mean: int, most: int):
    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1), strict=True):
                data = np.frombuffer(raw.as_py(), np.uint8)
                ends = cuts(data, least, mean, most)
                starts = [0, *ends][: len(ends)]
                blocks = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(ends), batch.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "offset", "block"])

    return run


def chunked(df: DataFrame, key: Column, text: str, least: int, mean: int, most: int) -> DataFrame:
    """key, offset, block of every chunk; null and empty texts have none. mean: a power of two of at least 8, least <= mean <= most.

    Texts stay in the tasks that read them.
    """
    if not (8 <= mean and mean & (mean - 1) == 0 and 0 < least <= mean <= most):
        raise ValueError("chunk sizes")
    rows = df.select(key.alias("key"), F.col(text).cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    schema = rows.select("key").schema.add("offset", "long").add("block", "binary")
    return rows.mapInArrow(_chunked(least, mean, most), schema)


def duplicate_share_by_content(df: DataFrame, text: str, least: int, mean: int, most: int) -> DataFrame:
    """duplicate_share() over content-defined chunks."""
    return share_of(chunked(df, F.lit(0), text, least, mean, most).select("block"))
