"""Shared helpers: Arrow text buffers as numpy arrays, word hashing, scratch tables, null-safe columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Keys of more than one in HOT rows are joined by broadcast; rows and bytes of text that another table may have to be broadcast.
HOT, SMALL_ROWS, SMALL_BYTES = 512, 20000, 1 << 22
#: A word is a run of anything but these bytes (space, tab, newline, vertical tab, form feed, return).
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset a local one is set, which only local mode may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file:" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_key(rows: DataFrame, keyed: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined by key to the one row of keyed with their key.

    keyed must be a written table whose column n counts the rows of each key. Rows of keys that hold more than one row in
    HOT stay where they are, for at most HOT rows of keyed are then broadcast; the others are shuffled.
    """
    common = F.col("n") > n_rows / HOT
    return rows.join(F.broadcast(keyed.filter(common)), key).unionByName(rows.join(keyed.filter(~common), key))


def small(df: DataFrame, text: str | None = None) -> bool:
    """Whether df (a written table) may be broadcast: SMALL_ROWS rows at most, whose text column holds SMALL_BYTES at most."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    n, size = df.agg(F.count("*"), size).first()
    return n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo buckets; a null id counts as the empty text (bucket 0)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets).cast("int")


@functools.cache
def one_blas_thread() -> None:
    """Keeps numpy's matrix products to the one core that Spark gave the task.

    Spark tells Python workers to use as many threads as the executor has cores; on small products these spin more than
    they work. A numpy without its own OpenBLAS is left as it is.
    """
    for file in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*.so*"):
        library = ctypes.CDLL(str(file))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts (or binary values) together hold about limit bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each text's limits in them; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    limits = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[limits[0] : limits[-1]], limits - limits[0]


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(kind)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 1 << 22:
            _powers[kind] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand and in any process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's limits in that list."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACES[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = limits[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, limits)


def shingle_hashes(words: np.ndarray, limits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words inside each text, and each text's limits among them; a shorter text with words is one run."""
    counts = np.diff(limits)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(limits), np.int64)
    n = max(total - size + 1, 0)
    rolled = np.zeros(total, np.uint64)
    for j in range(size):
        rolled[:n] += words[j : j + n] * _power("step", _U(0xD1342543DE82EF95), size + 1)[j + 1]
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(total) + size <= limits[1:][owner]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = limits[d], limits[d + 1]
        rolled[a] = (words[a:b] * _power("step", _U(0xD1342543DE82EF95), size + 1)[1 : b - a + 1]).sum(dtype=np.uint64) + _U(b - a)
        keep[a] = True
    return mix(rolled[keep]), np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(counts)))])


def per_text(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sums of values between each text's limits."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[limits[1:]] - sums[limits[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether this is not its first place."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later, any_twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_twice[order[1:]] |= same
    any_twice[order[:-1]] |= same
    return any_twice, later
