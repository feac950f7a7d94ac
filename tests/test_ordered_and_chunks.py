"""Ranks by slices of time against plain windows, content-defined chunks against a loop over bytes."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import chunking, ordered


def test_ranks_by_slices_equal_plain_windows(spark):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, day + dt.timedelta(hours=rng.randrange(200))]), i, rng.choice([True, False, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, at timestamp, id long, flag boolean")
    w = Window.partitionBy("key").orderBy(F.col("at").desc(), F.col("id").desc())
    counted = F.count_if(F.coalesce("flag", F.lit(False)) & (F.col("r") > 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    plain = df.withColumn("r", F.row_number().over(w)).select("id", "r", F.lag("at").over(w), F.count("*").over(Window.partitionBy("key")), counted)
    for slice_ in ("hour", "day", "year"):
        found = ordered.ranked(df, "key", "at", "id", {"seen": F.col("flag")}, slice_)
        assert found.columns[:4] == df.columns
        assert sorted(map(tuple, found.select("id", "_rank", "_superseded", "_n", "seen").collect())) == sorted(map(tuple, plain.collect()))
    assert ordered.ranked(df.limit(0), "key", "at", "id", {"seen": F.col("flag")}).count() == 0


def test_merges_of_parts(spark):
    parts = [spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["b", "a", "a", None], ["c", "b"], [])]
    assert [r["k"] for r in ordered.union_page(parts, "k", 2).collect()] == ["a", "b"]
    assert [r["k"] for r in ordered.union_page(parts, "k", 5, "a").collect()] == ["b", "c"]
    rows = spark.createDataFrame([("x", 4), ("y", 2), ("x", 1), (None, 9)], "k string, n int")
    assert {r["k"]: r["first_at"] for r in ordered.first_seen(rows, ["k"], F.col("n")).collect()} == {"x": 1, "y": 2, None: 9}


def _slow_cuts(data: bytes, least: int, mean: int, most: int) -> list[int]:
    gear, bits, mask = [int(x) for x in chunking._gear()], mean.bit_length() - 1, (1 << 64) - 1
    hashes, h = [], 0
    for b in data:  # older bytes are shifted out of 64 bits by themselves
        h = ((h << 1) + gear[b]) & mask
        hashes.append(h)
    ends, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        for i in range(at + least, min(end, at + most)):
            if hashes[i - 1] >> (64 - bits + (-2 if i < at + mean else 2)) == 0:
                end = i
                break
        ends.append(end)
        at = end
    return ends


@pytest.mark.parametrize("size", [1, 63, 64, 65, 5000])
def test_cuts_equal_a_loop_over_bytes(size, monkeypatch):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
    want = _slow_cuts(data.tobytes(), 16, 64, 200)
    assert chunking.cuts(data, 16, 64, 200) == want
    monkeypatch.setattr(chunking, "STRETCH", 100)
    assert chunking.cuts(data, 16, 64, 200) == want


def test_chunks_make_up_their_texts_and_find_moved_stretches(spark):
    rng = np.random.default_rng(8)
    body = "".join(chr(97 + x) for x in rng.integers(0, 26, 20000))
    rows = spark.createDataFrame([(1, body), (2, "some words before " + body), (3, ""), (4, None), (None, "short")], "id long, text string")
    found = chunking.chunked(rows, F.col("id"), "text", 32, 128, 512).collect()
    texts = {}
    for r in sorted(found, key=lambda r: (r["key"] or 0, r["offset"])):
        assert r["offset"] == len(texts.get(r["key"], b""))
        texts[r["key"]] = texts.get(r["key"], b"") + bytes(r["block"])
    assert texts == {1: body.encode(), 2: b"some words before " + body.encode(), None: b"short"}
    share = chunking.duplicate_share_by_content(rows, "text", 32, 128, 512).first()
    assert share["bytes"] == 2 * len(body) + 18 + 5 and share["duplicate_bytes"] > 0.95 * len(body)
    assert chunking.duplicate_share_by_content(rows.limit(0), "text", 32, 128, 512).first()["chunks"] == 0
    with pytest.raises(ValueError):
        chunking.chunked(rows, F.col("id"), "text", 32, 100, 512)
