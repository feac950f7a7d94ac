"""Best-fit packing of documents into sequences by swap-based local search.

Documents become pieces of at most `size` tokens; pieces are dealt evenly to groups of about GROUP pieces. A group starts
from a best fit in order of arrival. Then the emptiest sequence gives its pieces away: a piece moves to the sequence
that it fills best, or one piece, or two, are exchanged for a smaller one of another sequence. Each step raises the
sum of squared fills, so the search ends by itself: every sequence is emptied, or no step is left for it, or the group
has no more sequences than its tokens need. A group wastes less than one sequence beyond that, so GROUP pieces cost under
0.1 % more sequences than one global packing could save, and groups grow in number, not in size.

Nulls: a null text is empty and packs as its end token; a null doc_id stays null. Repeated rows are packed each. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokenizers_public as tk

#: Tokens in a sequence, the token that ends each document, pieces in a group.
SIZE, END, GROUP = 2048, 0, 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(size: int):
    def run(batches):
        for part in c.text_chunks(batches):
            out = {k.split()[0]: [] for k in PIECES.split(", ")}
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tk.byte_bpe_ids(part.column("text").fill_null("").to_pylist()), strict=True):
                raw = np.asarray([*ids, END], "<u4")
                first = (len(raw) - 1) % size + 1
                starts = [0, *range(first, len(raw), size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw)], strict=True)):
                    for name, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(raw[a:b].tobytes())), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "piece": pa.array(out["piece"], pa.int32())} | {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")})

    return run


def pieces(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces of every document: only longer ones are cut, and then the first piece is the odd one."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(size), PIECES)


def as_they_come(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece in order of arrival: the open bin that it fills best."""
    out = np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    n = 0
    for i, x in enumerate(lengths.tolist()):
        at = bisect.bisect_left(room, (x, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = size, n
            n += 1
        out[i] = b
        if left > x:
            bisect.insort(room, (left - x, b))
    return out


def improve(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Local search: moves and exchanges of one for one or two for one out of the emptiest bin, until bins empty."""
    lengths, bins = lengths.astype(np.int64), bins.copy()
    if not len(bins):
        return bins
    fill = np.bincount(bins, lengths).astype(np.int64)
    members = [set() for _ in fill]
    for i, b in enumerate(bins.tolist()):
        members[b].add(i)
    live, least = int((fill > 0).sum()), -(-int(lengths.sum()) // size)
    room = sorted((size - f, b) for b, f in enumerate(fill.tolist()) if f < size)  # of bins that are not full

    def change(b: int, by: int):
        at = bisect.bisect_left(room, (size - int(fill[b]), b))
        if at < len(room) and room[at] == (size - int(fill[b]), b):
            room.pop(at)
        fill[b] += by
        if fill[b] < size:
            bisect.insort(room, (size - int(fill[b]), b))

    def put(i: int, b: int):
        members[bins[i]].remove(i)
        members[b].add(i)
        bins[i] = b

    heap: list[tuple[int, int]] = []
    again = True
    while live > least and (heap or again):
        if not heap:  # what was stuck may not be so any more
            heap, again = [(f, b) for b, f in enumerate(fill.tolist()) if 0 < f < size], False
            heapq.heapify(heap)
            continue
        f, a = heapq.heappop(heap)
        if f != fill[a] or f == 0:
            continue
        while fill[a] and live > least:
            mine = sorted(members[a], key=lambda i: (-lengths[i], i))
            moved = False
            for i in mine:
                at = bisect.bisect_left(room, (int(lengths[i]), -1))
                if at < len(room) and room[at][1] == a:
                    at += 1
                if at < len(room) and fill[room[at][1]] + lengths[i] > fill[a]:
                    b = room[at][1]
                    change(a, -int(lengths[i]))
                    change(b, int(lengths[i]))
                    put(i, b)
                    moved = again = True
                    break
            if moved:
                continue
            found = _exchange(lengths, bins, fill, size, a, mine)
            if found is None:
                break
            leaving, j, gain = found
            b = int(bins[j])
            change(a, -gain)
            change(b, gain)
            for i in leaving:
                put(i, b)
            put(j, a)
            again = True
            heapq.heappush(heap, (int(fill[b]), b))
        if not fill[a]:
            live -= 1
            at = bisect.bisect_left(room, (size, a))
            if at < len(room) and room[at] == (size, a):  # an empty bin takes nothing any more
                room.pop(at)
    return bins


def _exchange(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, size: int, a: int, mine: list[int]) -> tuple[tuple[int, ...], int, int] | None:
    """The exchange out of bin a that raises squared fills most: one piece for one, else two for one; what leaves, what comes, the gain."""
    of: dict[int, list[int]] = {}
    for i in mine:
        of.setdefault(int(lengths[i]), []).append(i)
    single = {x: tuple(i[:1]) for x, i in of.items()}
    sizes = sorted(of)
    double = {x + y: (of[x][0], of[y][1 if x == y else 0]) for k, x in enumerate(sizes) for y in sizes[k:] if x != y or len(of[x]) > 1}  # equal sums are alike
    other = np.flatnonzero((bins != a) & (fill[bins] < size) & (fill[bins] > 0))
    own, to = lengths[other], bins[other]
    for groups in (single, double):
        if groups and len(own):
            sums, held = np.array(sorted(groups)), fill[to]
            at = np.searchsorted(sums, own + size - held, "right") - 1  # the greatest that fits
            gain = np.where(at >= 0, sums[np.maximum(at, 0)] - own, 0)
            squares = np.where(gain > 0, gain * (held - fill[a] + gain), 0)
            best = int(squares.argmax())
            if squares[best] > 0:
                return groups[int(sums[at[best]])], int(other[best]), int(gain[best])
    return None


def _pack_group(size: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = df["length"].to_numpy()
        bins = improve(lengths, as_they_come(lengths, size), size)
        order = np.argsort(bins, kind="stable")
        df, bins, lengths = df.iloc[order].reset_index(drop=True), bins[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        df["offset"] = before - np.maximum.accumulate(np.where(first, before, 0))
        df["sequence_id"] = (df["_group"].to_numpy(np.int64) << 32) + np.cumsum(first) - 1
        return df[[x.split()[0] for x in PACKED.split(", ")]].astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # the row number, fixed by writing it, deals rows evenly whatever their ids are
    cut = c.written(pieces(docs, size).withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, round(cut.count() / GROUP))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).drop("_row")
    return dealt.groupBy("_group").applyInPandas(_pack_group(size), PACKED)
