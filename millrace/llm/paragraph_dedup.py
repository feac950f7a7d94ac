"""Substring dedup by paragraph MinHash banding.

Every whole text is cut into small paragraphs where its own words say so: at line ends, after sentences, and inside very
long sentences after words chosen by hash, so that a passage is cut alike wherever it stands. Paragraphs of fewer than
WORDS words join the next one. Equal paragraphs meet by their hash; alike ones by MinHash keys of their 5-word shingles,
BANDS keys of one hash each (the fewest that find 95 % of pairs at LEAST), and are verified by exact Jaccard similarity.
Components of the verified links are the removals: the first occurrence (least doc_id, then place) stays, the others go.

Passages need not keep to paragraphs. Of any SPAN neighbouring runs of RUN words the one of least hash is a seed, so two
texts that share RUN + SPAN - 1 words in a row share a seed wherever the passage starts or ends. Seeds that recur are
compared with their first occurrence word by word to both sides, and what is equal goes like the paragraphs. Words to
remove go where they stand together RUN words long or more, so short phrases that many texts share stay.

Nulls: a null text is empty, has no paragraph and stays null; a null doc_id orders after all others and is never joined
to another row, so its rows are kept whole. Rows that repeat a doc_id with equal text are one document and stay equal;
other texts under the same doc_id are documents of their own, told apart by a hash of the text.
Extra columns are ignored (spans) or kept (remove).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected
from .leaders import grouped, linked

#: Words in a shingle and in the shortest paragraph, least similarity, wanted recall there, least words in a removed run.
WORDS, LEAST, RECALL, RUN = 5, 0.8, 0.95, 16
#: A sentence of more than LONG words is cut after words chosen by hash, one in EVERY.
LONG, EVERY = 24, 8
#: Neighbouring runs of RUN words among which one is a seed, and the words compared to each side of it: neighbouring seeds of a passage are nearer.
SPAN = 32


def bands_for(least: float, recall: float, rows: int = 1) -> int:
    """The fewest bands of rows hashes each that find a pair of similarity least with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


BANDS = bands_for(LEAST, RECALL)
#: Counters of shingles of paragraphs in large buckets, which say what is rare there.
COUNTERS = 1 << 16
#: A word that ends in one of these ends a sentence.
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?;:|", np.uint8))


def paragraphs(data: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    """Paragraphs of the texts of a chunk: owner (text), seg (number in the text), start and end (bytes in the text), own_words, first and last word, and the words' hashes."""
    starts, ends, places = c.word_spans(data, limits)
    words = c.span_hashes(data, starts, ends)
    n = len(words)
    if not n:
        z = np.zeros(0, np.int64)
        return {"owner": z, "seg": z, "first": z, "last": z, "start": z, "end": z, "words": words, "own_words": z}
    owner = np.repeat(np.arange(len(limits) - 1), np.diff(places))
    final = np.zeros(n, bool)
    final[places[1:][np.diff(places) > 0] - 1] = True
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    final[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]])
    hard = final.copy()
    final |= _STOP[data[ends - 1]]
    # inside sentences that run on, cut after words chosen by hash
    at = np.flatnonzero(final)
    length = np.diff(np.concatenate([[-1], at]))
    running = np.repeat(length > LONG, length)
    final[: len(running)] |= running & ((words % np.uint64(EVERY)) == 0)
    # a short paragraph joins the next one, unless its line ends there; then it joins nothing
    at = np.flatnonzero(final)
    short = np.diff(np.concatenate([[-1], at])) < WORDS
    at = at[~short | hard[at]]
    first = np.concatenate([[0], at[:-1] + 1])
    of = owner[first]
    seg = np.arange(len(first)) - np.searchsorted(of, of)
    counts = at - first + 1
    return {"owner": of, "seg": seg, "first": first, "last": at, "start": starts[first] - limits[of], "end": ends[at] - limits[of], "words": words, "own_words": counts}


def _shingles(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each paragraph and their limits; paragraphs stand side by side in the word array."""
    return c.shingle_hashes(words, np.concatenate([first, last[-1:] + 1]), WORDS)


def seeds(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the seeds of each text; a text of fewer runs than SPAN has one among all of them."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))[:n]
    rolled = np.zeros(n, np.uint64)
    for j in range(RUN):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    hashes = c.mix(rolled)
    # the low bits name the place, later ones first among equal hashes
    low = np.uint64((1 << 20) - 1)
    inside = np.arange(n) + RUN <= places[1:][owner]
    ranked = np.where(inside, (hashes & ~low) | (~np.arange(n)).astype(np.uint64) & low, np.uint64((1 << 64) - 1))
    best, step = np.concatenate([ranked, np.full(SPAN, (1 << 64) - 1, np.uint64)]), 1
    while step < SPAN:
        best[:-step] = np.minimum(best[:-step], best[step:])
        step *= 2
    begin = np.flatnonzero(np.arange(n) + RUN + SPAN - 1 <= places[1:][owner])
    least = best[begin]
    size = np.diff(places)
    few = np.flatnonzero((size >= RUN) & (size < RUN + SPAN - 1))
    if len(few):
        edges = np.stack([places[:-1][few], places[1:][few] - RUN + 1], axis=1).ravel()
        least = np.concatenate([least, np.minimum.reduceat(np.append(ranked, ranked[-1:]), edges)[::2]])
        begin = np.concatenate([begin, places[:-1][few]])
    at = np.unique(begin + (((~least & low).astype(np.int64) - begin) & int(low)))
    keys = hashes[at]
    # words said over and over are chosen at every place: one in SPAN is enough
    fresh = np.ones(len(at), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[at[1:]] != owner[at[:-1]])
    since = (at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) // SPAN
    fresh[1:] |= since[1:] != since[:-1]
    return at[fresh], keys[fresh]


def _seed_rows(batches):
    for part in c.text_chunks(batches):
        data, limits = c.buffers(part.column("text"))
        starts, ends, places = c.word_spans(data, limits)
        at, keys = seeds(c.span_hashes(data, starts, ends), places)
        of = np.searchsorted(places, at, "right") - 1
        own = [part.column(k).take(pa.array(of)) for k in ("doc_id", "dig")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *own, pa.array((at - places[of]).astype(np.int32))], names=["key", "doc", "dig", "pos"])


def _sides(batches):
    """Each named seed with 32 bits of the SPAN words before it (the nearest first) and after it, and how many there are."""
    reach = np.arange(SPAN)
    for part in c.text_chunks(batches):
        data, limits = c.buffers(part.column("text"))
        starts, ends, places = c.word_spans(data, limits)
        words = c.span_hashes(data, starts, ends).astype(np.uint32)
        named = part.column("named")
        of = np.repeat(np.arange(part.num_rows), named.value_lengths().to_numpy(zero_copy_only=False))
        flat = named.flatten()
        pos = flat.field("pos")
        at = pos.to_numpy().astype(np.int64) + places[of]
        n = np.stack([np.minimum(at - places[of], SPAN), np.minimum(places[of + 1] - at - RUN, SPAN)], axis=1)
        before = words[np.maximum(at[:, None] - 1 - reach, 0)] if len(at) else np.zeros((0, SPAN), np.uint32)
        after = words[np.minimum(at[:, None] + RUN + reach, len(words) - 1)] if len(at) else before
        held = np.concatenate([n.astype(np.uint32), before, after], axis=1)
        sides = pa.array([x.tobytes() for x in held], pa.binary())
        own = [part.column(k).take(pa.array(of)) for k in ("doc", "dig")]
        yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("key", "n", "leads")), *own, pos, sides], names=["key", "n", "leads", "doc", "dig", "pos", "sides"])


def _extended(batches):
    """The words of each text, around a seed, that equal those around the seed's first occurrence."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in ("sides", "first_sides"))
        n = np.minimum(x[:, :2], y[:, :2])
        equal = (x == y)[:, 2:].reshape(-1, 2, SPAN) & (np.arange(SPAN) < n[:, :, None])
        more = np.logical_and.accumulate(equal, axis=2).sum(axis=2)
        pos = batch.column("pos").to_numpy().astype(np.int64)
        columns = [batch.column("doc"), batch.column("dig"), pa.array((pos - more[:, 0]).astype(np.int32)), pa.array((pos + RUN + more[:, 1]).astype(np.int32)), batch.column("first")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "dig", "start", "end", "first"])


def _rows(kind: str):
    """Rows of a chunk: the exact hash of each paragraph, or its MinHash keys."""

    def run(batches):
        for part in c.text_chunks(batches):
            found = paragraphs(*c.buffers(part.column("text")))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(found["owner"]):
                continue
            doc, seg = ids[found["owner"]], found["seg"].astype(np.int32)
            dig = part.column("dig").to_numpy(zero_copy_only=False)[found["owner"]]
            hashes, at = _shingles(found["words"], found["first"], found["last"])
            if kind == "exact":
                # the words in their order: a shingle's hash depends on its five, its factor on its place
                nth = (np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
                placed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.mix(hashes + nth * np.uint64(0x9E3779B97F4A7C15)))])
                keys = [c.mix((placed[at[1:]] - placed[at[:-1]]) ^ found["own_words"].astype(np.uint64))]
            else:
                keys = [c.mix(np.minimum.reduceat(c.mix(hashes ^ np.uint64(0xA24BAED4963EE407 * (b + 1) & (1 << 64) - 1)), at[:-1]) + np.uint64(b)) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(doc, len(keys))), pa.array(np.tile(dig, len(keys))), pa.array(np.tile(seg, len(keys)))], names=["key", "doc", "dig", "seg"])

    return run


def _texts_of(places_then_text):
    """Shingle hashes of the named paragraphs of each text."""
    for batch in places_then_text:
        for part in c.text_chunks([batch]):
            found = paragraphs(*c.buffers(part.column("text")))
            edges = np.searchsorted(found["owner"], np.arange(part.num_rows + 1))
            hashes, at = _shingles(found["words"], found["first"], found["last"]) if len(found["owner"]) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
            doc, dig, seg, out = [], [], [], []
            for d, (i, h, segs) in enumerate(zip(*(part.column(k).to_pylist() for k in ("doc", "dig", "segs")), strict=True)):
                for s in segs:
                    p = edges[d] + s
                    doc.append(i)
                    dig.append(h)
                    seg.append(s)
                    out.append(np.unique(hashes[at[p] : at[p + 1]]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "dig": pa.array(dig, pa.int64()), "seg": pa.array(seg, pa.int32()), "shingles": pa.array(out, pa.list_(pa.int64()))})


def _block_links(batches):
    def sets(batch):
        return [(k, np.ones(len(k), np.float32)) for k in (np.asarray(x, np.int64) for x in batch.column("shingles").to_pylist())]

    kind = pa.struct([("doc", pa.int64()), ("dig", pa.int64()), ("seg", pa.int32())])
    for links in grouped(batches, sets, lambda node: (node["doc"], node["dig"], node["seg"]), LEAST):
        a, b = ([dict(zip(("doc", "dig", "seg"), x[k], strict=True)) for x in links] for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, kind), "b": pa.array(b, kind), "similarity": pa.array([x[2] for x in links], pa.float64())})


def _counted(batches):
    """How often each counter's shingles occur in a task's rows."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_counter(batch.column("shingles").flatten().to_numpy()), minlength=COUNTERS)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _added(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"counts": [sum(np.frombuffer(x, "<i8") for x in df["counts"]).astype("<i8").tobytes()]})


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of distinct shingles, so many that any set alike by LEAST has one of them among its own rarest.

    Alike sets share LEAST of either at least; the first shared one, in one order for all sets, has no more than the others
    before it. Any order will do: counts that lump shingles together cost comparisons, not links.
    """
    order = np.lexsort((shingles, counts[_counter(shingles)]))
    return shingles[order[: len(shingles) - math.ceil(LEAST * len(shingles) - 1e-6) + 1]]


def _finer(held):
    """Rows of large buckets, dealt by bucket and rare shingle."""

    def run(batches):
        for batch in batches:
            found = [rarest(np.asarray(x, np.int64), held.value) for x in batch.column("shingles").to_pylist()]
            n = [len(x) for x in found]
            of = np.repeat(np.arange(batch.num_rows), n)
            shingles = np.concatenate([*found, np.zeros(0, np.int64)]).view(np.uint64)
            keys = c.mix(batch.column("key").to_numpy().view(np.uint64)[of] ^ c.mix(shingles))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("node").take(pa.array(of))], names=["key", "node"])

    return run


def _cut(batches):
    """Removes the words of each text that are to go and stand in long enough runs; white space around a run closes up."""
    for part in c.text_chunks(batches):
        data, limits = c.buffers(part.column("text"))
        starts, ends, places = c.word_spans(data, limits)
        found = paragraphs(data, limits)
        edges = np.searchsorted(found["owner"], np.arange(part.num_rows + 1))
        texts, spans, gone_words, firsts = [], [], [], []
        for d, gone in enumerate(part.column("gone").to_pylist()):
            raw = data[limits[d] : limits[d + 1]]
            runs, n_gone, of = [], 0, set()
            if gone:
                base = places[d]
                where = []  # first word, word after the last, document that keeps it
                for g in gone:
                    if g["seg"] is None:
                        where.append((g["start"], g["end"], g["first"]))
                    else:
                        p = edges[d] + g["seg"]
                        where.append((found["first"][p] - base, found["last"][p] + 1 - base, g["first"]))
                inside, keeper = np.zeros(places[d + 1] - base + 2, np.int8), np.zeros(places[d + 1] - base, np.int64)
                for x, y, first in sorted(where, key=lambda x: -x[2]):  # the least document is painted last
                    inside[x + 1 : y + 1] = 1
                    keeper[x:y] = first
                change = np.diff(inside)
                begin, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                long = stop - begin >= RUN
                begin, stop = begin[long], stop[long]
                runs = list(zip((starts[base + begin] - limits[d]).tolist(), (ends[base + stop - 1] - limits[d]).tolist(), strict=True))
                n_gone = int((stop - begin).sum())
                of = set(np.concatenate([*(keeper[x:y] for x, y in zip(begin, stop, strict=True)), keeper[:0]]).tolist())
            if runs:
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a].tobytes())
                    at = b + 1 if b < len(raw) and c.SPACES[raw[b]] else b
                kept.append(raw[at:].tobytes())
                texts.append(b"".join(kept).decode("utf-8", "replace"))
            else:
                texts.append(None)
            spans.append([{"start": a, "end": b} for a, b in runs])
            gone_words.append(n_gone)
            firsts.append(sorted(of))
        n = np.diff(edges)
        columns = [part.column(k) for k in range(part.num_columns) if part.schema.names[k] not in ("text", "gone")]
        names = [k for k in part.schema.names if k not in ("text", "gone")]
        columns += [pa.array(n.astype(np.int64)), pa.array(gone_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(firsts, pa.list_(pa.int64()))]
        whole = part.column("text").to_pylist()
        columns.append(pa.array([w if t is None else t for w, t in zip(whole, texts, strict=True)], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_paragraphs", "removed_words", "removed", "first_docs", "text"])


RESULT = "n_paragraphs long, removed_words long, removed array<struct<start:long,end:long>>, first_docs array<long>, text string"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, dig, text of the rows that take part; dig tells texts of one doc_id apart."""
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("dig"), "text")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc, dig, start, end, first: words that equal, RUN or more in a row, earlier ones, and the document that keeps them. docs: doc_id, text."""
    texts = _texts(docs)
    place = F.struct("doc", "dig", "pos")
    found = c.written(texts.mapInArrow(_seed_rows, "key long, doc long, dig long, pos int"), "paragraph-seeds")
    twice = found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    again = c.written(c.with_key(found, c.written(twice, "paragraph-recurring"), "key", found.count()).drop("n"), "paragraph-again")
    # who leads is settled before the words around the seeds are read, so these are shuffled once
    leads = c.written(again.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("lead")), "paragraph-leads")
    n_rows = again.count()
    marked = c.with_key(again, leads, "key", n_rows).select("doc", "dig", F.struct("pos", "key", "n", (place == F.col("lead")).alias("leads")).alias("seed"))
    named = marked.groupBy("doc", "dig").agg(F.collect_set("seed").alias("named"))
    texts = texts.withColumnRenamed("doc_id", "doc").join(named, ["doc", "dig"]).select("doc", "dig", "named", "text").dropDuplicates(["doc", "dig"])
    sides = c.written(texts.mapInArrow(_sides, "key long, n long, leads boolean, doc long, dig long, pos int, sides binary"), "paragraph-sides")
    lead = sides.filter("leads").select("key", "n", F.col("doc").alias("first"), F.col("sides").alias("first_sides"))
    met = c.with_key(sides.filter("not leads").drop("n", "leads"), lead, "key", n_rows).select("doc", "dig", "pos", "sides", "first", "first_sides")
    return met.mapInArrow(_extended, "doc long, dig long, start int, end int, first long").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc, dig, seg, first: paragraphs that repeat an earlier one, and the document that keeps it. docs: doc_id, text."""
    texts = _texts(docs)
    place = F.struct("doc", "dig", "seg")
    columns = "key long, doc long, dig long, seg int"

    def repeats(kind: str) -> DataFrame:
        """Paragraphs that share a key with an earlier one, and the first of that key; keys that occur once go before any join."""
        rows = c.written(texts.mapInArrow(_rows(kind), columns), f"paragraph-{kind}-keys")
        leads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("lead")).filter(F.col("n") > 1)
        return c.with_key(rows, c.written(leads, f"paragraph-{kind}-leads"), "key", rows.count()).filter(place != F.col("lead")).drop("n")

    same = c.written(repeats("exact").select("doc", "dig", "seg", "lead").distinct(), "paragraph-equal")
    # what repeats an earlier paragraph exactly is settled; only first occurrences look for paragraphs that are alike
    near = c.written(repeats("alike").distinct().join(same.select("doc", "dig", "seg"), ["doc", "dig", "seg"], "left_anti"), "paragraph-alike")
    buckets = near.select("key", place.alias("node")).unionByName(near.select("key", F.col("lead").alias("node"))).distinct()
    buckets = c.written(buckets, "paragraph-buckets")
    needed = buckets.select("node.doc", "node.dig", "node.seg").distinct().groupBy("doc", "dig").agg(F.collect_set("seg").alias("segs"))
    named = texts.withColumnRenamed("doc_id", "doc").join(needed, ["doc", "dig"]).select("doc", "dig", "segs", "text").mapInArrow(_texts_of, "doc long, dig long, seg int, shingles array<long>")
    sets = c.written(named.dropDuplicates(["doc", "dig", "seg"]).select(place.alias("node"), "shingles"), "paragraph-shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))

    def blocks(met: DataFrame) -> DataFrame:
        rows = met.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "node", "shingles")
        return rows.mapInArrow(_block_links, "a struct<doc:long,dig:long,seg:int>, b struct<doc:long,dig:long,seg:int>, similarity double")

    def finer(rows: DataFrame) -> DataFrame:
        met = c.written(rows.join(sets, "node"), "paragraph-large")
        parts = met.select("shingles").mapInArrow(_counted, "counts binary")
        # added up in two steps, so that no task meets all tasks' counters
        parts = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("_salt").applyInPandas(lambda df: _added(df[["counts"]]), "counts binary")
        counts = np.frombuffer(parts.groupBy().applyInPandas(_added, "counts binary").first()["counts"], "<i8")
        held = rows.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
        return met.mapInArrow(_finer(held), "key long, node struct<doc:long,dig:long,seg:int>")

    links = linked(buckets, alike, blocks, LEAST, "paragraph", finer)
    classes = c.written(connected(links.select("a", "b"), "paragraph-components"), "paragraph-classes")
    others = classes.filter(F.col("node") != F.col("root")).select("node.doc", "node.dig", "node.seg", F.col("root.doc").alias("first"))
    equal = same.join(classes.withColumnRenamed("node", "lead"), "lead", "left").select("doc", "dig", "seg", F.coalesce("root.doc", "lead.doc").alias("first"))
    return c.written(others.unionByName(equal), "paragraph-removals")


def _judged(docs: DataFrame, names: list[str], types: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.lit(None).cast("int")
    gone = removals(texts).select("doc", "dig", "seg", none.alias("start"), none.alias("end"), "first")
    gone = gone.unionByName(repeated_runs(texts).select("doc", "dig", none.alias("seg"), "start", "end", "first"))
    gone = gone.groupBy(F.col("doc").alias("_mr_doc"), F.col("dig").alias("_mr_dig")).agg(F.collect_list(F.struct("seg", "start", "end", "first")).alias("gone"))  # at most the paragraphs and seeds of one text
    joined = docs.join(gone, (docs["doc_id"].cast("long") == F.col("_mr_doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_mr_dig")), "left")
    return joined.select(*names, F.col("text").cast("string").alias("text"), "gone").mapInArrow(_cut, f"{types}, {RESULT}")


def spans(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_paragraphs, removed_words, removed (byte spans), first_docs (where they stay), text (what stays)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _judged(rows, ["doc_id"], "doc_id long")


def remove(docs: DataFrame) -> DataFrame:
    """docs with the removed passages cut from text (and n_chars counted again where there is one); what loses all its words goes."""
    # columns travel under numbers, so that none of their names can clash with the operator's own
    others = {f.name: (f"_mr_{i}", f.dataType) for i, f in enumerate(docs.schema) if f.name != "text"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{x}`").alias(own) for x, (own, _) in others.items()))
    out = _judged(rows, [own for own, _ in others.values()], ", ".join(f"{own} {kind.simpleString()}" for own, kind in others.values()))
    out = out.filter((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in others:
        own, kind = others["n_chars"]
        out = out.withColumn(own, F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col(own)).cast(kind))
    return out.select(*("text" if x == "text" else F.col(others[x][0]).alias(x) for x in docs.columns))
