"""Scoring of texts by a causal self-attention language model, beside a word model for reference.

A text is drawn in two ways, whose probabilities are averaged. The attention model draws it subword by subword (pieces of
a public byte-level BPE, the most frequent ones; other pieces are spelled in bytes, so nothing is lost), each from those
before it, on top of counts of subword pairs. The counts of words draw it word by word: first an id (the most frequent
words have ids of their own, every other word has that of its first subword), then which word of the id it is, by the
counts of the training words, discounted; what the discount frees goes to a chain of subwords that can spell any word.

One pass counts the words of all texts (a table that grows with the corpus). From it come, over all training texts, the
base score's counts, the subwords, their pairs, the ids, the counts in them and the chain. A second pass turns every text
into ids and subwords, once, for training and scoring. The attention weights are trained on every subword of every training
text, each read once: texts are dealt by hash to ROUNDS rounds; in a round every task trains the weights on its own texts
and the results are averaged, weighted by their subwords, in grouped sums. The most frequent words travel to all tasks as
one table of HEAD entries at most; what a text holds of rarer words is joined to the word table by hash, so no text and no
vocabulary is ever broadcast.

A text reads: its words (runs of anything but ASCII white space, A-Z lowered), each with one space before it, then the
end. Nulls: a null text is empty: one token, the end. A null doc_id belongs to fold 0 and stays null. Repeated rows each
get their row. Extra columns are ignored. With no training text all counts are 0 and the model is the uniform prior.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention_lm as lm
from . import common as c
from . import tokenizers_public as tk

#: Words that are broadcast at most, rounds of training, subwords that a task trains on at once (about), and folds.
HEAD, ROUNDS, PART, FOLDS = 1 << 17, 6, 1 << 20, 10
#: Rows of blocks that are scored together.
ROWS = 256
#: White space that may stand inside a word.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Tasks' states are added up in this many groups first.
GROUPS = 32
#: The word model's constant, how many observations the unigram of chain and prior stands for, and what a counted word gives to the chain.
ADD, ALPHA, DISCOUNT = 0.1, 4.0, 0.75
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(part: pa.RecordBatch):
    data, limits = c.buffers(part.column("text"))
    data = _LOWER[data]
    starts, ends, places = c.word_spans(data, limits)
    return data, starts, ends, places, c.span_hashes(data, starts, ends)


def _counted(batches):
    """hash, word, n_train and n_all of the distinct words of each chunk; the end token is the word of no bytes."""
    ends = [0, 0]
    for part in c.text_chunks(batches, limit=4 * c.CHUNK_BYTES):
        data, starts, stops, places, hashes = _words(part)
        taught = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        ends[0] += int(taught.sum())
        ends[1] += part.num_rows
        unique, first, where, every = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        train = np.bincount(where, np.repeat(taught, np.diff(places)), minlength=len(unique)).astype(np.int64)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"hash": pa.array(unique.view(np.int64)), "word": pa.array(words, pa.binary()), "n_train": pa.array(train), "n_all": pa.array(every.astype(np.int64))})
    if ends[1]:
        yield pa.RecordBatch.from_pydict({"hash": pa.array([0], pa.int64()), "word": pa.array([b""], pa.binary()), "n_train": pa.array(ends[:1], pa.int64()), "n_all": pa.array(ends[1:], pa.int64())})


def word_table(docs: DataFrame) -> DataFrame:
    """hash, word, n_train, n_all over all texts of docs (held_out, text); the end token has hash 0."""
    parts = docs.select("held_out", "text").mapInArrow(_counted, "hash long, word binary, n_train long, n_all long")
    return parts.groupBy("hash", "word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the public byte-level BPE for words with a space before each, one after another, and how many each has.

    The words are encoded as one text, which the pattern cuts at the spaces; those that hold other white space go alone.
    """
    quick, (spaced, *_) = tk.rank_tokenizer(tk.path("byte_bpe_50k.tiktoken")), _spelled()
    encode = lambda text: quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = (b" " + b" ".join(words)).decode("utf-8", "replace")
    if _OTHER_SPACE.search(text):
        found = [encode(" " + w.decode("utf-8", "replace")) for w in words]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)
    ids = encode(text)
    return ids, np.diff(np.append(np.flatnonzero(spaced[ids]), len(ids)))


@functools.cache
def _spelled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all BPE ids: whether it begins with a space, its bytes, and each id's limits in them."""
    quick = tk.rank_tokenizer(tk.path("byte_bpe_50k.tiktoken"))
    every = [quick.decode_single_token_bytes(i) for i in range(quick.n_vocab)]
    return np.array([x[:1] == b" " for x in every]), np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in every])])


def _piece_counts(batches):
    """How often each BPE id occurs in the training words of a task."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids, sizes = pieces(batch.column("word").to_pylist())
        total += np.bincount(ids, np.repeat(batch.column("n_train").to_numpy(), sizes), minlength=1 << 16).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(some), "n": pa.array(total[some])})


class Vocabulary:
    """Subword ids: 0 the end of a word, 1 to 256 the bytes, then the most frequent pieces of two bytes or more."""

    def __init__(self, chosen: list[int]):
        spaced, data, limits = _spelled()
        self.initial = np.zeros(lm.IDS, bool)
        self.initial[[0, 1 + 0x20]] = True
        self.pool = np.concatenate([np.arange(lm.IDS), data.astype(np.int64) + 1])
        self.begin, self.length = limits[:-1] + lm.IDS, np.diff(limits)
        kept = [i for i in chosen[: lm.IDS - 257] if self.length[i] > 1]
        self.size = 257 + len(kept)
        self.begin[kept], self.length[kept] = np.arange(257, self.size), 1
        self.initial[257 : self.size] = spaced[kept]

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        found, sizes = pieces(words)
        n = self.length[found]
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.begin[found] - sums[:-1], n) + np.arange(sums[-1])], sums[ends] - sums[ends - sizes]


def _pair_counts(chosen):
    def run(batches):
        vocabulary = Vocabulary(chosen.value)
        # of distinct words: row: the id before; column: the id after, or 0 for the end of the word; row 0: the first ids of
        # words; the next row: the first ids of all words, repeats counted; then rows like the first ones, repeats counted
        total = np.zeros((2 * lm.IDS + 1, lm.IDS), np.int64)
        for batch in batches:
            ids, sizes = vocabulary.ids(batch.column("word").to_pylist())
            last = np.cumsum(sizes) - 1
            before = np.concatenate([[0], ids[:-1]])
            before[last - sizes + 1] = 0
            np.add.at(total.ravel(), before * lm.IDS + ids, 1)
            np.add.at(total[:, 0], ids[last], 1)
            n = batch.column("n_train").to_numpy()
            np.add.at(total[lm.IDS], ids[last - sizes + 1], n)
            np.add.at(total.ravel(), (lm.IDS + 1 + before) * lm.IDS + ids, np.repeat(n, sizes))
            np.add.at(total[lm.IDS + 1 :, 0], ids[last], n)
        some = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"a": pa.array((some // lm.IDS).astype(np.int32)), "b": pa.array((some % lm.IDS).astype(np.int32)), "n": pa.array(total.ravel()[some])})

    return run


def prior_of(pairs: np.ndarray, vocabulary: Vocabulary, texts: int) -> dict[str, np.ndarray]:
    """Log probabilities of the next subword given the last one: pairs inside words, and first ones where a word has ended."""
    initial = vocabulary.initial
    first = np.where(initial, pairs[0] + 0.02, 0)
    first[0] = texts + 0.02
    first /= first.sum()
    inner = pairs[1:].sum(axis=0)
    stop = inner[0] + 1
    inner = np.where(initial, 0, inner + 0.02)
    inner[vocabulary.size :] = 1e-6  # ids that no piece uses
    unigram, boundary = inner / (inner.sum() + stop), stop / (inner.sum() + stop)
    own, ends = pairs.astype(float), pairs[:, 0].astype(float)
    own[:, initial] = 0
    total = own.sum(axis=1) + ends + ALPHA
    p = (own + ALPHA * unigram) / total[:, None] + ((ends + ALPHA * boundary) / total)[:, None] * first[None, :]
    p[0] = first + 1e-9 * unigram  # after the end of a text a word or another end begins
    p /= p.sum(axis=1, keepdims=True)
    return {"mem": np.log(p + 1e-12).astype(np.float32), "cls": np.log(p.reshape(lm.IDS, lm.CLASSES, lm.MEMBERS).sum(axis=2) + 1e-12).astype(np.float32)}


class Lexicon:
    """Word ids (0 the end, then first subwords, then frequent words) and log10 probabilities of the words of an id."""

    def __init__(self, pairs: np.ndarray, chosen: list[int], frequent: list, texts: int):
        """frequent: rows of word and n_train, most frequent first; what the ids don't hold is left out."""
        self.chosen = chosen
        vocabulary = Vocabulary(chosen)
        inner, ends = pairs[: lm.IDS].astype(float), pairs[: lm.IDS, 0] + 0.0
        inner[:, vocabulary.initial] = 0  # none of these is inside a word, and 0 is its end
        inner[0] = 0
        known = ~vocabulary.initial & (np.arange(lm.IDS) < vocabulary.size)
        unigram, stop = np.where(known, inner.sum(axis=0) + 0.02, 0), ends[1:].sum() + 1
        whole = unigram.sum() + stop
        total = inner.sum(axis=1) + ends + ALPHA
        self.step = np.log10((inner + ALPHA * unigram / whole) / total[:, None] + 1e-12).astype(np.float32)
        self.stop = np.log10((ends + ALPHA * stop / whole) / total)
        firsts = np.flatnonzero(vocabulary.initial)[1:]
        self.start = np.zeros(lm.IDS, np.uint16)
        self.start[firsts] = 1 + np.arange(len(firsts))
        own = [r for r in frequent if r["n_train"] > 0][: lm.IDS - 1 - len(firsts)]
        self.size = 1 + len(firsts) + len(own)
        self.own = {bytes(r["word"]): 1 + len(firsts) + i for i, r in enumerate(own)}
        # how many words, distinct ones, and what part of the chain's probability is left when the frequent words are gone
        self.n, self.types, self.left = np.zeros(lm.IDS, np.int64), np.zeros(lm.IDS, np.int64), np.ones(lm.IDS)
        self.n[1 : 1 + len(firsts)], self.types[1 : 1 + len(firsts)] = pairs[lm.IDS, firsts], pairs[0, firsts]
        found, sizes = vocabulary.ids([bytes(r["word"]) for r in own])
        spelled = self._chain(found, sizes)
        for i, (row, ids) in enumerate(zip(own, found[np.cumsum(sizes) - sizes], strict=True)):
            at = self.start[ids]
            self.n[at] -= row["n_train"]
            self.types[at] -= 1
            self.left[at] -= 10.0 ** spelled[i]
            self.n[1 + len(firsts) + i] = row["n_train"]
        self.n[0] = texts
        p = np.where(np.arange(lm.IDS) < self.size, self.n + 0.5, 1e-6)
        p /= p.sum()
        self.log_p = np.log10(p)

    def _chain(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability that the chain spells each word, given its first subword."""
        last = np.cumsum(sizes) - 1
        each = np.zeros(len(flat))
        each[1:] = self.step[flat[:-1], flat[1:]]
        each[last - sizes + 1] = 0
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[last + 1] - sums[last + 1 - sizes] + self.stop[flat[last]]

    def words(self, words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: id, number of subwords, log10 probability in its id if no training text holds it, and words in its id."""
        return self.of(*vocabulary.ids(words))

    def of(self, found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words() for words whose subwords are known."""
        ids = self.start[found[np.cumsum(sizes) - sizes]]
        n = self.n[ids]
        freed = np.where(n > 0, DISCOUNT * self.types[ids] / np.maximum(n, 1), 1.0)
        spelled = self._chain(found, sizes) + np.log10(np.maximum(freed, 1e-12)) - np.log10(np.maximum(self.left[ids], 1e-6))
        return ids, sizes, spelled, n


class Head:
    """The most frequent words: sorted hashes, training counts, ids, subwords, log10 probabilities in their ids."""

    def __init__(self, rows: list, lexicon: Lexicon):
        rows = sorted(rows, key=lambda r: np.int64(r["hash"]).astype(np.uint64))
        words = [bytes(r["word"]) for r in rows]
        self.hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        first = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44))
        first[-1] = len(rows)  # the shift has carried the last limit out
        self.slots, self.crowd = np.minimum(first[:-1], max(len(rows) - 1, 0)).astype(np.int32), int(np.diff(first).max())
        self.counts = np.array([r["n_train"] for r in rows], np.int64)
        found, sizes = Vocabulary(lexicon.chosen).ids(words)
        self.subwords, self.begin = found.astype("<u2"), np.cumsum(sizes) - sizes
        self.ids, self.sizes, spelled, n = lexicon.of(found, sizes)
        self.inside = np.where(self.counts > 0, np.log10(np.maximum(self.counts - DISCOUNT, 0) / np.maximum(n, 1) + 10.0**spelled + 1e-300), spelled)
        for i, word in enumerate(words):
            if word in lexicon.own:
                self.ids[i], self.inside[i] = lexicon.own[word], 0.0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not among them."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = self.slots[hashes >> np.uint64(44)]  # the first one with the same highest bits
        found = np.where(self.hashes[at] == hashes, at, -1)
        for step in range(1, self.crowd):
            left = np.flatnonzero(found < 0)
            at_left = np.minimum(at[left] + step, len(self.hashes) - 1)
            same = self.hashes[at_left] == hashes[left]
            found[left[same]] = at_left[same]
        return found


ENCODED = "doc_id long, held_out boolean, round int, n_words long, n_subwords long, head_known long, head_base double, n_rare long, inside double, ids binary, subwords binary, rare array<struct<hash:long,n:long,spelled:double,in_id:long>>"


def _encoded(held):
    """Each text's word ids and subwords, the sums over its head words, and its distinct rarer words."""

    def run(batches):
        m = held.value
        head, lexicon, denominator = m["head"], m["lexicon"], m["train_tokens"] + ADD * (m["distinct"] + 1)
        vocabulary = Vocabulary(lexicon.chosen)
        base = np.log10((head.counts + ADD) / denominator)
        for part in c.text_chunks(batches):
            data, starts, ends, places, hashes = _words(part)
            where = head.find(hashes)
            rare = np.flatnonzero(where < 0)
            unique, first, which = np.unique(hashes[rare], return_index=True, return_inverse=True)
            where[rare] = len(base) + which  # the head words, then the rarer ones of this chunk
            found, sizes = vocabulary.ids([data[starts[i] : ends[i]].tobytes() for i in rare[first]])
            ids, sizes, spelled, in_id = lexicon.of(found, sizes)
            none = np.zeros(len(unique))
            pairs = {"id": (head.ids, ids), "size": (head.sizes, sizes), "known": ((head.counts > 0).astype(np.int64), none.astype(np.int64)), "base": (base, none), "inside": (head.inside, spelled)}
            of = {k: np.concatenate(x)[where] for k, x in pairs.items()}
            per = lambda y: np.diff(np.concatenate([[0], np.cumsum(y)])[places])
            texts = of["id"].astype("<u2").tobytes()
            sums = np.concatenate([[0], np.cumsum(of["size"])])
            pool, begin = np.concatenate([head.subwords, found.astype("<u2")]), np.concatenate([head.begin, len(head.subwords) + np.cumsum(sizes) - sizes])
            flat = pool[np.repeat(begin[where] - sums[:-1], of["size"]) + np.arange(sums[-1])].tobytes()
            cut = (2 * sums[places]).tolist()
            owner = np.repeat(np.arange(part.num_rows), np.diff(places))[rare]
            key, n = np.unique(owner * np.int64(len(unique) + 1) + which, return_counts=True)
            cuts = np.searchsorted(key // np.int64(len(unique) + 1), np.arange(part.num_rows + 1))
            key %= np.int64(len(unique) + 1)
            one = pa.StructArray.from_arrays([pa.array(unique[key].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(spelled[key]), pa.array(in_id[key])], names=["hash", "n", "spelled", "in_id"])
            columns = {k: part.column(k) for k in ("doc_id", "held_out", "round")}
            columns |= {"n_words": pa.array(np.diff(places).astype(np.int64)), "n_subwords": pa.array(per(of["size"]) + 1), "head_known": pa.array(per(of["known"])), "head_base": pa.array(per(of["base"])), "n_rare": pa.array(per(where >= len(base)))}
            columns |= {"inside": pa.array(per(of["inside"])), "ids": pa.array([texts[2 * a : 2 * b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.binary())}
            columns |= {"subwords": pa.array([flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "rare": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), one)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


SCORED = "_row long, doc_id long, held_out boolean, n_words long, n_subwords long, head_known long, head_base double, n_rare long, score double, counted double"


def _scores(held):
    """log10 probability of each text by attention, and by counts of words as if no training text held its rarer ones."""

    def run(batches):
        c.one_blas_thread()
        weights, prior, log_p = held.value
        for part in c.text_chunks(batches, "subwords", PART):
            x, goal, continues, of = lm.blocks([np.frombuffer(raw, "<u2") for raw in part.column("subwords").to_pylist()], 0)
            score = np.zeros(part.num_rows)
            for at in range(0, len(x), ROWS):  # a run of rows, with the row before it as context
                lead = int(at > 0 and continues[at])
                rows = slice(at - lead, at + ROWS)
                follows = continues[rows].copy()
                follows[0] = False
                found = lm.log_probs(weights, prior, x[rows], goal[rows], follows)[lead:].sum(axis=1)
                score += np.bincount(of[at : at + ROWS], found, minlength=part.num_rows)
            counted = part.column("inside").to_numpy() + [log_p[np.frombuffer(raw, "<u2")].sum() + log_p[0] for raw in part.column("ids").to_pylist()]
            yield part.drop_columns(["ids", "subwords", "inside"]).append_column("score", pa.array(score / np.log(10))).append_column("counted", pa.array(counted))

    return run


def _size_bin():
    """Counts in steps of an eighth of a doubling: a few hundred bins whatever the corpus."""
    return F.floor(F.log2(F.col("n_all").cast("double")) * 8).cast("int")


def head_bin(words: DataFrame, most: int = HEAD) -> int | None:
    """The lowest bin of counts whose words, with all more frequent ones, are `most` at most; None if even the top bin holds more."""
    bins = sorted((r["b"], r["n"]) for r in words.filter("hash <> 0").groupBy(_size_bin().alias("b")).agg(F.count("*").alias("n")).collect())
    total, lowest = 0, None
    for b, n in reversed(bins):
        total += n
        if total > most:
            break
        lowest = b
    return lowest


STATE = "state binary, steps double, subwords long"


def _trained_parts(held, round_: int):
    """The state of one task after its texts of a round, PART subwords at a time, and how many these are, ends counted."""

    def run(batches):
        c.one_blas_thread()
        prior, state, steps = held.value
        total, texts, n = 0, [], 0

        def step():
            nonlocal state, steps
            state, steps, _ = lm.train(texts, prior, 0, state, steps, (round_ / ROUNDS, (round_ + 1) / ROUNDS), seed=round_)

        for batch in batches:
            for raw in batch.column("subwords").to_pylist():
                texts.append(np.frombuffer(raw, "<u2"))
                n += len(texts[-1]) + 1
                if n >= PART:
                    step()
                    total, texts, n = total + n, [], 0
        if texts:
            step()
            total += n
        if total:
            yield pa.RecordBatch.from_pydict({"state": pa.array([state.astype("<f4").tobytes()], pa.binary()), "steps": pa.array([float(steps)]), "subwords": pa.array([total], pa.int64())})

    return run


def _averaged(df: pd.DataFrame) -> pd.DataFrame:
    """States averaged by their subwords; averages can be averaged again."""
    n = df["subwords"].sum()
    total = sum(np.frombuffer(x, "<f4").astype(float) * (k / n) for x, k in zip(df["state"], df["subwords"], strict=True))
    return pd.DataFrame({"state": [total.astype("<f4").tobytes()], "steps": [(df["steps"] * df["subwords"]).sum() / n], "subwords": [n]})


def _trained(encoded: DataFrame, prior: dict) -> dict:
    """The attention weights after all rounds; one state a round reaches the driver."""
    spark = encoded.sparkSession
    state, steps = lm.begin(), 0.0
    for r in range(ROUNDS):
        held = spark.sparkContext.broadcast((prior, state, steps))
        parts = encoded.filter(~F.col("held_out") & (F.col("round") == r)).select("subwords").mapInArrow(_trained_parts(held, r), STATE)
        few = parts.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("_group").applyInPandas(lambda df: _averaged(df.drop(columns="_group")), STATE)
        found = few.groupBy().applyInPandas(_averaged, STATE).collect()  # GROUPS states at most in its one task
        if found:
            state, steps = np.frombuffer(found[0]["state"], "<f4").reshape(state.shape).astype(np.float32), found[0]["steps"]
        held.unpersist()
    return lm.unpacked(state[0])


def fit(words: DataFrame) -> dict:
    """Subwords, ids, counts, chain and prior; what reaches the driver is bounded by HEAD and lm.IDS."""
    spark = words.sparkSession
    total = words.agg(F.sum("n_train").alias("n"), F.sum(F.when(F.col("n_train") > 0, 1).otherwise(0)).alias("v"), F.sum(F.when(F.col("hash") == 0, F.col("n_train"))).alias("texts")).first()
    n, distinct, texts = (int(total[k] or 0) for k in ("n", "v", "texts"))
    plain = words.filter("hash <> 0")
    ranked = plain.filter("n_train > 0").select("word", "n_train").mapInArrow(_piece_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(lm.IDS)
    chosen = [r["id"] for r in ranked.collect()]
    shared = spark.sparkContext.broadcast(chosen)
    pairs = np.zeros((2 * lm.IDS + 1, lm.IDS), np.int64)
    counted = plain.filter("n_train > 0").select("word", "n_train").mapInArrow(_pair_counts(shared), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for r in counted.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("x")).toLocalIterator():  # 2 * lm.IDS + 1 rows of lm.IDS entries at most
        pairs[r["a"], [x["b"] for x in r["x"]]] = [x["n"] for x in r["x"]]
    lowest = head_bin(words)
    rows = [] if lowest is None else plain.filter(_size_bin() >= lowest).select("hash", "word", "n_train").collect()
    lexicon = Lexicon(pairs[: lm.IDS + 1], chosen, sorted(rows, key=lambda r: (-r["n_train"], r["hash"]))[: lm.IDS], texts)
    prior = prior_of(pairs[lm.IDS + 1 :], Vocabulary(chosen), texts)
    return {"lexicon": lexicon, "head": Head(rows, lexicon), "prior": prior, "train_tokens": n, "distinct": distinct}


def score_documents(docs: DataFrame, folds: int = FOLDS, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_subwords of every row."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (c.crc_bucket(doc_id, folds) == held_fold).alias("held_out"))
    words = c.written(word_table(rows), "lm-words")
    model = fit(words)
    prior = model.pop("prior")
    held = spark.sparkContext.broadcast(model)  # HEAD words and their subwords, tables of lm.IDS ids
    dealt = rows.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int"))
    encoded = c.written(dealt.mapInArrow(_encoded(held), ENCODED).withColumn("_row", F.monotonically_increasing_id()), "lm-encoded")
    weights = spark.sparkContext.broadcast((_trained(encoded, prior) if model["train_tokens"] else lm.fresh(), prior, model["lexicon"].log_p))
    scored = c.written(encoded.select("_row", "doc_id", "held_out", "n_words", "n_subwords", "head_known", "head_base", "n_rare", "inside", "ids", "subwords").mapInArrow(_scores(weights), SCORED), "lm-scored")
    rare = encoded.select("_row", F.inline("rare")).join(words.filter("hash <> 0 and n_train > 0").select("hash", "n_train"), "hash")
    in_id = (F.col("n_train") - DISCOUNT) / F.col("in_id")
    rare = rare.groupBy("_row").agg(
        F.sum("n").alias("r_known"), F.sum(F.col("n") * F.log10(F.col("n_train") + ADD)).alias("r_log"), F.sum(F.col("n") * (F.log10(in_id + F.pow(F.lit(10.0), F.col("spelled"))) - F.col("spelled"))).alias("r_inside")
    )
    log_d = float(np.log10(model["train_tokens"] + ADD * (model["distinct"] + 1)))
    ends = int(words.filter("hash = 0").agg(F.sum("n_train")).first()[0] or 0)
    known = F.col("head_known") + F.coalesce("r_known", F.lit(0))
    unknown = F.col("n_rare") - F.coalesce("r_known", F.lit(0))
    base = F.col("head_base") + F.coalesce("r_log", F.lit(0.0)) + unknown * float(np.log10(ADD)) - F.col("n_rare") * log_d + float(np.log10(ends + ADD) - log_d)
    counted = F.col("counted") + F.coalesce("r_inside", F.lit(0.0))
    more, less = F.greatest("score", counted), F.least("score", counted)
    score = more + F.log10(0.5 + 0.5 * F.pow(F.lit(10.0), less - more))  # the mean of both probabilities
    out = scored.join(rare, "_row", "left")
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (known + int(ends > 0)).alias("n_known"), F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), "n_subwords")
