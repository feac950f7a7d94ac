"""Quality rules by tokeniser fertility.

For every text: characters per token (byte-level BPE), the share of byte-fallback pieces (piece BPE), and the entropy of
its tokens, besides plain counts of words, symbols, repeated lines and repeated 8-word windows. Rejection bands for the
three measures are fitted per language over all texts (median and median deviation), and drawn toward those of the text's
script as if the script had PRIOR texts in it, so a sparse language, or none, takes the bands of its script and no number
of texts is a switch. The band of byte fallback has no lower end: a text that needs fewer byte pieces than its language
is well fitted.

Nulls: a null text counts as empty, has no word and is rejected; a null lang takes the script's band; a null doc_id is
kept as it is. Repeated rows each get their own row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import tokenizers_public as tk

#: What counts as a symbol, the words of a repeat window, the least words and the greatest share of repeats.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Half-widths of the bands in median deviations; the least deviation that counts, as a share of the median and as such (texts that need no byte fallback have a median and a deviation of 0).
BANDED = {"chars_per_token": (6.0, 0.02, 0.0), "fallback_share": (8.0, 0.0, 0.01), "entropy": (8.0, 0.02, 0.0)}
#: Texts that the bands of a script count as beside those of a language.
PRIOR = 50.0
#: A text of n tokens has log2(n) bits at most: no text is rejected for fewer bits if it has this share of them.
RICH = 0.7

MEASURES = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy double, digest binary"


def base_counts(data: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of each text of a chunk; windows and lines are compared by 64-bit hashes within a text."""
    starts, ends, places = c.word_spans(data, limits)
    words = c.span_hashes(data, starts, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    chars = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    owner = np.repeat(np.arange(len(limits) - 1), np.diff(places))
    salt = c.mix(np.arange(1, len(limits), dtype=np.uint64))

    covered = np.zeros(len(words) + 1, np.int64)
    n = len(words) - WINDOW + 1
    if n > 0:
        whole = np.flatnonzero(np.arange(n) + WINDOW <= places[1:][owner[:n]])
        rolled = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        twice, _ = c.repeated(c.mix(rolled[whole]) ^ salt[owner[whole]])
        at = whole[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    repeats = np.cumsum(covered[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([limits[:-1], breaks + 1]))
    cuts = cuts[cuts < len(data)]
    tails = np.concatenate([cuts[1:], [len(data)]]) if len(cuts) else cuts
    if len(cuts):
        tails = tails - (data[tails - 1] == 10)
        full = np.searchsorted(starts, tails) > np.searchsorted(starts, cuts)
        cuts, tails = cuts[full], tails[full]
    of = np.searchsorted(limits, cuts, "right") - 1
    _, later = c.repeated(c.span_hashes(data, cuts, tails) ^ salt[of]) if len(cuts) else (None, np.zeros(0, bool))
    return {
        "n_words": np.diff(places),
        "word_chars": c.per_text(chars, limits),
        "n_symbols": c.per_text(SYMBOLS[data], limits),
        "n_dup_lines": np.bincount(of[later], minlength=len(limits) - 1),
        "n_repeat_words": c.per_text(repeats, places),
    }


#: First code points of the ranges of letters and the script of each; "" has no letters (signs, digits, marks).
_RANGES = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, "other"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"), (0x780, "other"), (0x8A0, "arabic"), (0x900, "devanagari"),
    (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"),
    (0x2E00, ""), (0x2E80, "han"), (0x2FE0, ""), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""),
    (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""),
    (0x10000, "other"), (0x1F000, ""), (0x20000, "han"), (0x40000, "other"),
]
_FIRST = np.array([x for x, _ in _RANGES])
_SCRIPTS = np.array(sorted({x for _, x in _RANGES}))
_OF_RANGE = np.searchsorted(_SCRIPTS, [x for _, x in _RANGES])


def _script(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The script of at least 0.8 of a text's letters (latin where less than 0.2 are of others, or there are none), else mixed; han with kana is japanese."""
    n = len(limits) - 1
    counts = np.zeros((n, len(_SCRIPTS)), np.int64)
    latin, none, han, kana = np.searchsorted(_SCRIPTS, ["latin", "", "han", "kana"])
    counts[:, latin] = c.per_text(((data | 32) >= 97) & ((data | 32) <= 122), limits)
    at = np.flatnonzero(data >= 0xC2)
    lead, padded = data[at].astype(np.int64), np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    one, two, three = (padded[at + j] for j in (1, 2, 3))
    point = np.where(lead < 0xE0, (lead & 31) << 6 | one, np.where(lead < 0xF0, (lead & 15) << 12 | one << 6 | two, (lead & 7) << 18 | one << 12 | two << 6 | three))
    of = _OF_RANGE[np.searchsorted(_FIRST, point, "right") - 1]
    owner = np.searchsorted(limits, at, "right") - 1
    counts += np.bincount(owner * len(_SCRIPTS) + of, minlength=counts.size).reshape(counts.shape)
    counts[:, none] = 0
    total = np.maximum(counts.sum(axis=1), 1)
    japanese = 10 * counts[:, kana] >= np.maximum(counts[:, han] + counts[:, kana], 1)
    counts[:, han] += counts[:, kana]
    counts[:, kana] = 0
    top = counts.argmax(axis=1)
    names = np.where((top == han) & japanese, "japanese", _SCRIPTS[top])
    found = np.where(counts[np.arange(n), top] >= 0.8 * total, names, "mixed")
    return np.where(counts[:, latin] > 0.8 * total, "latin", np.where(counts.sum(axis=1) == 0, "latin", found))


def _measure(batches):
    pieces = tk.piece_tokenizer(tk.path("piece_bpe_32k.model"))
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    schema = None
    for part in c.text_chunks(batches):
        data, limits = c.buffers(part.column("text"))
        found = base_counts(data, limits)
        texts = part.column("text").fill_null("").to_pylist()
        ids = [np.asarray(x, np.int64) for x in tk.byte_bpe_ids(texts)]
        n_ids = np.array([len(x) for x in ids])
        owner = np.repeat(np.arange(len(ids)), n_ids)
        keyed, counts = np.unique(owner << 20 | np.concatenate([*ids, np.zeros(0, np.int64)]), return_counts=True)
        of = keyed >> 20
        share = counts / np.maximum(n_ids[of], 1)
        entropy = np.bincount(of, -share * np.log2(share), minlength=len(ids))
        byte_share = [is_byte[x].mean() if len(x) else 0.0 for x in map(np.asarray, pieces.encode(texts, num_threads=1))]
        n_chars = c.per_text((data & 0xC0) != 0x80, limits)
        columns = [part.column("doc_id"), part.column("lang"), pa.array(_script(data, limits).tolist(), pa.string())]
        columns += [pa.array(found[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        columns += [pa.array(n_ids.astype(np.int64)), pa.array(n_chars / np.maximum(n_ids, 1)), pa.array(np.asarray(byte_share, float)), pa.array(entropy.astype(float)), part.column("digest")]
        names = [x.split()[0] for x in MEASURES.split(", ")]
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        schema = schema or batch.schema
        yield batch


def measures(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """One row a document with its counts and its three measures, and with digest where one is wanted."""
    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), digest.alias("digest")).mapInArrow(_measure, MEASURES)


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the row of their key; table is written and broadcast if it is small, else only its frequent keys are."""
    if c.small(table, key):
        return rows.join(F.broadcast(table), key)
    return c.with_key(rows, table, key, table.agg(F.sum("n")).first()[0] or 0)


def _bands(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Number of rows, median and median deviation of the three measures for each value of key, over all rows."""
    mid = df.groupBy(key).agg(F.count("*").alias("n"), *(F.percentile_approx(k, 0.5, 10000).alias(f"{prefix}m_{k}") for k in BANDED))
    mid = c.written(mid, f"fertility-{key}-middle")
    away = _joined(df, mid, key).groupBy(key, "n", *(f"{prefix}m_{k}" for k in BANDED))
    return c.written(away.agg(*(F.percentile_approx(F.abs(F.col(k) - F.col(f"{prefix}m_{k}")), 0.5, 10000).alias(f"{prefix}d_{k}") for k in BANDED)), f"fertility-{key}-bands")


def judged(measured: DataFrame, *more: str) -> DataFrame:
    """Adds base_failed, fertile (inside all bands) and kept, and carries the columns named in more; measured must be a written table, it is read five times."""
    # a key that is never null; a text of no language has none of its own
    rows = measured.withColumn("_lang", F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("l"), F.col("lang"))))
    lang, script = _bands(rows, "_lang", "_l"), _bands(rows, "script", "_s")
    out = _joined(rows, lang, "_lang").withColumn("_own", F.when(F.col("lang").isNull(), 0.0).otherwise(F.col("n"))).drop("n")
    out = _joined(out, script, "script")
    inside = F.lit(True)
    for k, (width, share, least) in BANDED.items():
        mid, dev = ((F.col("_own") * F.col(f"_l{x}_{k}") + PRIOR * F.col(f"_s{x}_{k}")) / (F.col("_own") + PRIOR) for x in "md")
        reach = width * F.greatest(dev, share * mid, F.lit(least))
        low = {"chars_per_token": mid - reach, "fallback_share": F.lit(0.0), "entropy": F.least(mid - reach, RICH * F.log2(F.greatest(F.col("n_tokens"), F.lit(2))))}[k]
        inside = inside & F.col(k).between(low, mid + reach)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "fertile": inside})
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fertile", "n_tokens", "chars_per_token", "fallback_share", "entropy")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("fertile")).select(*names, *more)


def score_documents(docs: DataFrame) -> DataFrame:
    return judged(c.written(measures(docs), "fertility"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns. Rows are matched by doc_id, text and lang."""
    kept = judged(c.written(measures(docs, c.digest(F.col("text").cast("string"))), "fertility"), "lang", "digest").filter("kept")
    kept = kept.select(F.col("doc_id").alias("_mr_id"), F.col("lang").alias("_mr_lang"), F.col("digest").alias("_mr_digest")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_mr_id"]) & docs["lang"].cast("string").eqNullSafe(kept["_mr_lang"])
    return docs.join(kept, same & (c.digest(docs["text"].cast("string")) == kept["_mr_digest"]), "left_semi")
