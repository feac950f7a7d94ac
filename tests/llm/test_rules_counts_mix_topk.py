"""Fertility rules, token counts, mixing and top-k against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common as c
from millrace.llm import fertility, mixing, queries, token_counts, topk
from millrace.llm import tokenizers_public as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string"


def rows(*texts, **more):
    return [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(texts)]


HARD = [None, "", " \n\t ", "a", "é" * 3000, "w " * 9000, "one two three four five six seven eight nine ten\n" * 3, "x\n\nx\n x\nx", " a b # | c", "日本語 テキスト です" * 9, "same text here", "same text here", "<|endoftext|> is text"]


def base(text):
    words = WORD.findall(text or "")
    marked, seen = [False] * len(words), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                marked[i : i + 8] = [True] * 8
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, sum(marked)


@pytest.mark.parametrize("folder", ["hard", "/root/testdata/sf0.001"])
def test_fertility_base(spark, folder):
    docs = spark.createDataFrame(rows(*HARD) + [(None, "z", None, None, 1, 1, "x")], DOCS) if folder == "hard" else c.documents(spark, folder)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = fertility.score_documents(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if r["n_tokens"]:
            assert r["chars_per_token"] == pytest.approx(len(texts[r["doc_id"]]) / r["n_tokens"])


def test_fertility_rejects_what_the_vocabulary_does_not_fit(spark):
    rng = np.random.default_rng(1)
    common = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split()
    clean = [" ".join(rng.choice(common, 80)) for _ in range(60)]
    junk = " ".join("".join(map(chr, rng.integers(0x10000, 0x10FFFF, 6))) for _ in range(60))
    got = {r["doc_id"]: r["kept"] for r in fertility.score_documents(spark.createDataFrame(rows(*clean, "zq" * 10 + " " + " ".join("q%dzx9j7" % i for i in range(60)), junk), DOCS)).collect()}
    assert sum(got[i] for i in range(60)) == 60
    assert not got[60] and not got[61]
    kept = fertility.keep_documents(spark.createDataFrame(rows(*clean, "short"), DOCS))
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")] and kept.count() == 60


def test_fertility_fits_byte_fallback_outside_latin(spark):
    rng = np.random.default_rng(4)
    def written(first, last, n=90):
        return " ".join("".join(map(chr, rng.integers(first, last, 5))) for _ in range(n))

    russian = [written(0x430, 0x450) for _ in range(60)]
    unknown = [" ".join("".join(map(chr, rng.integers(0x13A0, 0x13F0, 5))) for _ in range(90)) for _ in range(2)]
    docs = rows(*russian, unknown[0], written(0x430, 0x450), lang="ru") + [(100 + i, t, None, "s", 1, 7, "x") for i, t in enumerate([written(0x430, 0x450), unknown[1]])]
    got = {r["doc_id"]: r for r in fertility.score_documents(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[60]["fallback_share"] > 0.5 > got[61]["fallback_share"]
    assert not got[60]["fertile"] and all(got[i]["fertile"] for i in (*range(60), 61, 100))
    texts = [russian[0], written(0x4E00, 0x5000), written(0xE01, 0xE2F), written(0x5D0, 0x5EA), written(0x3041, 0x3090), "plain words", "", "12 34", "a b " * 9 + written(0x430, 0x450, 2)]
    assert list(fertility._script(*c.buffers(pa.array(texts)))) == ["cyrillic", "han", "thai", "hebrew", "japanese", "latin", "latin", "latin", "mixed"]


def brute_fertile(rows):
    """Whether each row (lang, script, n_tokens and the measures) lies in all bands, with exact medians."""
    def bands(key):
        groups = {}
        for r in rows:
            groups.setdefault(r[key], []).append(r)
        out = {}
        for g, held in groups.items():
            lower = lambda x: sorted(x)[(len(x) - 1) // 2]
            mid = {k: lower([r[k] for r in held]) for k in fertility.BANDED}
            out[g] = {k: (len(held), mid[k], lower([abs(r[k] - mid[k]) for r in held])) for k in mid}
        return out

    lang, script = bands("lang"), bands("script")
    out = []
    for r in rows:
        fine = True
        for k, (width, share, least) in fertility.BANDED.items():
            n, m1, d1 = lang[r["lang"]][k]
            n = 0 if r["lang"] is None else n
            _, m2, d2 = script[r["script"]][k]
            mid, dev = (n * m1 + 50 * m2) / (n + 50), (n * d1 + 50 * d2) / (n + 50)
            reach = width * max(dev, share * mid, least)
            low = {"chars_per_token": mid - reach, "fallback_share": 0, "entropy": min(mid - reach, 0.7 * np.log2(max(r["n_tokens"], 2)))}[k]
            fine = fine and low <= r[k] <= mid + reach
        out.append(fine)
    return out


def test_fertility_bands_against_brute_force(spark):
    docs = c.documents(spark, "/root/testdata/sf0.01")
    measured = c.written(fertility.measures(docs), "m").collect()
    want = dict(zip([r["doc_id"] for r in measured], brute_fertile(measured), strict=True))
    got = fertility.score_documents(docs).collect()
    assert {r["doc_id"]: r["fertile"] for r in got} == want
    decided = sum(not r["fertile"] and not r["base_failed"] for r in got)
    assert 5 <= decided <= 50  # the bands decide beside the plain rules, on a few texts in a hundred
    assert all(r["kept"] == (r["fertile"] and not r["base_failed"]) for r in got)


def test_verdicts_keep_to_their_own_text(spark):
    rng = np.random.default_rng(7)
    common = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split()
    clean = [" ".join(rng.choice(common, 80)) for _ in range(60)]
    odd = [(i, t, "en", "s", 1, 7, "x") for i in (None, 3) for t in (clean[0], "too short", None)]
    kept = fertility.keep_documents(spark.createDataFrame(rows(*clean) + odd, DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept) == sorted([*((False, i, t) for i, t in enumerate(clean)), (True, 0, clean[0]), (False, 3, clean[0])])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert fertility.score_documents(none).count() == fertility.keep_documents(none).count() == mixing.mix(none).count() == 0
    assert token_counts.count_tokens(none, c.scratch_path(spark, "t")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk.search(vectors.withColumnRenamed("vec_id", "query_id"), vectors).count() == 0


def test_plain_texts_have_the_same_ids_in_both_libraries():
    rng = np.random.default_rng(3)
    plain = "".join(chr(i) for i in range(0x3000) if tk.PLAIN.fullmatch(chr(i)))
    texts = ["".join(rng.choice(list(plain), 40)) for _ in range(3000)] + [f"a{x}b {x} {x}{x}c\n{x}" for x in plain] + [f"x'{w} {w}'S  \n\n {w} 12{w}3" for w in ("s", "ll", "re", "É", "ß")]
    exact = tk.json_tokenizer(tk.path("byte_bpe_50k.json"))
    assert all(tk.PLAIN.fullmatch(t) for t in texts)
    assert tk.byte_bpe_ids(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert tk.byte_bpe_ids(HARD[1:]) == [exact.encode(t, add_special_tokens=False).ids for t in HARD[1:]]


def test_token_counts_and_cache(spark):
    cache = c.scratch_path(spark, "cache")
    docs = spark.createDataFrame(rows(*HARD), DOCS)
    exact = tk.json_tokenizer(tk.path("byte_bpe_50k.json"))
    for _ in range(2):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, cache).collect()}
        assert len(got) == len(HARD)
        for i, t in enumerate(HARD):
            n = len(exact.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
        assert spark.read.parquet(cache).count() == len({t or "" for t in HARD})  # each distinct text once, nothing on the second run
    more = token_counts.count_tokens(docs, cache, "piece_bpe_32k.model").collect()
    assert len(more) == len(HARD) and spark.read.parquet(cache).count() == 2 * len({t or "" for t in HARD})


def targets(sizes, weights=(1, 2, 3), most=3):
    """Brute force of the shares."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight, cap = {s: weights[i % 3] for i, (s, _) in enumerate(order)}, {s: float(most * n) for s, n in order}
    left, open_, out = float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > cap[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets_by_hand(spark):
    assert targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 50.0, "b": 100.0, "c": 150.0}
    cases = [[("a", 100), ("b", 100), ("c", 100)], [(None, 1000), ("b", 10), ("a", 10)], [], [("a", 0)], [(f"s{i:03}é" if i % 2 else f"S{i}", (i * 37) % 101) for i in range(200)] + [(None, 9000)]]
    for case in cases:
        rows = spark.createDataFrame([("k" if s is None else "s" + s, s, n, 1) for s, n in case], "_source string, source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows.repartition(5)).collect()}
        assert got == pytest.approx(targets(case)), case


def test_mix(spark):
    docs = c.documents(spark, "/root/testdata/sf0.01").unionByName(spark.createDataFrame([(None, None, None, None, 1), (-5, "a b", None, None, 1), (-5, "a b", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    sizes = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((d or 0, n) for d, n, _ in sizes)
    total = {}
    for _, n, s in sizes:
        total[s] = total.get(s, 0) + n
    wanted, taken, source = targets(list(total.items())), {}, {d: s for d, _, s in sizes}
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(wanted[s]) and r["source_size"] == total[s]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    most = max(n for _, n, _ in sizes)
    assert all(abs(taken[s] - wanted[s]) <= most / 2 + 1 for s in total)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    sampled = mixing.sample_documents(docs)
    assert sampled.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in sampled.withColumn("w", mixing.n_words(F.col("text"))).groupBy("doc_id").agg(F.sum("w").alias("n")).collect() if r["n"]} == {r["doc_id"]: sum(x["taken"] for x in got if x["doc_id"] == r["doc_id"]) for r in got if r["taken"]}


def test_mix_of_many_sources_and_clashing_names(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 7), "en", f"s{i % 40}" if i % 3 else "hot", 1, 2, "x", "n", 5, 6) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, _source string, epochs long, n long")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    sampled = sorted(map(str, mixing.sample_documents(docs).collect()))
    assert mixing.sample_documents(docs).columns == docs.columns
    monkeypatch.setattr(c, "SMALL_ROWS", 3)  # too many sources to broadcast
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want and sorted(map(str, mixing.sample_documents(docs).collect())) == sampled


def test_topk_in_rounds_blocks_and_unlike_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "ROUND", 6)
    rng = np.random.default_rng(15)
    vectors = [(i, v[: 3 + i % 4]) for i, v in enumerate(rng.integers(-50, 50, (300, 6)).tolist())] + [(400, [])]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>").repartition(3)
    got = topk.search(df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    full = {i: np.array(v + [0] * (6 - len(v)), int) for i, v in vectors}
    want = [(q, k + 1, i, -s) for q in full if q % 20 == 0 for k, (s, i) in enumerate(sorted((-int(full[q] @ x), i) for i, x in full.items() if i != q)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, v) for i, v in enumerate(rng.integers(-300, 300, (700, 8)).tolist())] + [(1000 + i, [9] * 8) for i in range(400)] + [(1000, [9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    got = topk.search(df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    held = {}
    for r in got:
        held.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in {q: v for q, v in vectors if q % 50 == 0}.items():
        best = sorted(((-int(np.dot(v, x)), i) for i, x in vectors if i != q))[:5]
        assert sorted(held[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = topk.search(df.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), df.filter("vec_id < 3"), 5)
    assert few.count() == 2


def test_topk_of_unnormalised_vectors_with_a_dense_group(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(-400, 400, (12, 8))
    vectors = [(i, v.tolist()) for i, v in enumerate(centres)] + [(100 + 1000 * g + i, v) for g, m in enumerate(centres) for i, v in enumerate((m + rng.integers(-2, 3, (500, 8))).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    got = topk.search(df.filter("vec_id < 12").withColumnRenamed("vec_id", "query_id"), df, 5).collect()
    ids, matrix = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    for q in range(12):
        scores = matrix @ centres[q]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, ids[j], scores[j]) for n, j in enumerate(best)]


def test_quantised(spark):
    values = [[0.5, -0.001], None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], []]
    df = spark.createDataFrame([(v,) for v in values], "e array<float>")
    assert [r[0] for r in df.select(topk.quantised(F.col("e"))).collect()] == [[128, -1], None, None, None, None, []]


def test_topk_query(spark):
    assert queries.op10_topk(spark, "/root/testdata/sf0.001").count() == 50
