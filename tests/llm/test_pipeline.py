"""The corpus pipeline, stage by stage."""

from collections import Counter

import corpus_pipeline
from millrace.llm import common as c
from millrace.llm import fertility, mixing, packing

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = c.documents(spark, FOLDER)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(c.written(stage(spark, kept[-1], FOLDER), f"test-{name}"))
        assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes, name
    rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in kept]
    ids = [{d for d, _ in x} for x in rows]
    assert ids[1] == {r["doc_id"] for r in fertility.score_documents(docs).filter("kept").collect()}
    assert ids[4] <= ids[3] <= ids[2] < ids[1] < ids[0]
    texts = [t for _, t in rows[2]]
    assert len(texts) == len(set(texts))  # no copy stays
    before = dict(rows[2])
    assert any(len(t) < len(before[d]) for d, t in rows[3]) and all(len(t) <= len(before[d]) for d, t in rows[3])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(kept[3]).collect() if r["taken"]}
    assert Counter(d for d, _ in rows[4]) == taken
    pieces = packing.pack(kept[4]).collect()
    assert {r["doc_id"] for r in pieces} == ids[4]
    assert max(Counter({s: sum(r["length"] for r in pieces if r["sequence_id"] == s) for s in {r["sequence_id"] for r in pieces}}).values()) <= packing.SIZE
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(r["doc_id"] for r in pieces)


def test_stages_of_an_empty_table(spark):
    docs = c.documents(spark, FOLDER).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
