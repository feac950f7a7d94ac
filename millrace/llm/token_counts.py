"""Token counts through a digest cache.

A count is stored under two digests: of the normalised content (null becomes the empty text; nothing else is changed,
since any other change could change the count) and of the tokenizer's file. Counting joins the texts to the stored
counts, encodes each distinct missing text once, appends those counts to the cache and joins again.

The cache is a Parquet folder that only grows; a run that dies leaves whole files or none, and a digest that two runs
appended counts once. Nulls: a null text counts as empty (0 tokens), a null doc_id stays null. Repeated rows each get
their row. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import tokenizers_public as tk

CACHE = "content binary, tokenizer string, n_tokens long"
#: A document with more tokens than this is marked over_limit.
LIMIT = 512


def _encode(name: str, version: str):
    def run(batches):
        for part in c.text_chunks(batches):
            texts = part.column("text").fill_null("").to_pylist()
            if name.endswith(".json"):
                counts = [len(x.ids) for x in tk.json_tokenizer(tk.path(name)).encode_batch_fast(texts, add_special_tokens=False)]
            else:
                counts = [len(x) for x in tk.piece_tokenizer(tk.path(name)).encode(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array([version] * len(texts)), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return run


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cached counts of one tokenizer, one row a content; an absent cache is empty."""
    try:
        df = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], CACHE)
    return df.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; new counts are appended to the cache folder."""
    spark, version = docs.sparkSession, tk.version(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("content", c.digest(F.col("text")))
    keys = c.written(texts.groupBy("content").agg(F.count("*").alias("n")), "token-contents")
    # copies go before the texts are dealt: each task sends a text once
    misses = texts.select("content", "text").dropDuplicates(["content"]).join(stored(spark, cache, version), "content", "left_anti")
    misses.mapInArrow(_encode(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    # contents that many rows share are joined by broadcast: their rows stay where they are
    counts = c.written(keys.join(stored(spark, cache, version), "content"), "token-counts")
    rows = texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = c.with_key(rows, counts, "content", keys.agg(F.sum("n")).first()[0] or 0)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
