"""The registered queries of the subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import fertility, language_id, lm_scoring, mixing, near_dup, packing, paragraph_dedup, quality_model, token_counts, topk


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the synthetic documents have no URL: their source stands for the host, the language section for the path
    return quality_model.classify(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.score_documents(c.documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(c.documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(c.documents(spark, sf_dir))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.spans(c.documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each run: what the figures show is the counting of every distinct text
    return token_counts.count_tokens(c.documents(spark, sf_dir), c.scratch_path(spark, "token-cache"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(c.documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(c.documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(c.documents(spark, sf_dir))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), topk.quantised(F.col("embedding")).alias("vector")).dropna()
    return topk.search(table.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), table)


QUERIES = {f.__name__: f for f in (op1_quality, op2_fertility, op3_lm_scoring, op4_mixing, op5_paragraph_dedup, op6_token_counts, op7_near_dup, op8_language_id, op9_packing, op10_topk)}

ORACLE_SQL = {
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
