"""The training-data queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm import bm25_wand, bwt_repeats, divergence, hard_negatives, kneser_ney, length_buckets, minhash_forest, pii, prefix_bpe, rans, token_counts, url_rules, whitening
from solstice.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op4_length_buckets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return length_buckets.pack(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_url_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge_urls(table(spark, folder, "pages"), labels)


@query("op10_pii_spans")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pii.counts(pii.find_pii(table(spark, folder, "documents")))


@query("op1_divergence")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents"))


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")


@query("op5_kneser_ney")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.judge(table(spark, folder, "documents"), trusted_ids(spark, folder)).drop("hash")


@query("op2_minhash_forest")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, folder, "documents")).drop("key")


@query("op7_bm25_wand")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_wand.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_rans_tokens")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return rans.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_bwt_repeats")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return bwt_repeats.cut_repeats(table(spark, folder, "documents"))


@query("op11_qdwh_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_prefix_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.digests(prefix_bpe.decode(prefix_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN), path))


@query(
    "op13_one_bit_negatives",
    """
    WITH base AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)))
    ), scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * r.x[i])) AS BIGINT) AS score
        FROM base a JOIN base r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
    ), positives AS (
        SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
        n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
    QUALIFY rank <= 5
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = hard_negatives.build_index(table(spark, folder, "embeddings"), label)
    return hard_negatives.mine(index, index.filter("vec_id % 100 = 0"))
