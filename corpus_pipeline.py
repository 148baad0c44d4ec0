"""A training corpus from `documents`: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last keep the columns of documents. Verdicts name a row by id and text, null-safe: rows without an
id are judged like all others, and of several texts under one id each has a verdict of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm import bm25_wand, kneser_ney, length_buckets, minhash_forest, pii
from solstice.llm.common import staged, table
from solstice.llm.queries import trusted_ids


def keyed(docs: DataFrame) -> DataFrame:
    """With _row, a hash of id and text that tells nulls apart."""
    parts = [c for x in (docs["doc_id"].cast("long"), docs["text"].cast("string")) for c in (x.isNull(), x)]
    return docs.withColumn("_row", F.xxhash64(*parts))


def as_rows(docs: DataFrame) -> DataFrame:
    """Keys in the place of ids, so that an operator's verdicts name rows."""
    return docs.select(F.col("_row").alias("doc_id"), "text")


def without(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The keyed rows that `named` (_row) does not name, without their keys."""
    # One plan at every size: verdicts have no bound that would allow a broadcast.
    return docs.join(named.hint("merge"), "_row", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose perplexity lies above the threshold of their language."""
    judged = kneser_ney.judge(docs, trusted_ids(spark, folder))
    named = judged.filter(~F.col("kept")).select("doc_id", "lang", "hash").distinct().hint("merge")
    same = docs["doc_id"].cast("long").eqNullSafe(named["doc_id"]) & docs["lang"].cast("string").eqNullSafe(named["lang"]) & (F.xxhash64(docs["text"].cast("string")) == named["hash"])
    return docs.join(named, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the least id of each group; rows equal in id and text stay once."""
    rows = keyed(docs)
    found = staged(minhash_forest.near_duplicates(as_rows(rows)).select(F.col("doc_id").alias("_row"), "class_id", F.col("key").isNotNull().alias("words")), "duplicates")
    members = found.groupBy("_row").agg(F.first("class_id").alias("class_id"), F.first("words").alias("words"), F.count("*").alias("n"))
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("id")).dropDuplicates(["_row"])
    members = staged(members.join(ids.hint("merge"), "_row"), "duplicate-rows")
    # A row without an id is kept only where no row of its group has one.
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row"))["_row"].alias("first"))
    others = members.select("_row", "class_id").join(first.hint("merge"), "class_id").filter("_row <> first").select("_row")
    kept = without(rows, others)
    # Rows that stand several times are few; only those are compared. Without id and words there is nothing to compare.
    twice = members.filter("n > 1 and (words or id is not null)").select("_row")
    once = kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(twice, "_row", "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    rows = keyed(docs)
    found = bm25_wand.contaminated(as_rows(rows), table(spark, folder, "benchmark"))
    return without(rows, staged(found.select(F.col("doc_id").alias("_row")).distinct(), "contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace e-mail addresses, IP addresses, card and phone numbers, disguised ones too, by their kind."""
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Batches of sequences in optimal length buckets."""
    return length_buckets.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Near duplicates, perplexities and dynamic programming have no SQL form; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
