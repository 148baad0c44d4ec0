"""Packing into optimal length buckets (operator 4).

Sequences (documents, those over `max_len` cut into pieces of `max_len`) are counted by length. The histogram has at
most `max_len / multiple` bins, so it may go to the driver, where dynamic programming picks the bucket lengths that
give the least padding over the whole corpus. Inside a bucket sequences form batches whose padded size stays within
the token budget.

Positions inside a bucket come from two levels, so no bucket is ordered in one task: each bucket is split by a hash of
the document, pieces are numbered on their own and moved by the number of rows in the pieces before.

Documents of length 0 (null or empty texts) keep one row with null bucket and batch. Repeated rows are separate
sequences. A batch holds one sequence at least.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, staged


def word_length(text: Column) -> Column:
    """Words of a text, and one end token; 0 where there are none."""
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(n > 0, n + 1).otherwise(0).cast("long")


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending bucket lengths, at most `buckets`, with the least total padding; ties go to the shorter first buckets."""
    if not lengths:
        return []
    n = len(lengths)
    size = np.asarray(lengths, np.float64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    used = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64) * size)])
    # padding[i, j]: lengths i..j share a bucket of length lengths[j]
    padding = size[None, :] * (rows[None, 1:] - rows[:-1, None]) - (used[None, 1:] - used[:-1, None])
    padding[np.tril_indices(n, -1)] = np.inf
    best, cuts = padding[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + padding
        first = total.argmin(axis=0)
        value = total[first, np.arange(n)]
        better = value < best
        cuts.append(np.where(better, first, -1))
        best = np.where(better, value, best)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        if j >= 0 and cut[j] >= 0:
            ends.append(j)
            j = cut[j] - 1
    ends.append(j)
    return [int(lengths[e]) for e in sorted(e for e in set(ends) if e >= 0)]


def sequences(docs: DataFrame, max_len: int, multiple: int) -> DataFrame:
    """doc_id, hash, segment, length, padded (length rounded up to `multiple`) of (doc_id, hash, length)."""
    pieces = F.greatest(F.ceil(F.col("length") / max_len), F.lit(1)).cast("int")
    return (
        docs.select("doc_id", "hash", "length", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("segment"))
        .withColumn("length", F.least(F.col("length") - F.col("segment").cast("long") * max_len, F.lit(max_len)))
        .withColumn("padded", (F.ceil(F.col("length") / multiple) * multiple).cast("long"))
    )


def pack(docs: DataFrame, length: Column | None = None, max_len: int = 2048, multiple: int = 8, buckets: int = 16, budget: int = 65_536, rows_per_piece: int = 50_000) -> DataFrame:
    """doc_id, segment, length, bucket_len, batch, slot.

    `length` is an expression over the columns of `docs` and defaults to the words of `text`. A batch is named by
    (bucket_len, batch); slot is the sequence's place in it.
    """
    if max_len % multiple or max_len // multiple > 4096:
        raise ValueError("max_len must be a multiple of `multiple`, and at most 4096 times as large")
    if length is not None:
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length")).withColumn("hash", F.xxhash64("length"))
    else:
        sized = id_and_text(docs).select("doc_id", F.coalesce(word_length(F.col("text")), F.lit(0)).alias("length"), F.xxhash64("text").alias("hash"))
    # Lengths are read four times below, texts once.
    rows = sequences(staged(sized, "lengths"), max_len, multiple)
    histogram = sorted((r["padded"], r["n"]) for r in rows.groupBy("padded").agg(F.count("*").alias("n")).collect() if r["padded"] > 0)
    ends = best_buckets([x for x, _ in histogram], [n for _, n in histogram], buckets)
    total = sum(n for _, n in histogram)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("padded") <= end, F.lit(end).cast("long")).otherwise(bucket)
    # The hash deals the rows of one id, or of none, to many pieces; rows with equal id and text share one.
    placed = rows.select("doc_id", "segment", "length", F.when(F.col("padded") > 0, bucket).alias("bucket_len"), F.pmod(F.xxhash64("doc_id", "segment", "hash"), F.lit(max(1, -(-total // rows_per_piece)))).alias("piece"))
    full = placed.filter("bucket_len is not null")
    inner = full.withColumn("at", F.row_number().over(Window.partitionBy("bucket_len", "piece").orderBy("doc_id", "segment", "length")) - 1)
    before = full.groupBy("bucket_len", "piece").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("bucket_len").orderBy("piece")) - F.col("n")).drop("n")
    at = F.col("before") + F.col("at")
    batch_rows = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1)).cast("long")
    packed = inner.join(before, ["bucket_len", "piece"]).select("doc_id", "segment", "length", "bucket_len", F.floor(at / batch_rows).cast("long").alias("batch"), (at % batch_rows).cast("long").alias("slot"))
    empty = placed.filter("bucket_len is null").select("doc_id", "segment", "length", "bucket_len", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return packed.unionAll(empty)
