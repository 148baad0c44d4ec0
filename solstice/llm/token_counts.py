"""Token counts by overlap resynchronisation (operator 9).

Texts up to `chunk` bytes are encoded as they are. Longer ones are cut into chunks that overlap by `overlap`
characters on either side, spread over the cluster, and encoded with offsets. Two neighbours are spliced at the
first pre-token start that both report in their common stretch: the scan of a pre-tokenizer depends only on what
follows, so from a common start on both give the same ids, and the left chunk is right up to there because the
start lies before its last pre-token. Junctions without a common start are encoded again with a wider overlap,
until the overlap covers the text.

Null texts count as empty (0 tokens); repeated rows each get their row; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, rows_of, staged, texts_of
from solstice.llm.tokens import PieceEncoder

#: No special string or lookahead of the library's pre-tokenizers reaches over this many characters.
_REACH = 64
_ZONE = "array<struct<p:long,t:long>>"


def _count_short(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = PieceEncoder.of_worker(path, counts=True)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            n = [sum(v) for v in encoder.encode(texts_of(part))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def _cut(chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, text in rows_of(batches, "key", "text"):
        last = 0 if overlap >= len(text) else max(0, (len(text) - 1) // chunk)
        for i in range(last + 1):
            low, high = (max(0, i * chunk - overlap), min(len(text), (i + 1) * chunk + overlap)) if last else (0, len(text))
            yield pa.RecordBatch.from_pydict({"key": [key], "i": [i], "last": [last], "low": [low], "piece": [text[low:high]]}, pa.schema([("key", pa.binary()), ("i", pa.int64()), ("last", pa.int64()), ("low", pa.int64()), ("piece", pa.string())]))


def _encode_chunks(path: str, chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk its number of ids and the starts inside the stretches it shares with its neighbours."""
    encoder = PieceEncoder.of_worker(path, counts=True)
    for key, i, last, low, piece in rows_of(batches, "key", "i", "last", "low", "piece"):
        starts = [(low + p, t) for p, t in encoder.boundaries(piece)]
        total = sum(encoder.encode([piece])[0])
        head = [{"p": p, "t": t} for p, t in starts if i > 0 and p < i * chunk + overlap]
        end = low + len(piece) - _REACH
        tail = [{"p": p, "t": t} for p, t in starts[:-1] if i < last and (i + 1) * chunk - overlap <= p < end]
        zone = pa.list_(pa.struct([("p", pa.int64()), ("t", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"key": [key], "i": [i], "last": [last], "total": [total], "head": [head], "tail": [tail]}, pa.schema([("key", pa.binary()), ("i", pa.int64()), ("last", pa.int64()), ("total", pa.int64()), ("head", zone), ("tail", zone)]))


def _spliced(chunks: DataFrame) -> DataFrame:
    """(key, n_tokens, whole): whole is false where a junction has no common start."""
    starts = chunks.select("key", (F.col("i") - 1).alias("j"), F.explode("head").alias("s"), F.lit(1).alias("right")).unionAll(
        chunks.select("key", F.col("i").alias("j"), F.explode("tail").alias("s"), F.lit(0).alias("right"))
    )
    common = (
        starts.groupBy("key", "j", F.col("s.p").alias("p"))
        .agg(F.max(F.when(F.col("right") == 0, F.col("s.t"))).alias("left_t"), F.max(F.when(F.col("right") == 1, F.col("s.t"))).alias("right_t"))
        .filter("left_t is not null and right_t is not null")
    )
    joints = common.groupBy("key", "j").agg(F.min_by(F.col("left_t") - F.col("right_t"), "p").alias("d"))
    joined = joints.groupBy("key").agg(F.count("*").alias("n"), F.sum("d").alias("d"))
    ends = chunks.filter("i = last").select("key", "last", "total")
    return ends.join(joined, "key", "left").select("key", (F.col("total") + F.coalesce("d", F.lit(0))).alias("n_tokens"), (F.coalesce("n", F.lit(0)) == F.col("last")).alias("whole"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 65_536, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text); `tokenizer` is a library file."""
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    short = rows.filter(F.col("n_bytes") <= chunk).mapInArrow(partial(_count_short, tokenizer), "doc_id long, n_bytes long, n_tokens long")
    long = rows.filter(F.col("n_bytes") > chunk).withColumn("key", F.unhex(F.sha2("text", 256)))
    counted, texts, width = None, long.select("key", "text"), overlap
    while True:
        pieces = texts.mapInArrow(partial(_cut, chunk, width), "key binary, i long, last long, low long, piece string")
        # One row per distinct text and chunk: copies are encoded once, and the chunks of one text spread over the cluster.
        spread = pieces.groupBy("key", "i").agg(F.first("last").alias("last"), F.first("low").alias("low"), F.first("piece").alias("piece"))
        encoded = spread.mapInArrow(partial(_encode_chunks, tokenizer, chunk, width), f"key binary, i long, last long, total long, head {_ZONE}, tail {_ZONE}")
        done = staged(_spliced(encoded), "token-splices")
        whole = done.filter("whole").select("key", "n_tokens")
        counted = whole if counted is None else counted.unionAll(whole)
        left = done.filter("not whole").select("key")
        if left.isEmpty():
            break
        texts, width = long.select("key", "text").join(left, "key", "left_semi"), width * 8
    per_row = long.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionAll(per_row).withColumn("over_limit", F.col("n_tokens") > limit)
