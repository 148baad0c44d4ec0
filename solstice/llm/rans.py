"""Token files coded by a static range asymmetric numeral system (operator 3).

A file holds segments of about `segment` ids. A segment is

    magic, header        scale bits, lanes, block size, counts of documents, ids and blocks
    documents            ids and lengths
    frequency table      one for all blocks of the segment, counted over all its ids, scaled to 2^scale
    checkpoints          per block: ids, first word, words, CRC-32 of its ids, and the state of every lane
    words                32-bit words of all blocks
    CRC-32               of all that

Blocks are independent: each starts from its own checkpoint, so they decode in parallel and a reader can begin at any.
Inside a block, ids go round the lanes and the lanes' words are interleaved in reading order. States are 64-bit and
give or take one 32-bit word at a time. All blocks of a segment are coded together, a step for every lane of every
block at once.

Documents are range-partitioned by id, so files hold ascending ids and the place of a document in the whole stream
follows from totals per file. Rows with one id are ordered by a hash of their text; null ids come first. Null texts
count as empty and hold just the end id. Segments are records of Parquet files, which Spark writes to and reads from
any shared store. A damaged block, table or header fails its checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, rows_of, shared_root, texts_of
from solstice.llm.tokens import WordIds

_MAGIC = b"RANSEG01"
_HEAD, _SIZES = "<8sBHIIQI", "<III"
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
SCALE, LANES, BLOCK = 20, 128, 1 << 16
#: Bytes of text that are encoded at a time.
_PORTION = 1 << 23


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^scale; what rounding leaves over goes to, or comes from, the most frequent."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("more symbols than the table has room for")
    out = np.maximum(1, counts.astype(np.float64) * total // max(1, counts.sum())).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    while (gap := total - int(out.sum())) and len(out):
        if gap > 0:
            out[order[0]] += gap
        else:
            room = out[order] - 1
            out[order] -= np.minimum(room, np.maximum(0, -gap - (np.cumsum(room) - room)))
    return out


def _by_block(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as (block, step, lane), padded, and the ids of each block."""
    blocks = -(-len(symbols) // BLOCK)
    width = min(BLOCK, -(-len(symbols) // LANES) * LANES) if blocks == 1 else BLOCK
    padded = np.zeros(blocks * width, symbols.dtype)
    padded[: len(symbols)] = symbols
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = len(symbols) - (blocks - 1) * BLOCK
    return padded.reshape(blocks, width // LANES, LANES), sizes


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) < 1 << 24:
        seen = np.bincount(ids)
        present = np.nonzero(seen)[0]
        counts, place = seen[present], np.zeros(len(seen), np.int32)
        place[present] = np.arange(len(present))
        symbols = place[ids]
    else:
        present, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = scaled(counts) if len(present) else counts
    first = np.cumsum(freq) - freq
    f64, c64 = freq.astype(np.uint64), first.astype(np.uint64)
    grid, sizes = _by_block(symbols.astype(np.int32))
    blocks, steps = grid.shape[:2] if len(ids) else (0, 0)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    given = np.zeros((blocks, steps, LANES), bool)
    lane = np.arange(LANES)
    limit = np.uint64((1 << 31 >> SCALE) << 32)
    for s in range(steps - 1, -1, -1):
        valid = (s * LANES + lane)[None, :] < sizes[:, None]
        f, c = f64[grid[:, s]], c64[grid[:, s]]
        full = (state >= limit * f) & valid
        words[:, s] = state
        given[:, s] = full
        x = np.where(full, state >> _32, state)
        q = x // f
        state = np.where(valid, (q << np.uint64(SCALE)) + (x - q * f) + c, state)
    n_words = given.sum(axis=(1, 2))
    stream = words[given].astype("<u4").tobytes()
    bounds = np.concatenate([[0], np.cumsum(sizes)]) if blocks else np.zeros(1, np.int64)
    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    table = zlib.compress(present.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    marks = np.stack([sizes, np.cumsum(n_words) - n_words, n_words, np.array(crcs)], axis=1).astype("<u8").tobytes() + state.astype("<u8").tobytes() if blocks else b""
    body = b"".join([struct.pack(_HEAD, _MAGIC, SCALE, LANES, BLOCK, len(doc_ids), len(ids), blocks), struct.pack(_SIZES, len(docs), len(table), len(marks)), docs, table, marks, stream])
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A coded segment, decoded block by block or as a whole."""

    def __init__(self, blob: bytes):
        if zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("segment is damaged")
        magic, self.scale, self.lanes, self.block, n_docs, self.n_ids, self.blocks = struct.unpack_from(_HEAD, blob)
        if magic != _MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize(_HEAD)
        sizes = struct.unpack_from(_SIZES, blob, at)
        at += struct.calcsize(_SIZES)
        docs, table, marks = (blob[at + sum(sizes[:i]) : at + sum(sizes[: i + 1])] for i in range(3))
        docs = zlib.decompress(docs)
        known = np.frombuffer(docs, np.uint8, n_docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, np.frombuffer(docs, "<i8", n_docs, n_docs), strict=True)]
        self.lengths = np.frombuffer(docs, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        pairs = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, -1)
        self.symbols, self.freq = pairs[0], pairs[1].astype(np.int64)
        grid = np.frombuffer(marks, "<u8", 4 * self.blocks).reshape(self.blocks, 4).astype(np.int64)
        self.sizes, self.first_word, _, self.crcs = grid.T
        self.states = np.frombuffer(marks, "<u8", offset=32 * self.blocks).reshape(self.blocks, self.lanes)
        self.words = np.frombuffer(blob[at + sum(sizes) : -4], "<u4")
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks first..last, all decoded side by side."""
        last = self.blocks if last is None else last
        sizes, at, state = self.sizes[first:last], self.first_word[first:last].copy(), self.states[first:last].copy()
        if not len(sizes):
            return np.zeros(0, np.uint32)
        f64 = self.freq.astype(np.uint64)
        c64 = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        steps = -(-int(sizes.max()) // self.lanes)
        out = np.zeros((len(sizes), steps, self.lanes), np.int32)
        lane, mask, scale = np.arange(self.lanes), np.uint64((1 << self.scale) - 1), np.uint64(self.scale)
        words = np.append(self.words, np.uint32(0)).astype(np.uint64)
        for s in range(steps):
            valid = (s * self.lanes + lane)[None, :] < sizes[:, None]
            slot = state & mask
            symbol = self.slots[slot.astype(np.int64)]
            out[:, s] = symbol
            x = f64[symbol] * (state >> scale) + slot - c64[symbol]
            need = (x < _LOW) & valid
            taken = np.cumsum(need, axis=1)
            read = np.minimum(at[:, None] + taken - 1, len(words) - 1)
            x = np.where(need, (x << _32) | words[read], x)
            state = np.where(valid, x, state)
            at += taken[:, -1]
        ids = self.symbols[out.reshape(len(sizes), -1)]
        parts = [row[:n] for row, n in zip(ids, sizes.tolist(), strict=True)]
        for part, crc in zip(parts, self.crcs[first:last].tolist(), strict=True):
            if zlib.crc32(part.astype("<u4").tobytes()) != crc:
                raise ValueError("block is damaged")
        return np.concatenate(parts)


_STORED = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in portions that begin in one stretch of _PORTION bytes of text, at most 10,000 rows each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lot = (np.cumsum(sizes) - sizes) // _PORTION
    bounds = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        for i in range(a, b, 10_000):
            yield batch.slice(i, min(10_000, b - i))


def _write(tokenizer: str, end_id: int, segment: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, part, at = WordIds.of_worker(tokenizer), TaskContext.get().partitionId(), 0
    doc_ids, lengths, coded, size = [], [], [], 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(coded)
        row = [[part], [at], [len(ids)], [encode_segment(doc_ids, lengths, ids)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _STORED, strict=True)], schema=_STORED)

    for batch in batches:
        for some in _portions(batch):
            ids, n = encoder.encode(texts_of(some))
            ends = np.cumsum(n + 1)
            ids = np.insert(ids, np.cumsum(n), end_id)
            first, done, named = 0, 0, some.column("doc_id").to_pylist()
            while first < len(named):
                # up to the document that fills the segment
                last = min(int(np.searchsorted(ends, done + segment - size)) + 1, len(named))
                doc_ids += named[first:last]
                lengths += (n[first:last] + 1).tolist()
                coded.append(ids[done : ends[last - 1]])
                size += len(coded[-1])
                first, done = last, int(ends[last - 1])
                if size >= segment:
                    yield close()
                    at += size
                    doc_ids, lengths, coded, size = [], [], [], 0
    if doc_ids:
        yield close()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, segment: int = 1 << 21) -> None:
    """Write the ids of (doc_id, text), an end id after each document, to token files in ascending order of doc_id."""
    rows = id_and_text(docs)
    # The hash of the text splits the rows of one id, or of none, over ranges.
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = ordered.mapInArrow(partial(_write, tokenizer, end_id, segment), "part int, at long, n_ids long, segment binary")
    stored.write.option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(start, segment): start counts the ids of all segments before. There is one total per written partition."""
    stored = spark.read.schema("part int, at long, n_ids long, segment binary").parquet(path)
    totals, start, before = stored.groupBy("part").agg(F.sum("n_ids").alias("n")), {}, 0
    for r in sorted(totals.collect()):
        start[r["part"]] = before
        before += r["n"]
    starts = spark.createDataFrame(list(start.items()), "part int, before long")
    return stored.join(F.broadcast(starts), "part").select((F.col("before") + F.col("at")).alias("start"), "segment")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for start, blob in rows_of(batches, "start", "segment"):
        s = Segment(blob)
        ids = s.decode().astype("<u4")
        ends = np.cumsum(s.lengths)
        crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), s.lengths.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + ends - s.lengths), pa.array(s.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for start, blob in rows_of(batches, "start", "segment"):
        s = Segment(blob)
        ends = np.cumsum(s.lengths)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(s.decode().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + ends - s.lengths), ids], ["doc_id", "start", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document in the files."""
    return read_segments(spark, path).mapInArrow(_tokens, "doc_id long, start long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/llm/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path)
    return read_segments(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
