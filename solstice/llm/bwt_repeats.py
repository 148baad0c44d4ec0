"""Repeated byte strings by merging Burrows-Wheeler transforms (operator 8).

Every byte of a 200-byte string that starts in two or more places is found and cut, exactly.

* Anchors. Of any 153 consecutive 48-byte strings the one with the least hash is an anchor (winnowing), so every
  200-byte string holds an anchor that depends on its bytes alone. Two places with the same 200 bytes share the anchor's
  hash and its offset. Anchors whose hash occurs once in the corpus, and all text around them, leave here.
* Windows. A 200-byte string that holds an anchor lies within 152 bytes before it and 200 bytes from it. Equal windows
  around equal anchors are repeats as they stand, told by their digests; only where an anchor has windows of several
  kinds, and one that stands alone, do the bytes of its windows go on, one copy each.
* Bins of anchors go to tasks. There a window is a string over 8-byte words counted from its anchor. A bin's windows come
  in shards; each shard gets its own BWT. The shards are merged by interleave refinement: all positions start in blocks by
  anchor and offset, and every pass follows the LF mapping of the shards one word back and splits the blocks by that
  word. After 24 passes positions in one block share 24 words. Blocks of one position are dropped on the way, since their
  extensions are single as well, so suffixes are never sorted across shards.
* A repeated 200-byte string covers 24 whole words whatever its start, and up to 8 bytes around them, which are compared
  exactly. What is left are the intervals to cut.

Equal texts are treated once: in copies, texts of 200 bytes and more lose everything. Shorter texts have no repeats, null
counts as empty. Every row gets its result, repeated rows too; a null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, staged, texts_of

LENGTH, GRAM, WORD = 200, 48, 8
BEFORE = LENGTH - GRAM
#: Consecutive grams of one string.
SPAN = BEFORE + 1
DEPTH = (LENGTH - WORD + 1) // WORD
_CHUNK = (1 << 20) - 4096
_POSITION = np.uint64((1 << 20) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of the anchors, and their hashes."""
    at, hashes = [], []
    for start in range(0, max(1, len(data) - LENGTH + 1), _CHUNK):
        part = data[start : start + _CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        n = len(part) - GRAM + 1
        h = words[:n] * _A
        for j in range(WORD, GRAM, WORD):
            h ^= h >> np.uint64(29)
            h += words[j : j + n]
            h *= _B
        h ^= h >> np.uint64(32)
        h *= _C
        h ^= h >> np.uint64(29)
        # The position below the hash makes the rightmost of equal grams the least.
        key = (h & ~_POSITION) | (_POSITION - np.arange(n, dtype=np.uint64))
        rows = -(-n // SPAN)
        grid = np.full(rows * SPAN, np.iinfo(np.uint64).max)
        grid[:n] = key
        grid = grid.reshape(rows, SPAN)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[: n - SPAN + 1], ahead[SPAN - 1 : n])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        local = (_POSITION - (least & _POSITION)).astype(np.int64)
        at.append(local + start)
        hashes.append(h[local].view(np.int64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, hashes[first]


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(t.encode())[1] for t in texts_of(batch)]
        keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["anchor", "n"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(t.encode()) for t in texts_of(batch)]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
        join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(join(1)), batch.column("h1").take(rows), batch.column("h2").take(rows), pa.array(join(0))], ["anchor", "h1", "h2", "at"])


_DIGESTS = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("h1", pa.int64()), ("h2", pa.int32()), ("low", pa.int64()), ("size", pa.int64())])
_BYTES = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("window", pa.binary()), ("offset", pa.int64())])


def _windows(with_bytes: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per anchor of a text its window: the digest and place, or the digest and bytes."""
    schema = _BYTES if with_bytes else _DIGESTS
    for whole in batches:
        for first in range(0, whole.num_rows, 200):
            batch, out = whole.slice(first, 200), []
            for h1, h2, found, text in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "found", "text")), strict=True):
                data = text.encode()
                for x in found:
                    at = x["at"]
                    low, high = max(0, at - BEFORE), min(len(data), at + LENGTH)
                    window = data[low:high]
                    # Windows that a text cuts short on the left differ from others by where the anchor stands.
                    digest = hashlib.blake2b(window, digest_size=14).digest() + (at - low).to_bytes(2, "little")
                    out.append((x["anchor"], digest, window, at - low) if with_bytes else (x["anchor"], digest, h1, h2, low, high - low))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Shard:
    """BWT of a set of strings over word symbols: per sorted suffix the symbol before it, and its LF step."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        n = len(symbols)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)
        rank, reach = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while reach < int(sizes.max(initial=0)):
            inside = left > reach
            follow = np.zeros(n, np.int64)
            follow[inside] = rank[np.nonzero(inside)[0] + reach] + 1
            pair = rank * (rank.max() + 2) + follow
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            ordered = pair[order]
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            reach *= 2
        self.suffix = order
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        starts = np.zeros(n, bool)
        starts[ends - sizes] = True
        #: -1 where the suffix is its whole string.
        self.bwt = np.where(starts[order], -1, symbols[order - 1])
        self.lf = np.where(starts[order], -1, place[order - 1])


def _blocks_of(*keys: np.ndarray) -> np.ndarray:
    """Number of the group each row falls in by all keys."""
    block = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        _, inverse = np.unique(k, return_inverse=True)
        _, block = np.unique(block * (int(inverse.max(initial=0)) + 1) + inverse, return_inverse=True)
    return block


def _in_company(block: np.ndarray) -> np.ndarray:
    return np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)


def repeated_starts(anchor: np.ndarray, windows: list[bytes], offset: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, byte in it) of every 200-byte string that stands at the same offset from the same anchor in another window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    skip = offset % WORD
    sizes = np.maximum(0, (np.array([len(w) for w in windows]) - skip) // WORD)
    lengths = np.array([len(w) for w in windows])
    if not sizes.sum():
        return none
    words = np.concatenate([np.frombuffer(w, "<u8", int(n), int(s)) for w, n, s in zip(windows, sizes, skip, strict=True)])
    _, ranks = np.unique(words, return_inverse=True)
    # Every string ends in a terminator, symbol 0, where matches that reach its end begin.
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    symbols = np.zeros(ends[-1], np.int64)
    symbols[np.delete(np.arange(ends[-1]), ends - 1)] = ranks + 1
    window_of = np.repeat(np.arange(len(windows)), sizes)
    index = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    shards, first = [], 0
    for a in range(0, len(windows), shard):
        size = sizes[a : a + shard]
        s = Shard(symbols[first : first + size.sum()], size)
        shards.append((s.bwt, np.where(s.lf < 0, -1, s.lf + first), s.suffix + first))
        first += int(size.sum())
    bwt, lf, suffix = (np.concatenate(x) for x in zip(*shards, strict=True))
    # Depth 0: positions meet by anchor and by their offset from it.
    at = window_of[suffix]
    block = _blocks_of(anchor[at], index[suffix] - (offset[at] - skip[at]) // WORD)
    rows = np.nonzero(_in_company(block))[0]
    block = block[rows]
    for _ in range(DEPTH):
        back = bwt[rows] >= 0
        rows, block = rows[back], block[back]
        if not len(rows):
            return none
        symbol = bwt[rows]
        _, block = np.unique(block * (int(symbol.max()) + 1) + symbol, return_inverse=True)
        rows = lf[rows]
        alive = _in_company(block)
        rows, block = rows[alive], block[alive]
    if not len(rows):
        return none
    suffixes = suffix[rows]
    w, begin = window_of[suffixes], skip[window_of[suffixes]] + WORD * index[suffixes]
    after = begin + WORD * DEPTH
    text = np.frombuffer(b"\0" * WORD + b"".join(windows) + b"\0" * (2 * WORD), np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + WORD
    grid = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    before, behind = grid[base[w] + begin - WORD], grid[base[w] + after]
    found_w, found_b = [], []
    for j in range(WORD):
        # j bytes before the 24 words and 8 - j after them
        fits = (begin - j >= 0) & (begin - j + LENGTH <= lengths[w])
        if not fits.any():
            continue
        lead = before[fits] >> np.uint64(8 * (WORD - j)) if j else np.zeros(fits.sum(), np.uint64)
        tail = behind[fits] << np.uint64(8 * j)
        same = _in_company(_blocks_of(block[fits], lead, tail))
        found_w.append(w[fits][same])
        found_b.append(begin[fits][same] - j)
    return (np.concatenate(found_w), np.concatenate(found_b)) if found_w else none


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per key, touching ones joined."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    span = int(max(end.max(), 1)) + 1
    reach = np.maximum.accumulate(key * span + end)
    fresh = np.concatenate([[True], key[1:] * span + start[1:] > reach[:-1]])
    first = np.nonzero(fresh)[0]
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], reach[last] - key[first] * span


def _merge_bin(shard: int, budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a bin arrive together; whole anchors are taken up to a budget of bytes and merged."""
    rows, size = [], 0

    def solve() -> pa.RecordBatch:
        anchor = np.array([r[0] for r in rows], np.int64)
        w, b = repeated_starts(anchor, [r[2] for r in rows], np.array([r[3] for r in rows], np.int64), shard)
        w, start, end = merged(w, b, b + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(anchor[w]), pa.array([rows[i][1] for i in w.tolist()], pa.binary()), pa.array(start), pa.array(end)], ["anchor", "digest", "start", "end"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "window", "offset")), strict=True):
            if size > budget and row[0] != rows[-1][0]:
                yield solve()
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield solve()


_CUT = "h1 long, h2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans, copies in zip(texts_of(batch), batch.column("spans").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            data = text.encode()
            if copies > 1 and len(data) >= LENGTH:
                spans = [{"start": 0, "end": len(data)}]
            s = np.array([x["start"] for x in spans or []], np.int64)
            _, start, end = merged(np.zeros(len(s), np.int64), s, np.array([x["end"] for x in spans or []], np.int64))
            bounds = [0, *np.stack([start, end], axis=1).reshape(-1).tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            out.append((len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept if keep else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_KEY = ["h1", "h2"]


def _grouped(places: DataFrame, *fields: str, name: str) -> DataFrame:
    return places.groupBy(*_KEY).agg(F.collect_list(F.struct(*fields)).alias(name))


def repeated_spans(texts: DataFrame, shard: int = 4096, budget: int = 16_000_000) -> DataFrame:
    """(h1, h2, spans): byte intervals, maybe overlapping, that cover every string repeated in or between the distinct (h1, h2, text)."""
    counted = texts.select("text").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    placed = texts.select(*_KEY, "text").mapInArrow(_anchor_rows, "anchor long, h1 long, h2 int, at long").join(counted.hint("merge"), "anchor", "left_semi")
    found = texts.select(*_KEY, "text").join(_grouped(placed, "at", "anchor", name="found").hint("merge"), _KEY)
    places = staged(found.mapInArrow(partial(_windows, False), "anchor long, digest binary, h1 long, h2 int, low long, size long"), "repeat-windows")
    first = F.min(F.struct("h1", "h2", "low", "size"))
    distinct = places.groupBy("anchor", "digest").agg(F.count("*").alias("n"), first.alias("first"))
    # An anchor with one kind of window, or only with windows that occur twice as they stand, needs no merging.
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("anchor")
    offset = F.conv(F.hex(F.concat(F.substring("digest", 16, 1), F.substring("digest", 15, 1))), 16, 10).cast("long")
    wanted = distinct.join(mixed.hint("merge"), "anchor", "left_semi").select("anchor", "first.h1", "first.h2", (F.col("first.low") + offset).alias("at"))
    # All columns of the texts, so that the shuffle of the last step is the same one and is reused.
    bytes_of = texts.join(_grouped(wanted, "at", "anchor", name="found").hint("merge"), _KEY)
    bins = bytes_of.mapInArrow(partial(_windows, True), "anchor long, digest binary, window binary, offset long").repartition("anchor").sortWithinPartitions("anchor")
    parts = bins.mapInArrow(partial(_merge_bin, shard, budget), "anchor long, digest binary, start long, end long")
    whole = distinct.filter("n > 1").select("anchor", "digest", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    spans = places.join(whole.unionAll(parts).hint("merge"), ["anchor", "digest"]).filter(F.coalesce("end", "size") - F.col("start") >= LENGTH)
    cuts = spans.select(*_KEY, (F.col("low") + F.col("start")).alias("start"), (F.col("low") + F.coalesce("end", "size")).alias("end"))
    return _grouped(cuts, "start", "end", name="spans")


def cut_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for, of every row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = id_and_text(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    # Equal texts are treated once; two hashes of 96 bits together name a text.
    texts = rows.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    spans = repeated_spans(texts)
    done = texts.join(spans.hint("merge"), _KEY, "left").select(*_KEY, "text", "copies", "spans").mapInArrow(partial(_cut, keep_text), _CUT)
    out = rows.select("doc_id", *_KEY).join(done.hint("merge"), _KEY).drop(*_KEY)
    return out if keep_text else out.drop("kept")
