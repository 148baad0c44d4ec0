"""Hard-negative mining over rotated one-bit codes (operator 13).

Every vector becomes whole numbers, floor(256 x). The index stores, beside them, the signs of the rotated vector (one bit a
dimension), the alignment <r, b> of the rotated vector r with its unit code vector b, and the length of what the code leaves
out, sqrt(|r|^2 - <r, b>^2). A rotated anchor q is cut into bit planes; popcounts of planes and codes give <q, b> up to the
rounding of the planes. The score <q, r> is <r, b> <q, b> plus a product of the two parts that stand upright on b, which by
Cauchy-Schwarz lies within |q - <q, b> b| * sqrt(|r|^2 - <r, b>^2). This interval holds without exception. What it cannot
rule out is scored by whole numbers, so results are exact; only the work depends on how narrow the intervals are.

Anchors are a stated query set: they meet all rows in slices of `slice_rows` anchors, each broadcast (about 600 bytes an
anchor of 64 dimensions, so 12 MB), and each task hands on at most `positives`, or `positives * negatives`, rows an anchor.

Left out: null labels, null vectors, vectors with a null or non-finite component or with one of 2^20 or more (whose scores
do not fit a long), empty vectors, and vectors whose length is not the most frequent one (the greater of equally frequent
ones). A row without an id is no anchor and comes after all others in ties. Rows that stand several times are rows of their
own: each can be a positive or negative of the others, and each anchor among them has its own results. Rows equal in score
and id are in no defined order, but such rows give equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.llm.common import shared_root, staged

SCALE = 256
_LIMIT = 2.0**20
#: Bits of an anchor's planes; rows met at once; anchors met at once; rows of a block scored first to raise the bar.
PLANES, _ROWS, _ANCHORS, _FIRST = 6, 4096, 64, 32
_NO_ID = 2**63 - 1
_NONE = -(2**63)


def rotation(d: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    n, d = flags.shape
    padded = np.zeros((n, -(-d // 64) * 64), np.uint8)
    padded[:, :d] = flags
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = None
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            x = np.floor(SCALE * _vectors(part.column("vec"))).astype(np.int64)
            turn = rotation(x.shape[1]) if turn is None else turn
            r = x @ turn
            aligned = np.abs(r).sum(axis=1) / np.sqrt(x.shape[1])
            rest = np.sqrt(np.maximum((r * r).sum(axis=1) - aligned * aligned, 0))
            codes = _bits(r >= 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array(list(x.astype(np.int32))), pa.array(list(codes.view(np.int64))), pa.array(aligned), pa.array(rest)],
                ["vec_id", "label", "x", "code", "aligned", "rest"],
            )


def build_index(rows: DataFrame, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x, code, aligned, rest, row) of every row that takes part, written to the shared folder; row is unique."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_LIMIT)))
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), vec.alias("vec"), fine.alias("fine"), F.size(vec).alias("width"))
    picked = picked.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.col("fine") & (F.col("width") > 0))
    widths = picked.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    picked = picked.filter(F.col("width") == (widths[0]["width"] if widths else 0)).select("vec_id", "label", "vec")
    index = picked.mapInArrow(_index, "vec_id long, label long, x array<int>, code array<long>, aligned double, rest double")
    return staged(index.withColumn("row", F.monotonically_increasing_id()), "one-bit-codes")


class Block:
    """Rows of the index at hand."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("vec_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.labels, self.rows = batch.column("label").to_numpy(), batch.column("row").to_numpy()
        self.x = _vectors(batch.column("x")).astype(float)
        self.most = np.abs(self.x).max(initial=0)
        self.code = np.ascontiguousarray(_vectors(batch.column("code"))).view(np.uint64)
        self.aligned, self.rest = batch.column("aligned").to_numpy(), batch.column("rest").to_numpy()
        self.length = np.hypot(self.aligned, self.rest)


class Anchors:
    """A slice of anchors, with their bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.rows, self.x = ids, labels, rows, x.astype(float)
        self.most = np.abs(self.x).max(initial=0)
        d = x.shape[1]
        q = self.x @ rotation(d)
        self.length = np.sqrt((q * q).sum(axis=1))
        self.low = q.min(axis=1)
        self.step = np.maximum((q.max(axis=1) - self.low) / (2**PLANES - 1), np.finfo(float).tiny)
        u = np.clip(np.rint((q - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        self.planes = [_bits((u >> k) & 1) for k in range(PLANES)]
        self.total = u.sum(axis=1)
        #: Length of what the planes round away.
        off = q - (self.low[:, None] + self.step[:, None] * u)
        self.off = np.sqrt((off * off).sum(axis=1))
        self.d = d

    def intervals(self, i: slice, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of anchors i (rows) and the block's vectors (columns)."""
        ones = np.bitwise_count(block.code).sum(axis=1, dtype=np.int64)
        weighted = 0
        for k, plane in enumerate(self.planes):
            weighted = weighted + (np.bitwise_count(plane[i][:, None, :] & block.code[None, :, :]).sum(axis=2, dtype=np.int64) << k)
        low, step = self.low[i][:, None], self.step[i][:, None]
        # b holds +-1 / sqrt(d); a set bit is +1.
        dot = (low * (2 * ones - self.d)[None, :] + step * (2 * weighted - self.total[i][:, None])) / np.sqrt(self.d)
        upright = np.sqrt(np.maximum(self.length[i][:, None] ** 2 - np.maximum(np.abs(dot) - self.off[i][:, None], 0) ** 2, 0))
        # Planes are off by at most self.off along b; a billionth of both lengths covers floating-point rounding.
        wide = upright * block.rest[None, :] + self.off[i][:, None] * block.aligned[None, :] + 1e-9 * self.length[i][:, None] * block.length[None, :] + 1e-6
        middle = dot * block.aligned[None, :]
        return middle - wide, middle + wide

    def scores(self, a: int, block: Block, at: np.ndarray) -> np.ndarray:
        """Integer scores of one anchor and some of the block's vectors."""
        if self.most * block.most * self.d < 2**53:
            return (block.x[at] @ self.x[a]).astype(np.int64)
        return block.x[at].astype(np.int64) @ self.x[a].astype(np.int64)


class Best:
    """The best few (score, id, row) so far, higher scores first, then smaller ids."""

    def __init__(self, size: int):
        self.size, self.score, self.id, self.row = size, *(np.zeros(0, np.int64) for _ in range(3))

    @property
    def bar(self) -> int:
        """What a score must reach to come in."""
        return int(self.score[-1]) if len(self.score) == self.size else _NONE

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > 4 * self.size:
            cut = np.partition(score, len(score) - self.size)[len(score) - self.size]
            some = score >= cut
            score, ids, rows = score[some], ids[some], rows[some]
        score, ids, rows = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        order = np.lexsort((rows, ids, -score))[: self.size]
        self.score, self.id, self.row = score[order], ids[order], rows[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield Block(batch.slice(i, _ROWS))


def _scan(anchors: Anchors, block: Block, same_label: bool, bars, meet) -> None:
    """Score what the intervals leave: bars(a) gives ranges [low, high] of wanted scores, meet(a, scores, where) takes them."""
    by_label = {int(k): np.flatnonzero(block.labels == k) for k in np.unique(block.labels)}
    for start in range(0, len(anchors.ids), _ANCHORS):
        part = slice(start, min(start + _ANCHORS, len(anchors.ids)))
        least, greatest = anchors.intervals(part, block)
        for a in range(part.start, part.stop):
            mine = by_label.get(int(anchors.labels[a]), np.zeros(0, np.int64))
            if same_label:
                where = mine[block.rows[mine] != anchors.rows[a]]
            else:
                others = np.ones(len(block.ids), bool)
                others[mine] = False
                where = np.flatnonzero(others)
            lo, hi = least[a - start][where], greatest[a - start][where]
            # The most promising first, which raises the bar for the rest.
            if len(where) > 4 * _FIRST:
                first = np.argpartition(-hi, _FIRST)[:_FIRST]
                meet(a, anchors.scores(a, block, where[first]), where[first])
                rest = np.ones(len(where), bool)
                rest[first] = False
                where, lo, hi = where[rest], lo[rest], hi[rest]
            wanted = np.zeros(len(where), bool)
            for low, high in bars(a):
                wanted |= (hi >= low) & (lo <= high)
            where = where[wanted]
            if len(where):
                meet(a, anchors.scores(a, block, where), where)


def _positives(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors: Anchors = shared.value
    best = [Best(k) for _ in anchors.ids]

    def meet(a: int, scores: np.ndarray, where: np.ndarray) -> None:
        best[a].add(scores, block.ids[where], block.rows[where])

    for block in _blocks(batches):
        _scan(anchors, block, True, lambda a: [(best[a].bar, np.inf)], meet)
    yield from _found([(anchors.rows[a], -1, b) for a, b in enumerate(best)])


def _negatives(shared, k: int, low_share: int, high_share: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors, positives = shared.value
    # Bands of wanted scores, one per anchor and distinct positive score.
    bands = [{p: (-(-low_share * p // 100), high_share * p // 100, Best(k)) for p in ps} for ps in positives]

    def bars(a: int) -> Iterator[tuple]:
        for low, high, b in bands[a].values():
            if low <= high:
                yield max(low, b.bar), high

    def meet(a: int, scores: np.ndarray, where: np.ndarray) -> None:
        for low, high, b in bands[a].values():
            inside = (scores >= max(low, b.bar)) & (scores <= high)
            if inside.any():
                b.add(scores[inside], block.ids[where[inside]], block.rows[where[inside]])

    for block in _blocks(batches):
        _scan(anchors, block, False, bars, meet)
    yield from _found([(anchors.rows[a], p, b) for a, mine in enumerate(bands) for p, (_, _, b) in mine.items()])


def _found(bests: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(anchor_row, band, score, id, row); band is the positive's score, -1 for positives themselves."""
    for i in range(0, len(bests), 20_000):
        part = [x for x in bests[i : i + 20_000] if len(x[2].score)]
        if part:
            sizes = [len(b.score) for _, _, b in part]
            ids = np.concatenate([b.id for _, _, b in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([r for r, _, _ in part], np.int64), sizes)),
                    pa.array(np.repeat(np.array([p for _, p, _ in part], np.int64), sizes)),
                    pa.array(np.concatenate([b.score for _, _, b in part])),
                    pa.array(ids, mask=ids == _NO_ID),
                    pa.array(np.concatenate([b.row for _, _, b in part])),
                ],
                ["anchor_row", "band", "score", "id", "row"],
            )


_FOUND = "anchor_row long, band long, score long, id long, row long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and band over all tasks."""
    place = F.row_number().over(Window.partitionBy("anchor_row", "band").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _slices(anchors: DataFrame, slice_rows: int) -> tuple[DataFrame, int]:
    """Anchors with the number of their slice, and the number of slices; every slice but the last has slice_rows."""
    numbered = staged(anchors.withColumn("at", F.monotonically_increasing_id()), "anchors")
    # A number's upper bits are its partition, the lower ones count up from 0 in it; the driver sees one row a partition.
    sizes = numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, parts = 0, []
    for r in sizes:
        parts.append((r["part"], before))
        before += r["n"]
    firsts = anchors.sparkSession.createDataFrame(parts, "part long, first long")
    number = F.floor((F.col("first") + F.col("at").bitwiseAND(2**33 - 1)) / slice_rows)
    placed = numbered.join(firsts, F.shiftright("at", 33) == F.col("part")).withColumn("slice", number).drop("at", "part", "first")
    return staged(placed, "anchor-slices"), -(-before // slice_rows)


def mine(index: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_share: int = 80, high_share: int = 100, slice_rows: int = 20_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for `anchors`, rows of the index.

    A negative n of a positive p has low_share * p <= 100 * n <= high_share * p.
    """
    spark = index.sparkSession
    sliced, slices = _slices(anchors.select("vec_id", "label", "row", "x"), slice_rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = f"{shared_root(spark)}/llm/hard-negatives-{uuid.uuid4().hex}"
    for k in range(slices):
        here = sliced.filter(F.col("slice") == k)
        at_hand = here.toArrow()  # at most slice_rows
        a = Anchors(at_hand.column("vec_id").to_numpy(), at_hand.column("label").to_numpy(), at_hand.column("row").to_numpy(), _vectors(at_hand.column("x").combine_chunks()))
        shared = spark.sparkContext.broadcast(a)
        pairs = staged(_ranked(index.mapInArrow(partial(_positives, shared, positives), _FOUND), positives), "positives")
        scores: dict[int, set] = {}
        for r in pairs.select("anchor_row", "score").distinct().collect():  # at most `positives` an anchor of this slice
            scores.setdefault(r["anchor_row"], set()).add(r["score"])
        bands = spark.sparkContext.broadcast((a, [sorted(scores.get(int(r), ())) for r in a.rows]))
        found = _ranked(index.mapInArrow(partial(_negatives, bands, negatives, low_share, high_share), _FOUND), negatives)
        names = here.select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor_row"))
        named = pairs.select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("band")).join(names, "anchor_row")
        done = named.join(found.select("anchor_row", "band", "score", "id", "rank"), ["anchor_row", "band"])
        done = done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("band").alias("positive_score"), F.col("score").alias("negative_score"))
        done.write.parquet(f"{path}/slice={k}")
        shared.unpersist()
        bands.unpersist()
    return spark.read.schema(schema + ", slice int").parquet(path).drop("slice") if slices else spark.createDataFrame([], schema)
