"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

Documents are sets of five-word shingles. Equal sets form a class, and only one member of a class goes on. Every tree of
the forest labels a class by a sequence of MinHash values of eight bits each, packed so that sorted labels are a prefix
trie: classes that share a prefix stand next to each other.

* Tries. All labels of all trees are sorted over the cluster by ranges, so a prefix of any size is spread over as many
  tasks as it fills. One pass over a sorted range gives every class the first class of its node at each depth; the ends of
  the ranges, two rows a range, join nodes that a cut went through.
* Shortening. Matched prefixes start at full depth. Every pair of a class and the first of its node has a similarity that
  all their values estimate, and with it a chance to meet at a depth; the inverse chances of the pairs that met add up to
  the pairs there are (Horvitz and Thompson). Per band of similarity this gives the recall, and all prefixes lose a value
  as long as some band from the threshold up is below the target. The floor is the depth at which a pair just at the
  threshold meets with the target's chance: there nothing is left to gain.
* Verification. Candidates are never listed pair by pair. Connected components of the classes that met are small
  neighbourhoods, each text goes to its own neighbourhood once, and there all pairs are compared exactly by their
  shingles. A neighbourhood of more than `block` classes is cut into blocks, and every two blocks meet in a task of their
  own, so no task holds more than two blocks. What leaves a task is one row per class: its links, and the least class it
  is connected to.

Words are runs of `[^\\x20\\x09-\\x0D]`; a text of one to four words is a single shingle. Texts without words, null ones
too, link to nothing. A null id stays null and links to nothing. Rows with one id and different texts are told apart;
equal rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, rows_of, staged, texts_of
from solstice.llm.components import components
from solstice.llm.divergence import words_of

N = 5
_SEED = 20240607
#: Words a task remembers, some 30 MB.
_KEEP = 200_000
#: Bands of similarity whose recall is watched, each this wide, from the threshold to 1.
_BAND = 0.05


def chance(similarity: float, k: int, trees: int) -> float:
    """Of a pair to share k values in some tree."""
    return 1 - (1 - similarity**k) ** trees


def prefix_length(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The shortest prefix ever needed: a pair at `similarity` meets in some tree with the wanted chance."""
    for k in range(depth, 0, -1):
        if chance(similarity, k, trees) >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def shingle_hashes(words: list[str], seen: dict) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    get = seen.get
    h = [get(w) for w in words]
    if None in h:
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        h = [seen[w] for w in words]
    h = np.array(h, np.uint64)
    n = max(1, len(h) - N + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(N, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _labels(trees: int, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the digest of its shingle set and, per tree, its label, eight bits a value, the first value on top."""
    factors = np.random.default_rng(_SEED).integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = (np.uint64(8) * np.arange(7, 7 - depth, -1).astype(np.uint64))[None, :]
    seen: dict = {}
    for batch in batches:
        ids, keys, labels = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            if len(seen) > _KEEP:
                seen.clear()
            x = shingle_hashes(words_of(text), seen)
            if doc_id is None or not len(x):
                continue
            least = np.full(len(factors), 2**64 - 1, np.uint64)
            for a in range(0, len(x), 2048):
                least = np.minimum(least, np.multiply.outer(factors, x[a : a + 2048]).min(axis=1))
            values = ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(56)).reshape(trees, depth)
            ids.append(doc_id)
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            labels.append((values << shift).sum(axis=1, dtype=np.uint64).astype(np.int64))
        flat = pa.array(np.concatenate(labels) if labels else np.zeros(0, np.int64))
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * trees)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "key", "labels"])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of leading bytes in which unsigned 64-bit labels agree."""
    differ = (x ^ y).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    return np.where(differ.any(axis=1), differ.argmax(axis=1), 8)


def _tries(floor: int, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted leaves: for leaves that continue a node, its first leaf at every depth from the floor.

    The first and the last leaf of the range come once more, with null heads.
    """
    depths = range(floor, depth + 1)
    kinds = pa.schema([("tree", pa.int32()), ("label", pa.int64()), ("node", pa.int64()), ("heads", pa.list_(pa.int64()))])
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "label", "node"))
        before = last or (tree[0], label[0], node[0], None)
        shared = _common(label.view(np.uint64), np.concatenate([[before[1]], label[:-1]]).astype(np.int64).view(np.uint64))
        shared[tree != np.concatenate([[before[0]], tree[:-1]])] = 0
        if last is None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], k.type) for x, k in zip(before[:3], kinds, strict=False)), pa.array([None], kinds[3].type)], schema=kinds)
            shared[0] = 0
        heads = np.empty((len(node), len(depths)), np.int64)
        for j, k in enumerate(depths):
            # -1 is a run that began before this batch.
            start = np.maximum.accumulate(np.where(shared < k, np.arange(len(node)), -1))
            heads[:, j] = np.where(start < 0, before[3][j] if before[3] is not None else 0, node[start])
        last = tree[-1], label[-1], node[-1], heads[-1]
        at = np.nonzero(heads[:, 0] != node)[0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(depths)), pa.array(heads[at].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(tree[at], pa.int32()), pa.array(label[at]), pa.array(node[at]), lists], schema=kinds)
    if last:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], k.type) for x, k in zip(last[:3], kinds, strict=False)), pa.array([None], kinds[3].type)], schema=kinds)


def tries(leaves: DataFrame, floor: int, depth: int) -> DataFrame:
    """(node, heads) from leaves (tree, label, node): one class its node's leaves hang on, per depth from the floor; itself where it is the first."""
    ranges = leaves.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = staged(ranges.mapInArrow(partial(_tries, floor, depth), "tree int, label long, node long, heads array<long>"), "forest-tries")
    # Two leaves a range, and only within a tree: what is sorted here grows with the number of ranges alone.
    order = Window.partitionBy("tree").orderBy("label", "node")
    ends = found.filter("heads is null").select("tree", "label", "node", F.lag("label").over(order).alias("l"), F.lag("node").over(order).alias("n"))
    near = [F.when(F.shiftrightunsigned(F.col("label").bitwiseXOR(F.col("l")), 64 - 8 * k) == 0 if k < 8 else F.col("label") == F.col("l"), F.col("n")).otherwise(F.col("node")) for k in range(floor, depth + 1)]
    return found.filter("heads is not null").select("node", "heads").unionAll(ends.select("node", F.array(*near).alias("heads")))


def _similarities(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of two classes as their values estimate it, less the values that agree by chance."""
    for batch in batches:
        x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
        same = np.zeros(batch.num_rows)
        if batch.num_rows:
            equal = ((x ^ y).astype(">i8").view(np.uint8).reshape(len(x), 8)[:, :depth] == 0).mean(axis=1)
            same = np.clip((equal.reshape(batch.num_rows, -1).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column("deepest"), pa.array(same)], ["deepest", "similarity"])


def matched_depth(edges: DataFrame, labels: DataFrame, trees: int, floor: int, depth: int, similarity: float, recall: float) -> int:
    """How many values matched prefixes keep: shortened from `depth` until the recall of every band reaches the target."""
    if floor == depth:
        return depth
    pairs = edges.select("node", F.posexplode("heads").alias("at", "head")).filter("node <> head").groupBy("node", "head").agg((F.max("at") + floor).alias("deepest"))
    both = pairs.join(labels.select("node", F.col("labels").alias("x")), "node").join(labels.select(F.col("node").alias("head"), F.col("labels").alias("y")), "head")
    judged = both.select("deepest", "x", "y").mapInArrow(partial(_similarities, depth), "deepest int, similarity double").filter(F.col("similarity") >= similarity)
    band = F.floor((F.col("similarity") - similarity) / _BAND)
    inverse = [F.sum(1 / (1 - F.pow(1 - F.pow("similarity", F.lit(k)), F.lit(trees)))).alias(f"all_{k}") for k in range(floor + 1, depth + 1)]
    # A row per band and depth, so a few dozen at most.
    sums = judged.groupBy(band.alias("band"), "deepest").agg(F.count("*").alias("n"), *inverse).collect()
    for k in range(depth, floor, -1):
        met = [x for x in sums if x["deepest"] >= k]
        bands = {x["band"] for x in sums}
        if all(sum(x["n"] for x in met if x["band"] == b) >= recall * sum(x[f"all_{k}"] for x in met if x["band"] == b) and any(x["band"] == b for x in met) for b in bands):
            return k
    return floor


def _shingles(words: list[str]) -> set:
    return {tuple(words[i : i + N]) for i in range(max(1, len(words) - N + 1))} if words else set()


def _links(left: list[set], right: list[set], similarity: float) -> np.ndarray:
    """Which pairs reach the similarity, exactly. Sizes are compared as whole numbers scaled by the threshold."""
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(left) * len(right) <= 64:
        common = np.array([[len(a & b) for b in right] for a in left], float).reshape(len(left), len(right))
    else:
        count: dict = {}
        for s in left if left is right else [*left, *right]:
            for x in s:
                count[x] = count.get(x, 0) + 1
        ids = {x: i for i, x in enumerate(x for x, c in count.items() if c > 1)}
        index = [np.array(sorted(ids[x] for x in s if x in ids), np.int64) for s in left]
        other = index if left is right else [np.array(sorted(ids[x] for x in s if x in ids), np.int64) for s in right]
        common = np.zeros((len(left), len(right)), np.float32)
        width = 8192
        for a in range(0, len(ids), width):

            def dense(rows: list, a: int = a) -> np.ndarray:
                out = np.zeros((len(rows), width), np.float32)
                for i, r in enumerate(rows):
                    out[i, r[np.searchsorted(r, a) : np.searchsorted(r, a + width)] - a] = 1
                return out

            m = dense(index)
            common += m @ (m if left is right else dense(other)).T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common >= similarity * union - 1e-9


def _roots(links: np.ndarray) -> np.ndarray:
    """Least index connected to each index of a symmetric matrix."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One neighbourhood block pair after the other: links per class, and the least class it is connected to."""
    schema = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("class_links", pa.int64())])
    rows = rows_of(batches, "hood", "i", "j", "block", "cid", "copies", "text")
    for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
        members = sorted((r[3:] for r in group), key=lambda r: r[1])
        cids, copies = np.array([m[1] for m in members], np.int64), np.array([m[2] for m in members], np.int64)
        sets = [_shingles(words_of(m[3])) for m in members]
        n = len(members)
        if i == j:
            links = _links(sets, sets, similarity)
        else:
            first = np.array([m[0] == i for m in members])
            links = np.zeros((n, n), bool)
            across = _links([s for s, f in zip(sets, first, strict=True) if f], [s for s, f in zip(sets, first, strict=True) if not f], similarity)
            links[np.ix_(first, ~first)] = across
            links |= links.T
        np.fill_diagonal(links, False)
        root = cids[_roots(links)]
        yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(root), pa.array((links * copies[None, :]).sum(axis=1)), pa.array(links.sum(axis=1))], schema=schema)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, trees: int = 32, depth: int = 8, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links, key for every row of (doc_id, text).

    copy_of is the least id with the same shingles, class_id the least id of all documents connected by links, n_links
    the number of documents at or above the similarity, copies included. `key` is the digest of the shingle set.
    """
    floor = prefix_length(trees, depth, similarity, recall)
    rows = id_and_text(docs)
    signed = staged(rows.mapInArrow(partial(_labels, trees, depth), "doc_id long, key binary, labels array<long>"), "forest-labels")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    # Two classes may share an id where one id has several texts; numbers stand for (id, key).
    numbered = classes.select(F.xxhash64("cid", "key").alias("node"), "labels")
    edges = tries(numbered.select("node", F.posexplode("labels").alias("tree", "label")), floor, depth)
    kept = matched_depth(edges, numbered, trees, floor, depth, similarity, recall)
    stars = edges.select(F.col("node").alias("u"), F.col("heads")[kept - floor].alias("v")).filter("u <> v")
    hoods = components(stars)
    sizes = hoods.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = hoods.join(sizes, "component").select(F.col("component").alias("hood"), "node", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    members = classes.select("cid", "key", "copies", F.xxhash64("cid", "key").alias("node")).join(placed, "node")
    # The text of one row per class; among rows with one id the digest picks the right one.
    texts = rows.join(members.select("cid", "key", "node", "hood", "blocks", "block", "copies"), rows["doc_id"] == F.col("cid"))
    texts = _matching(texts)
    met = texts.select("hood", "block", "node", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("hood", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("cid"), "copies", "text")
    pairs = met.repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j")
    verified = staged(pairs.mapInArrow(partial(_verify, similarity), "cid long, root long, links long, class_links long"), "forest-links")
    groups = components(verified.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    per_class = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    ids = classes.select("key", "cid", "copies", F.xxhash64("cid", "key").alias("node"))
    known = ids.join(per_class.withColumnRenamed("cid", "node"), "node", "left").join(groups, "node", "left")
    named = known.select("key", "cid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("cid").alias("class_id"))
    by_key = named.join(least, "component").select("key", "class_id", F.col("cid").alias("copy_of"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    found = signed.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "key")
    alone = rows.filter(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return found.unionAll(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("key")))


def _matching(texts: DataFrame) -> DataFrame:
    """Rows whose text has the class's shingles, one per class."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            right = []
            for text, key in zip(texts_of(batch), batch.column("key").to_pylist(), strict=True):
                if len(seen) > _KEEP:
                    seen.clear()
                right.append(hashlib.blake2b(shingle_hashes(words_of(text), seen).tobytes(), digest_size=16).digest() == key)
            yield batch.filter(pa.array(right))

    columns = texts.select("hood", "blocks", "block", "node", "copies", "key", "text")
    return columns.mapInArrow(keep, columns.schema).dropDuplicates(["node"])
