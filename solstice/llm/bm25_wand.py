"""Benchmark decontamination by a BM25 index of test items with block-max WAND (operator 7).

Test items are cut into units of at most `unit` words and indexed with BM25 impacts, each divided by the unit's score
against itself, so one threshold serves all. Every stretch of `passage` words of every document is a query. Three steps
find all units above the threshold:

1. Every unit has a signature: its terms of few units, and as many more, rarest first, as it takes until the rest weighs
   less than the threshold. A stretch can only reach the threshold if it holds a term of the signature and its signature
   terms reach the threshold less the weight of the rest. This bound is computed for all stretches at once.
2. Around what passes, block-max WAND, which skips whole blocks of postings by their greatest impact, finds the units that
   can reach the threshold; their score is the best over all stretches there, before and after the signature term.
3. A document and item are reported if enough of the word trigrams of the item's question, and of its answer, stand in
   the document. Where an item has no answer, they need to stand there for one stretch of two units of the item only (for
   all of it if it is shorter), so a long passage of a longer item is enough; answer_overlap is null then.

Items of equal text are one: they are indexed and counted once, and named by all their ids at the end. Document
frequencies and mean length are over all units. The index is searched in shards of `shard_units` units, each
held by every task; a larger benchmark takes more passes over the documents, not more memory.

Words are compared in lower case without leading and trailing punctuation. Null or empty documents and items match
nothing. Repeated documents are each reported; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, rows_of, staged, texts_of

K1, B = 1.2, 0.75
_BLOCK = 16
#: Words a task remembers, some 80 MB.
_KEEP = 500_000
#: Postings looked at at a time.
_POSTINGS = 4_000_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    return _EDGE.sub("", word)


def plain_words(text: str) -> list[str]:
    return [p for w in text.lower().split() if (p := plain(w))]


def _units(unit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, unit, size, term, tf): every item in nearly equal units."""
    for item, text in rows_of(batches, "doc_id", "text"):
        words = plain_words(text or "")
        parts = -(-len(words) // unit)
        for i in range(parts):
            mine = words[i * len(words) // parts : (i + 1) * len(words) // parts]
            terms = sorted(set(mine))
            n = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([len(mine)] * n, pa.int64()), pa.array(terms, pa.string()), pa.array([mine.count(t) for t in terms], pa.int64())], ["item_id", "unit", "size", "term", "tf"])


def postings(items: DataFrame, unit: int, shard_units: int) -> tuple[DataFrame, int]:
    """(shard, item_id, unit, term, df, weight), and the number of shards; the weights of a unit sum to 1."""
    terms = staged(id_and_text(items, "item_id").mapInArrow(partial(_units, unit), "item_id long, unit int, size long, term string, tf long").distinct(), "test-units")
    n, mean = terms.select("item_id", "unit", "size").distinct().agg(F.count("*"), F.avg("size")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (mean or 1)))
    scored = terms.join(df, "term").withColumn("impact", impact)
    own = scored.groupBy("item_id", "unit").agg(F.sum("impact").alias("own"))
    shards = max(1, -(-n // shard_units))
    shard = F.pmod(F.xxhash64("item_id", "unit"), F.lit(shards))
    return staged(scored.join(own, ["item_id", "unit"]).select(shard.alias("shard"), "item_id", "unit", "term", "df", (F.col("impact") / F.col("own")).alias("weight")), "test-postings"), shards


class Index:
    """Impact-ordered lists of one shard."""

    def __init__(self, rows: pa.Table, rare_share: float, threshold: float = 0.6):
        units = sorted(set(zip(rows["item_id"].to_pylist(), rows["unit"].to_pylist(), strict=True)))
        number = {u: i for i, u in enumerate(units)}
        self.items = np.array([u[0] for u in units], np.int64)
        lists: dict = {}
        for item, unit, term, df, w in zip(*(rows[c].to_pylist() for c in ("item_id", "unit", "term", "df", "weight")), strict=True):
            lists.setdefault(term, (df, []))[1].append((number[item, unit], w))
        self.terms = {t: i for i, t in enumerate(sorted(lists))}
        self.docs, self.weights, self.tops, self.block_tops = [], [], [], []
        limit = max(2, rare_share * len(units))
        for term in self.terms:
            entries = sorted(lists[term][1])
            d, w = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
            self.docs.append(d)
            self.weights.append(w)
            self.tops.append(w.max())
            self.block_tops.append([w[i : i + _BLOCK].max() for i in range(0, len(w), _BLOCK)])
        # Postings by unit, rarest term first, with the weight of all that follow.
        sizes = np.array([len(d) for d in self.docs], np.int64)
        flat_term, join = np.repeat(np.arange(len(sizes)), sizes), lambda xs: np.concatenate([*xs, np.zeros(0)])
        flat_unit, flat_weight = join(self.docs).astype(np.int64), join(self.weights)
        self.by_unit = np.lexsort((flat_term, sizes[flat_term], flat_unit))
        u, w = flat_unit[self.by_unit], flat_weight[self.by_unit]
        self.unit_terms, self.unit_weights = flat_term[self.by_unit], w
        self.unit_first = np.searchsorted(u, np.arange(len(units) + 1))
        behind = np.concatenate([np.cumsum(w[::-1])[::-1], [0]])
        left = behind[:-1] - behind[self.unit_first[u + 1]] if len(u) else behind[:-1]
        # A term joins the signature while what starts with it could reach the threshold by itself.
        chosen = (sizes[self.unit_terms] <= limit) | (left >= threshold - 1e-6)
        self.common = np.bincount(u[~chosen], w[~chosen], minlength=len(units))
        rare = np.zeros(len(u), bool)
        rare[self.by_unit] = chosen
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat_term[rare], minlength=len(sizes)))]).astype(np.int64)
        self.rare_docs, self.rare_weights = flat_unit[rare], flat_weight[rare]
        del self.by_unit

    def best(self, unit: int, words: np.ndarray, passage: int) -> float:
        """The greatest weight of a unit's distinct terms in any stretch of the words."""
        a, b = self.unit_first[unit], self.unit_first[unit + 1]
        weights = dict(zip(self.unit_terms[a:b].tolist(), self.unit_weights[a:b].tolist(), strict=True))
        held: dict = {}
        total = best = 0.0
        words = words.tolist()
        for i, t in enumerate(words):
            if t in weights:
                held[t] = held.get(t, 0) + 1
                total += weights[t] if held[t] == 1 else 0
            if i >= passage and (old := words[i - passage]) in weights:
                held[old] -= 1
                total -= 0 if held[old] else weights[old]
            best = max(best, total)
        return best

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all units whose weights over the distinct terms reach the threshold."""
        out = []
        lists = [[0, t] for t in terms]
        current = lambda x: self.docs[x[1]][x[0]]
        lists = [x for x in lists if len(self.docs[x[1]])]
        while lists:
            lists.sort(key=current)
            bound, pivot = 0.0, None
            for i, x in enumerate(lists):
                bound += self.tops[x[1]]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            doc = current(lists[pivot])
            while pivot + 1 < len(lists) and current(lists[pivot + 1]) == doc:
                pivot += 1
            # The block each list would be in at the pivot document.
            ends, tops = [], 0.0
            for x in lists[: pivot + 1]:
                docs = self.docs[x[1]]
                at = x[0] // _BLOCK
                while at + 1 < len(self.block_tops[x[1]]) and docs[min((at + 1) * _BLOCK, len(docs)) - 1] < doc:
                    at += 1
                tops += self.block_tops[x[1]][at]
                ends.append(docs[min((at + 1) * _BLOCK, len(docs)) - 1])
            if tops >= threshold - 1e-9:
                if current(lists[0]) == doc:
                    score = sum(self.weights[x[1]][x[0]] for x in lists[: pivot + 1])
                    if score >= threshold - 1e-9:
                        out.append((int(doc), float(score)))
                    target = doc + 1
                else:
                    target = doc
            else:
                # No document up to the nearest block end can reach the threshold.
                target = max(doc + 1, min(ends) + 1)
                if pivot + 1 < len(lists):
                    target = min(target, max(doc + 1, current(lists[pivot + 1])))
            for x in lists[: pivot + 1]:
                x[0] = max(x[0], int(np.searchsorted(self.docs[x[1]], target)))
            lists = [x for x in lists if x[0] < len(self.docs[x[1]])]
        return out


def _grams(words: list[str], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _overlap(part: list[str], words: list[str], known: dict) -> float:
    n = min(3, len(part))
    if n not in known:
        known[n] = _grams(words, n)
    grams = _grams(part, n)
    return len(grams & known[n]) / len(grams) if grams else 1.0


def _stretch_overlap(item: list[str], words: list[str], known: dict, stretch: int) -> float:
    """The greatest share of trigrams that stand in the document, over stretches of that many words of the item."""
    n = min(3, len(item))
    if n not in known:
        known[n] = _grams(words, n)
    held = np.concatenate([[0], np.cumsum([tuple(item[i : i + n]) in known[n] for i in range(len(item) - n + 1)])])
    width = min(len(held) - 1, max(1, stretch - n + 1))
    return float((held[width:] - held[:-width]).max() / width)


def _distinct(terms: np.ndarray, weights: np.ndarray) -> float:
    return sum(dict(zip(terms.tolist(), weights.tolist(), strict=True)).values())


_FOUND = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("text_key", pa.binary())]


def _segments(t: np.ndarray, size: np.ndarray, passage: int) -> list[np.ndarray]:
    """A document in parts of bounded postings, overlapping so that every stretch lies in one."""
    cost, out, a = np.cumsum(size[t]), [], 0
    while True:
        spent = cost[a - 1] if a else 0
        b = max(int(np.searchsorted(cost, spent + _POSTINGS, "right")), a + 2 * passage)
        out.append(t[a:b])
        if b >= len(t):
            return out
        a = b - passage + 1


def _portions(parts: list[tuple[int, np.ndarray]], size: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
    some, spent = [], 0
    for row, t in parts:
        cost = int(size[t].sum())
        if some and spent + cost > _POSTINGS:
            yield some
            some, spent = [], 0
        some.append((row, t))
        spent += cost
    if some:
        yield some


def _find(index: Index, parts: list[tuple[int, np.ndarray]], size: np.ndarray, begin: np.ndarray, passage: int, threshold: float, found: dict) -> None:
    """Put the best score of every row and item that reaches the threshold into `found`."""
    unknown = len(index.terms)
    lengths = np.array([len(t) for _, t in parts])
    starts = np.cumsum(lengths + passage) - lengths - passage
    t = np.concatenate([t for _, t in parts])
    pos = np.arange(len(t)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    stride = int(lengths.sum()) + passage * (len(parts) + 1)
    hit = size[t] > 0
    t, pos = t[hit], pos[hit]
    n = size[t]
    flat = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    unit, weight = index.rare_docs[flat], index.rare_weights[flat]
    key = unit * stride + np.repeat(pos, n)
    order = np.argsort(key)
    key, unit, weight, term = key[order], unit[order], weight[order], np.repeat(t, n)[order]
    total, end = np.concatenate([[0], np.cumsum(weight)]), np.searchsorted(key, key + passage)
    likely = (total[end] - total[:-1] + index.common[unit] >= threshold - 1e-6).nonzero()[0]
    # The running sum counts a repeated term each time; what is left is summed over distinct terms.
    at_hit = sorted({int(key[i] % stride) for i in likely if _distinct(term[i : end[i]], weight[i : end[i]]) + index.common[unit[i]] >= threshold - 1e-6})
    k = 0
    while k < len(at_hit):
        # Hits near each other are searched together.
        first = last = at_hit[k]
        p = int(np.searchsorted(starts, first, "right")) - 1
        while k < len(at_hit) and at_hit[k] < min(first + passage, starts[p] + lengths[p]):
            last = at_hit[k]
            k += 1
        row, whole = parts[p]
        local = whole[max(0, first - starts[p] - passage + 1) : last - starts[p] + passage]
        for u, _ in index.above(np.unique(local[local < unknown]).tolist(), threshold):
            score = index.best(u, local, passage)
            if score >= threshold - 1e-9:
                name = (row, int(index.items[u]))
                found[name] = max(found.get(name, 0.0), score)


def _search(index: Index, parts: dict, passage: int, threshold: float, overlap: float, stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    unknown = len(index.terms)
    size = np.append(index.first[1:] - index.first[:-1], 0)
    begin = np.append(index.first[:-1], 0)

    def number(word: str) -> int:
        p = plain(word.lower())
        n = memo[word] = index.terms.get(p, unknown) if p else -1
        return n

    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            if len(memo) > _KEEP:
                memo.clear()
            texts, parts_of = texts_of(batch), []
            for row, text in enumerate(texts):
                get = memo.get
                t = np.array([number(w) if n is None else n for w, n in ((w, get(w)) for w in text.split())], np.int64)
                parts_of += [(row, part) for part in _segments(t[t >= 0], size, passage)]
            found: dict = {}
            for some in _portions(parts_of, size):
                _find(index, some, size, begin, passage, threshold, found)
            rows, words, known = [], {}, {}
            doc_ids = batch.column("doc_id").to_pylist()
            for (row, item), score in sorted(found.items()):
                if row not in words:
                    words[row], known[row] = plain_words(texts[row]), {}
                question, answer = parts[item]
                if answer is None:
                    q, ans = _stretch_overlap(question, words[row], known[row], stretch), None
                else:
                    q, ans = _overlap(question, words[row], known[row]), _overlap(answer, words[row], known[row])
                if q >= overlap and (ans is None or ans >= overlap):
                    rows.append((doc_ids[row], item, round(score, 6), round(q, 6), None if ans is None else round(ans, 6), hashlib.blake2b(texts[row].encode(), digest_size=16).digest()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND, strict=True)], [x for x, _ in _FOUND])


def question_and_answer(text: str, answer: str | None) -> tuple[list[str], list[str] | None]:
    return plain_words(text), plain_words(answer) if answer else None


def contaminated(docs: DataFrame, items: DataFrame, answer_col: str | None = None, unit: int = 40, passage: int = 50, threshold: float = 0.6, overlap: float = 0.6, shard_units: int = 20_000, rare_share: float = 0.1) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap (null without an answer) of every document and test item that match.

    `docs` is (doc_id, text), `items` (item_id, text) and maybe answers. score is the best share of a unit's BM25 weight
    that a stretch of the document reaches.
    """
    if passage < unit:
        raise ValueError("a passage must hold a unit")
    rows, spark = id_and_text(docs), docs.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("name"), F.col("text").cast("string").alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer")).filter("text is not null")
    # A hash of text and answer stands for an item; ids may repeat it.
    named = staged(named.withColumn("doc_id", F.xxhash64("text", F.col("answer").isNull(), "answer")), "test-items")
    texts = named.select("doc_id", "text", "answer").dropDuplicates(["doc_id"])
    entries, shards = postings(texts.select(F.col("doc_id").alias("item_id"), "text"), unit, shard_units)
    names = named.select(F.col("doc_id").alias("said"), "name").distinct()
    out = None
    for s in range(shards):
        mine = entries.filter(F.col("shard") == s)
        index = Index(mine.drop("shard").toArrow(), rare_share, threshold)
        wanted = texts.join(mine.select(F.col("item_id").alias("doc_id")).distinct(), "doc_id", "left_semi").collect()
        parts = {r["doc_id"]: question_and_answer(r["text"], r["answer"]) for r in wanted}
        held = spark.sparkContext.broadcast((vars(index), parts))

        def search(batches: Iterator[pa.RecordBatch], held: object = held) -> Iterator[pa.RecordBatch]:
            state, parts = held.value
            index = Index.__new__(Index)
            vars(index).update(state)
            return _search(index, parts, passage, threshold, overlap, 2 * unit, batches)

        found = rows.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, text_key binary").withColumn("shard", F.lit(s))
        out = found if out is None else out.unionAll(found)
    # An item's units may lie in several shards. Repeated rows are told by their number, which is the same in each of them.
    figures = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    out = out.groupBy("doc_id", "text_key", "item_id", "shard").agg(F.count("*").alias("rows"), *figures)
    out = out.groupBy("doc_id", "text_key", "item_id").agg(F.max("rows").alias("rows"), *figures)
    out = out.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")
    return out.join(names, F.col("item_id") == F.col("said")).select("doc_id", F.col("name").alias("item_id"), "score", "question_overlap", "answer_overlap")
