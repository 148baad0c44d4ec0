"""Quality rules by distribution divergence (operator 1).

Every language gets a reference: the distribution of character classes, and of its most frequent words, over all its
documents. A document whose own histogram lies too far away (Jensen-Shannon distance, base 2, between 0 and 1) is
rejected. Guards: short documents have noisy histograms and are not judged, nor are documents of a language with fewer than
`min_language` words, whatever the size of the others. A reference takes some 6 KB; every task holds those of all languages.

The base rules (length, repeated word windows) come first. Null texts have no words; a null language is a language of
its own; repeated rows each get their row; a null id stays null.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solstice.llm.common import staged, texts_of

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "punctuation", "symbol", "other")
_BY_CATEGORY = {"Ll": 0, "Lu": 1, "L": 2, "M": 3, "N": 4, "Z": 5, "P": 6, "S": 7}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters that str.split() cuts at and the word pattern does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_BLANK = " \t\n\x0b\x0c\r"
_WINDOW = 8
_FLUSH = 400_000
_table = np.zeros(0, np.uint8)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def class_counts(text: str) -> np.ndarray:
    global _table
    if not len(_table):
        kinds = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
        _table = np.array([5 if chr(c) in _BLANK else _BY_CATEGORY.get(k, _BY_CATEGORY.get(k[0], 8)) for c, k in enumerate(kinds)], np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_table[codes], minlength=len(CLASSES))


def repeated_words(words: list[str]) -> int:
    """Words inside windows of eight that occur at least twice."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(_WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Only windows whose hash occurs twice can repeat; those are compared as they are.
    twice = np.isin(rolled, order[1:][order[1:] == order[:-1]]).nonzero()[0].tolist()
    windows = [tuple(words[i : i + _WINDOW]) for i in twice]
    seen = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(twice, windows, strict=True):
        if seen[w] > 1:
            marks[i] += 1
            marks[i + _WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def base_figures(text: str, words: list[str]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = repeated_words(words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(words) < 20 or 100 * repeated > 30 * len(words)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): character classes and words of a task's documents, added up."""
    classes: dict = {}
    words: dict = {}

    def rows() -> pa.RecordBatch:
        out = [(lang, "class", CLASSES[i], int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
        out += [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
        out += [(lang, "total", "", sum(c.values())) for lang, c in words.items()]
        classes.clear()
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            classes[lang] = classes.get(lang, 0) + class_counts(text)
            words.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, words.values())) > _FLUSH:
            yield rows()
    if words:
        yield rows()


def references(docs: DataFrame, top: int = 64, min_language: int = 1000) -> dict:
    """Per language (class distribution, top words, their distribution and the rest)."""
    tallies = docs.select("lang", "text").mapInArrow(_tally, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    best = staged(tallies.withColumn("rank", rank).filter(F.col("rank") <= max(top, len(CLASSES))), "language-references")
    sizes = {r["lang"]: r["n"] for r in best.filter((F.col("kind") == "total") & (F.col("n") >= min_language)).collect()}
    out: dict = {lang: ({}, {}) for lang in sizes}
    known = F.col("lang").isin([x for x in sizes if x is not None]) | (F.col("lang").isNull() if None in sizes else F.lit(False))
    for r in best.filter(known & (F.col("kind") != "total") & ((F.col("kind") == "class") | (F.col("rank") <= top))).orderBy("lang", "kind", "rank").collect():
        out[r["lang"]][r["kind"] == "word"][r["key"]] = r["n"]
    made = {}
    for lang, (classes, words) in out.items():
        c = np.array([classes.get(k, 0) for k in CLASSES], float)
        w = np.array([*words.values(), sizes[lang] - sum(words.values())], float)
        made[lang] = (c / c.sum(), {k: i for i, k in enumerate(words)}, w / w.sum())
    return made


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(p * np.log2(p / m)) + np.nansum(q * np.log2(q / m))
    return float(np.sqrt(max(d, 0) / 2))


def _judge(refs: dict, class_limit: float, word_limit: float, min_chars: int, min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            words = words_of(text)
            base = base_figures(text, words)
            by_class = by_word = None
            if ref := refs.get(lang):
                if base[1] >= min_chars:
                    c = class_counts(text)
                    by_class = round(js_distance(c / c.sum(), ref[0]), 9)
                if len(words) >= min_words:
                    w = np.bincount(np.fromiter(map(ref[1].get, words, repeat(len(ref[1]))), np.int64, len(words)), minlength=len(ref[2]))
                    by_word = round(js_distance(w / len(words), ref[2]), 9)
            kept = not base[5] and not (by_class is not None and by_class > class_limit) and not (by_word is not None and by_word > word_limit)
            rows.append((*base, by_class, by_word, kept))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])


def judge(docs: DataFrame, class_limit: float = 0.25, word_limit: float = 0.45, min_chars: int = 200, min_words: int = 60, top: int = 64, min_language: int = 1000) -> DataFrame:
    """doc_id, the base figures, base_failed, both distances (null where guarded) and kept, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    refs = references(rows, top, min_language)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return rows.mapInArrow(partial(_judge, refs, class_limit, word_limit, min_chars, min_words), schema)
