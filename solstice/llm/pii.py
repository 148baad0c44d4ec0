"""Personal data with offset-preserving deobfuscation (operator 10).

Base spans (e-mail, IPv4, card, phone) are found in the text as it stands. Then a chain of small transducers rewrites
a copy: homoglyphs and full-width forms to ASCII, invisible characters to nothing, spelled digits to digits, and
at/dot disguises to `@` and `.`. Every rewritten character keeps the source range it came from, so what is found in
the copy is reported in offsets of the source. Such a span is added if it holds a rewritten character and is not part
of a base span of its kind (it may hold one and reach further); base spans always stay.

All scans are linear in the text, however long a run of digits or letters. Offsets are code points, end exclusive.
Null texts count as empty; repeated rows each get their row; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield 0, start, domain.end()
            last = domain.end()
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            width = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield 1, at, at + width
            at += width + 1


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += _addresses(text)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m.group())) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
_INVISIBLE = "­​‌‍⁠﻿"
_DISGUISED = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + _INVISIBLE + "！-～  - 　٠-٩۰-۹०-९①-⑨\U0001d400-\U0001d7ff]")

_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NUMBER = "(?:" + "|".join(_WORDS) + ")"
_GAP = r"[\s,-]{1,3}"
_RUN = re.compile(rf"(?i)\b{_NUMBER}(?:{_GAP}{_NUMBER})*+\b")
_LONG_RUN = re.compile(rf"{_NUMBER}(?:{_GAP}{_NUMBER}){{3}}")
_PLUS = re.compile(r"(?i)\bplus\s{1,3}(?=[0-9])")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOT = re.compile(rf"(?i)(?<=[a-z0-9-])(?:{_OPEN}(?:dot|punto|punkt|point|\.){_CLOSE}|\s{{1,3}}(?:dot|punto)\s{{1,3}}|&#46;|&period;|%2e)(?=[a-z0-9])")
_AT = re.compile(rf"(?i)(?<=[a-z0-9._%+-])(?:{_OPEN}(?:at|arroba|@){_CLOSE}|&#64;|&commat;|%40)(?=[a-z0-9])")
_BARE_HOST = re.compile(r"[0-9][a-z0-9._%+-]{0,63} (?:at|arroba) ")
_BARE_AT = re.compile(r"(?i)\s(?:at|arroba)\s")
_HINTS = ("dot", "punto", "punkt", "point", ".]", ".)", ".}", ".>", "at]", "at)", "at}", "at>", "arroba", "@]", "@)", "@}", ". ]", ". )", "at ]", "at )", "&#64;", "&#46;", "&commat;", "&period;", "%40", "%2e")
#: A word with letters and digits, then a bare "at" and a host: hardly prose.
_NUMBERED_AT = re.compile(r"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]{0,63}[A-Za-z])(?=[A-Za-z0-9._%+-]{0,63}[0-9])[A-Za-z0-9._%+-]{2,64}( (?:at|AT|arroba) )(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b)")


class Mapped:
    """A text whose characters know the source range they came from, and whether they were rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ascending, disjoint ranges; all characters of a replacement stand for the whole range."""
        if not edits:
            return
        texts, kept, last = [], [], 0
        for a, b, put in edits:
            texts += [self.text[last:a], put]
            kept.append((self.start[last:a], self.end[last:a], self.new[last:a]))
            n = len(put)
            kept.append((np.full(n, self.start[a]), np.full(n, self.end[b - 1]), np.ones(n, bool)))
            last = b
        texts.append(self.text[last:])
        kept.append((self.start[last:], self.end[last:], self.new[last:]))
        self.text = "".join(texts)
        self.start, self.end, self.new = (np.concatenate(x) for x in zip(*kept, strict=True))


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    d = unicodedata.digit(c, None)
    folded = unicodedata.normalize("NFKC", c) if d is None else str(d)
    return folded if folded.isascii() else c


def normalised(text: str) -> Mapped | None:
    """The rewritten copy, or None where nothing is disguised."""
    lower = text.lower() if len(text.lower()) == len(text) else text
    odd = not text.isascii() and _DISGUISED.search(text)
    hinted, spelled = any(h in lower for h in _HINTS) and (_DOT.search(text) or _AT.search(text)), _LONG_RUN.search(lower)
    numbered = _BARE_HOST.search(lower) and _NUMBERED_AT.search(text)
    if not (odd or hinted or spelled or numbered):
        return None
    m = Mapped(text)
    if odd:
        m.rewrite([(x.start(), x.end(), put) for x in _DISGUISED.finditer(text) if (put := _plain(x.group())) != x.group()])
    runs = []
    for x in _RUN.finditer(m.text):
        words = re.findall("[a-z]+", x.group().lower())
        before, after = m.text[max(0, x.start() - 12) : x.start()].lower(), m.text[x.end() : x.end() + 12].lower()
        if len(words) >= 4 or re.search(r"(?:dot|plus|\.[\])}>]|\b[0-9]+)\W{0,6}$", before) or re.match(r"\W{1,6}dot|\W{0,3}[\[({<]\W{0,3}\.", after):
            runs.append((x.start(), x.end(), "".join(_WORDS[w] for w in words)))
    m.rewrite(runs)
    m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])
    # A bare "at" counts where a disguised dot follows in the next word, or a number stands in the word before it:
    # "look at example.com" is plain prose.
    dots = [(x.start(), x.end(), ".") for x in _DOT.finditer(m.text)]
    ats = [(x.start(), x.end(), "@") for x in _AT.finditer(m.text)]
    ats += [(*x.span(1), "@") for x in _NUMBERED_AT.finditer(m.text)]
    words_before_dot = {}
    for a, _, _ in dots:
        s = a
        while s > 0 and a - s < 64 and (m.text[s - 1].isalnum() or m.text[s - 1] == "-"):
            s -= 1
        words_before_dot[s] = a
    for x in _BARE_AT.finditer(m.text):
        if x.end() in words_before_dot and x.start() > 0 and _LOCAL_END.match(m.text, x.start() - 1):
            ats.append((x.start(), x.end(), "@"))
    edits, last = [], -1
    for edit in sorted(dots + ats):
        if edit[0] >= last:
            edits.append(edit)
            last = edit[1]
    m.rewrite(edits)
    return m if m.new.any() or len(m.text) != len(text) else None


def added_spans(text: str, base: list[Span]) -> list[Span]:
    m = normalised(text)
    if m is None:
        return []
    gone = np.concatenate([[False], m.start[1:] != m.end[:-1]]) if len(m.text) else m.new
    out = []
    for kind, a, b in base_spans(m.text):
        if not (m.new[a:b].any() or gone[a + 1 : b].any()):
            continue
        if kind == 0 and not re.search(r"\.[A-Za-z]{2,24}$", m.text[a:b]):
            continue
        span = (kind, int(m.start[a]), int(m.end[b - 1]))
        if not any(k == kind and s < span[2] and span[1] < e and not (span[1] <= s and e <= span[2] and e - s < span[2] - span[1]) for k, s, e in base):
            out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or group of overlapping spans, replaced by the name of its first kind."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[kind].upper()}>"]
            last = b
        elif b > last:
            last = b
    return "".join([*out, text[last:]])


_FOUND = "doc_id long, base array<struct<kind:int,start:long,end:long>>, added array<struct<kind:int,start:long,end:long>>, base_sha256 string, spans string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda xs: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs]
    for batch in batches:
        base, added = [], []
        for text in texts_of(batch):
            base.append(base_spans(text))
            added.append(added_spans(text, base[-1]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(named(base), spans),
                pa.array(named(added), spans),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                pa.array([joined(b + a) for b, a in zip(base, added, strict=True)]),
            ],
            ["doc_id", "base", "added", "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans, the digest of the base spans, and all spans as text."""
    return id_and_text(docs).mapInArrow(_find, _FOUND)


def counts(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, spans, n_added."""
    of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *map(of, range(4)), "base_sha256", "spans", F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind; the length column follows."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            new = [t if t is None or not (s := (b := base_spans(t)) + added_spans(t, b)) else redacted(t, s) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col in columns:
                old = columns[length_col].to_pylist()
                columns[length_col] = pa.array([o if n is t else len(n) for o, n, t in zip(old, new, texts, strict=True)], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(clean, docs.schema)
