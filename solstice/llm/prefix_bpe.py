"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 12).

A sequence of tokens is what BPE makes of its bytes if and only if every two neighbours, put together and encoded, come out
as those two again. So each byte prefix of a pre-token has exactly one valid last token: the one that encodes to itself and
stands well after the last token of the prefix before it. A `PrefixTable` stores it for every prefix. Dropping bytes at the
end is then free, appending goes on where the table ends, and an edit is encoded again only until as many entries in a row
as the longest token has bytes agree with the entries before the edit; the rest cannot differ.

Texts are cut into pre-tokens by the pattern, with letters, numbers and white space as the tiktoken library knows them; tasks remember the ids of pieces between spaces, and of pairs of tokens
whether they are valid. A pre-token that is itself in the ranks is that one token, as in the tiktoken library.

Null texts count as empty (no tokens); repeated rows each get their row; a null id stays null. Ids outside the ranks cannot
be decoded and raise an error; single halves of surrogate pairs cannot stand in a Spark string.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm.common import id_and_text, rows_of, texts_of
from solstice.llm.tokens import pieces_of

#: Pieces and pre-tokens a worker remembers (twice, in generations), and pairs of tokens.
_KEEP = 250_000
_PAIRS = 1_000_000
_BATCH = 500
#: Longer pieces are not worth remembering.
_LONG = 64


def ranks_of_file(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Vocabulary:
    """Ranks, the automaton that finds tokens in bytes, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.valid: dict[tuple[int, int], bool] = {}
        #: The two parts a token is merged from, where its merges happen in the order of their ranks.
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            steps: list = []
            # Tokens that merging never makes of their own bytes are no last token of any prefix.
            if self.merged(token, steps) == [i]:
                self.matcher.add_word(token.decode("latin-1"), (len(token), i))
                if steps and [r for r, _ in steps] == sorted(r for r, _ in steps):
                    self.parts[token] = steps[-1][1]
        self.matcher.make_automaton()

    @classmethod
    def of_file(cls, path: str) -> Vocabulary:
        """The vocabulary of this Python worker for a file of base64 tokens and ranks."""
        state = sys.modules.setdefault("solstice_worker_state", types.ModuleType("solstice_worker_state"))
        kept = vars(state).setdefault("vocabularies", {})
        if path not in kept:
            kept[path] = cls(ranks_of_file(path))
        return kept[path]

    def merged(self, data: bytes, steps: list | None = None) -> list[int]:
        """Ids of a few bytes by merging the pair of least rank, the leftmost first, again and again."""
        ranks, none = self.ranks, sys.maxsize
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while found and (least := min(found)) < none:
            i = found.index(least)
            if steps is not None:
                steps.append((least, (parts[i], parts[i + 1])))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found[max(0, i - 1) : i + 2] = [ranks.get(parts[k] + parts[k + 1], none) for k in (i - 1, i) if 0 <= k < len(parts) - 1]
        return [ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> list | None:
        """The last (side 0) or first (side 1) part of a token, and of that part, down to a byte: (bytes, rank of the whole it goes into)."""
        known = self.spines[side].get(token)
        if known is None:
            part, into, known = self.bytes_of[token], sys.maxsize, []
            while True:
                known.append((part, into))
                if len(part) == 1:
                    break
                if part not in self.parts:
                    return None
                part, into = self.parts[part][1 - side], self.ranks[part]
            self.spines[side][token] = known
        return known

    def goes_with(self, left: int, right: int) -> bool:
        """Whether the bytes of both, put together, encode to the two again."""
        known = self.valid.get((left, right))
        if known is None:
            if len(self.valid) >= _PAIRS:
                self.valid.clear()
            known = self.valid[left, right] = self._goes_with(left, right)
        return known

    def _goes_with(self, left: int, right: int) -> bool:
        a, b = self._spine(left, 0), self._spine(right, 1)
        if a is None or b is None:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        # The parts that meet at the seam, in the order of time; they must never merge before one of them is merged away.
        i, j, ranks = len(a) - 1, len(b) - 1, self.ranks
        while True:
            (x, x_into), (y, y_into) = a[i], b[j]
            seam = ranks.get(x + y)
            # Of equal ranks the leftmost merges first: x with what stands before it, then the seam, then y with what follows.
            if seam is not None and seam < x_into and seam <= y_into:
                return False
            if i == 0 and j == 0:
                return True
            if x_into <= y_into:
                i -= 1
            else:
                j -= 1

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self, data).ids()


class PrefixTable:
    """The last token of every prefix of a byte string: (length, id) by the prefix's last byte."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Go on from where the table ends."""
        self.data += more
        self._fill(len(self.data), None)

    def truncate(self, length: int) -> None:
        """Every prefix is there already."""
        self.data = self.data[:length]
        del self.last[length:]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in the place of data[start:end]; gives the number of entries that were worked out again."""
        old = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        self._fill(start + len(new), None)
        agreed = self._fill(len(self.data), old)
        worked = len(self.last) - start
        self.last.extend(old[agreed:])
        return worked

    def _fill(self, to: int, old: list | None) -> int:
        """Entries up to `to`; stops once enough of them in a row are as in `old`. Gives the number of entries compared."""
        last, v = self.last, self.vocabulary
        base, valid, goes_with = len(last), v.valid, v.goes_with
        if base >= to:
            return 0
        # Tokens that end here may begin up to the longest one's length before.
        back = max(0, base - v.longest + 1)
        run, at, best = 0, base - 1, None
        for i, (n, token) in v.matcher.iter(self.data[back:to].decode("latin-1")):
            i += back
            if i <= at:
                continue
            before = i - n
            if before >= 0:
                left = last[before][1]
                fits = valid.get((left, token))
                if not (goes_with(left, token) if fits is None else fits):
                    continue
            best, at = (n, token), i
            last.append(best)
            if old is not None:
                run = run + 1 if old[i - base] == best else 0
                if run >= v.longest:
                    return i - base + 1
        return to - base

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            n, token = self.last[at - 1]
            out.append(token)
            at -= n
        return out[::-1]


def odd_characters(regex) -> dict[int, str]:
    """Characters that the library's tables of letters, numbers and white space class in another way than `regex` does.

    Tables of different Unicode versions differ in new characters. A match of the library gives the bytes it holds, so a
    pattern of one class picks the characters of that class. Each odd character is given a stand-in of the library's class.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    single = {bytes([i]): i for i in range(256)}
    out: dict[int, str] = {}
    for kind, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\u2003")):
        theirs = set(bytes(tiktoken.Encoding("one class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(kind, every))
        out.update({ord(c): stand_in for c in theirs - ours})
        for c in ours - theirs:
            out.setdefault(ord(c), "!")
    return out


class TextEncoder:
    """Ids of whole texts; pieces and pre-tokens that occur again are not encoded again."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.stand_ins = odd_characters(regex)
        codes = sorted(self.stand_ins)
        firsts, lasts = [c for c in codes if c - 1 not in self.stand_ins], [c for c in codes if c + 1 not in self.stand_ins]
        self.odd = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True)) + "]") if codes else None
        #: Ids in bytes of pieces and of pre-tokens, and those of the generation before.
        self.pieces, self.words = ({}, {}), ({}, {})

    @classmethod
    def of_worker(cls, path: str, pattern: str) -> TextEncoder:
        vocabulary = Vocabulary.of_file(path)
        kept = vars(sys.modules["solstice_worker_state"]).setdefault("text_encoders", {})
        if (path, pattern) not in kept:
            kept[path, pattern] = cls(vocabulary, pattern)
        return kept[path, pattern]

    def pre_tokens(self, text: str) -> list[str]:
        if self.odd is None or text.isascii() or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def _word(self, word: str) -> bytes:
        known, older = self.words
        value = known.get(word)
        if value is None:
            value = older.get(word)
            if value is None:
                value = array("I", self.vocabulary.encode(word.encode("utf-8"))).tobytes()
            if len(word) <= _LONG:
                if len(known) >= _KEEP:
                    self.words = known, _ = {}, known
                known[word] = value
        return value

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        pieces = pieces_of(text)
        found = list(map(self.pieces[0].get, pieces))
        if None in found:
            known, older = self.pieces
            for i, piece in enumerate(pieces):
                if found[i] is None:
                    value = known.get(piece) or older.get(piece)
                    if value is None:
                        value = b"".join(map(self._word, self.pre_tokens(piece)))
                    if len(piece) <= _LONG:
                        if len(known) >= _KEEP:
                            self.pieces = known, older = {}, known
                        known[piece] = value
                    found[i] = value
        return b"".join(found)


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = TextEncoder.of_worker(path, pattern)
    for batch in batches:
        for i in range(0, batch.num_rows, _BATCH):
            part = batch.slice(i, _BATCH)
            ids = [encoder.encode(t) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_encode, path, pattern), "doc_id long, n_tokens long, ids binary")


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bytes_of = {i: token for token, i in ranks_of_file(path).items()}.__getitem__
    for batch in batches:
        for i in range(0, batch.num_rows, _BATCH):
            part = batch.slice(i, _BATCH)
            data = [b"".join(map(bytes_of, np.frombuffer(ids or b"", "<u4").tolist())) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), part.column("ids"), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with their bytes in `decoded`."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(partial(_decode, path), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def spliced(encoder: TextEncoder, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
    """Text and ids after text[start:end] became `new`; only the stretch between two spaces the edit cannot reach is encoded.

    A space between two other characters always starts a pre-token, so the ids before and after the stretch stay as they are.
    """
    start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
    end = max(start, end)

    def safe(p: int) -> bool:
        return text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()

    low = start - 2
    while low > 0 and not safe(low):
        low -= 1
    low = max(low, 0)
    high = end + 1
    while high < len(text) - 1 and not safe(high):
        high += 1
    high = high if high < len(text) - 1 else len(text)
    numbers = np.frombuffer(ids, "<u4")
    ends = np.cumsum([0, *map(len, map(encoder.vocabulary.bytes_of.__getitem__, numbers.tolist()))])
    a = int(np.searchsorted(ends, len(text[:low].encode())))
    b = int(np.searchsorted(ends, len(text[:high].encode())))
    changed = text[:start] + new + text[end:]
    return changed, ids[: 4 * a] + encoder.encode(changed[low : high + len(changed) - len(text)]) + ids[4 * b :]


def _edit(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = TextEncoder.of_worker(path, pattern)
    for doc_id, text, ids, edits in rows_of(batches, "doc_id", "text", "ids", "edits"):
        text, ids = text or "", ids or b""
        for e in edits or []:
            text, ids = spliced(encoder, text, ids, e["start"] or 0, e["end"] or 0, e["new"] or "")
        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([text]), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], ["doc_id", "text", "n_tokens", "ids"])


def edit(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Apply edits, array<struct<start:int,end:int,new:string>> in order, to (doc_id, text, ids, edits): the new text and ids.

    Positions are characters of the text as the edits before leave it; positions outside it mean its ends.
    """
    kind = "array<struct<start:int,end:int,new:string>>"
    picked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "ids", F.col("edits").cast(kind).alias("edits"))
    return picked.mapInArrow(partial(_edit, path, pattern), "doc_id long, text string, n_tokens long, ids binary")
