"""Cached subword encoding inside a task.

A single space between two characters that are not white space always starts a new pre-token of a
byte-level BPE, whatever surrounds it: letters, numbers and symbols never run over a space, white-space
runs need two neighbours, and no special string holds a space. So a text may be cut there, each piece
encoded on its own, and pieces that occur again need no encoding. Every id comes from the library.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the plain space and the line feed.
_OTHER_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces longer than this are not worth remembering.
_LONG = 200
#: Words that the library is given as one text.
_JOINED = 1000
#: Bytes of words that `WordIds` remembers, besides those of its last texts.
_REMEMBERED = 3 << 24
#: How a byte-level vocabulary writes a space.
_SPACE = "\u0120"


def _plain(text: str) -> bool:
    """Whether every space stands between characters that are not white space, as far as a quick look can tell."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
        return False
    return not any(c in text for c in _OTHER_ASCII) if text.isascii() else not _OTHER_SPACE.search(text)


def pieces_of(text: str) -> list[str]:
    """Cut before every space that has no white space beside it. The pieces put together give the text."""
    if _plain(text):
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]
    at = [0, *(m.start() for m in _SAFE_SPACE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class PieceEncoder:
    """Ids or counts of texts by the tokenizers library, remembering pieces up to a fixed number."""

    def __init__(self, path: str, counts: bool, keep: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        #: Pieces as they stand, and pieces after a space, without it; and those of the generation before.
        self.keep, self.bare, self.spaced = keep, ({}, {}), ({}, {})
        self.value = len if counts else (lambda e: array("I", e.ids).tobytes())

    @classmethod
    def of_worker(cls, path: str, counts: bool) -> PieceEncoder:
        """The encoder of this Python worker; what it remembers outlives a task."""
        state = sys.modules.setdefault("solstice_worker_state", types.ModuleType("solstice_worker_state"))
        kept = vars(state).setdefault("encoders", {})
        if (path, counts) not in kept:
            kept[path, counts] = cls(path, counts)
        return kept[path, counts]

    def _learn(self, known: dict, older: dict, misses: set, before: str) -> dict:
        new = {p: older[p] for p in misses if p in older}
        order = [p for p in misses if p not in new]
        new.update(zip(order, map(self.value, self.library.encode_batch_fast([before + p for p in order], add_special_tokens=False)), strict=True))
        known.update((k, v) for k, v in new.items() if len(k) <= _LONG)
        return new

    def encode(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces: counts, or ids as 32-bit integers in bytes."""
        if 2 * (len(self.bare[0]) + len(self.spaced[0])) > self.keep:
            self.bare, self.spaced = ({}, self.bare[0]), ({}, self.spaced[0])
        heads, tails = [], []
        for text in texts:
            if _plain(text):
                first, *rest = text.split(" ")
                heads.append([first])
                tails.append(rest)
            else:
                heads.append(pieces_of(text))
                tails.append([])
        out = []
        for (known, older), before, cut in ((self.bare, "", heads), (self.spaced, " ", tails)):
            get = known.get
            found = [list(map(get, p)) for p in cut]
            missing = [i for i, v in enumerate(found) if None in v]
            if missing:
                new = self._learn(known, older, {p for i in missing for p, v in zip(cut[i], found[i], strict=True) if v is None}, before)
                for i in missing:
                    found[i] = [new[p] if v is None else v for p, v in zip(cut[i], found[i], strict=True)]
            out.append(found)
        return [a + b for a, b in zip(*out, strict=True)]

    def boundaries(self, text: str) -> list[tuple[int, int]]:
        """(start, number of ids before it) of the pre-tokens that start a piece, or lie inside a long piece."""
        out, at, before = [], 0, 0
        pieces = pieces_of(text)
        for piece, n in zip(pieces, self.encode([text])[0], strict=True):
            if len(piece) <= _LONG:
                out.append((at, before))
            else:
                e = self.library.encode(piece, add_special_tokens=False)
                last = object()
                for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
                    if word != last or word is None:
                        out.append((at + start, before + i))
                    last = word
            at, before = at + len(piece), before + n
        return out


class WordIds:
    """Ids of many texts at once. Arrow cuts texts at their spaces and tells equal words, and unknown words are encoded many at a time.

    Words, their ids and where these begin are plain arrays. Texts that may not be cut at every space, and what stands before the
    first space of a text, go through a `PieceEncoder`.
    """

    def __init__(self, path: str):
        self.pieces = PieceEncoder(path, counts=False, keep=100_000)
        vocabulary = self.pieces.library.get_vocab(with_added_tokens=True)
        #: Whether an id begins with a space.
        self.spaces = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.spaces[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self._forget()

    @classmethod
    def of_worker(cls, path: str) -> WordIds:
        """The one of this Python worker; what it remembers outlives a task."""
        state = sys.modules.setdefault("solstice_worker_state", types.ModuleType("solstice_worker_state"))
        kept = vars(state).setdefault("word_ids", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _forget(self) -> None:
        self.words, self.sizes, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: In how many calls a word was met.
        self.met = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keep the words met most often, up to half of those remembered; what was met once is forgotten first."""
        least = max(2, int(np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]) + 1)
        kept = self.met >= least
        self.pool = self.pool[np.repeat(kept, self.sizes)]
        self.words, self.sizes, self.met = self.words.filter(pa.array(kept)), self.sizes[kept], self.met[kept] // 2 + 1

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.pieces.library.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a space, and how many each has: one text, cut before every id that begins with a space."""
        joined = " ".join(words)
        if _plain(joined) and not joined[:1].isspace():
            ids = np.array(self.pieces.library.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.spaces[ids])
            if len(starts) == len(words) and not starts[0]:
                return ids, np.diff(starts, append=len(ids))
        return self._alone(words)

    def _learn(self, words: pa.Array) -> None:
        # a word that ends its text may end with a line feed, which must not come before the space of another
        last = pc.ends_with(words, "\n")
        joined, alone = words.filter(pc.invert(last)), words.filter(last)
        parts = [self._together(joined.slice(i, _JOINED).to_pylist()) for i in range(0, len(joined), _JOINED)]
        parts.append(self._alone(alone.to_pylist()))
        self.words = pa.concat_arrays([self.words, joined, alone])
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in parts)])
        self.sizes = np.concatenate([self.sizes, *(n for _, n in parts)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of these different words stands among those remembered, all of them from now on."""
        if self.words.nbytes + self.pool.nbytes > _REMEMBERED:
            self._forget_rare()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            self._learn(words.filter(at.is_null()))
            at = pc.index_in(words, value_set=self.words)
        places = at.to_numpy()
        self.met = np.concatenate([self.met, np.zeros(len(self.sizes) - len(self.met), np.int64)])
        self.met[places] += 1
        return places

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        cut = [_plain(t) for t in texts]
        lists = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, cut, strict=True)], pa.large_string()), " ")
        ends, pieces = lists.offsets.to_numpy(), lists.flatten()
        heads = ends[:-1]
        rest = np.ones(len(pieces), bool)
        rest[heads] = False
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        places = self._places(coded.dictionary)
        # a text that may not be cut is the first piece of itself
        whole = iter(self.pieces.encode([t for t, p in zip(texts, cut, strict=True) if not p]))
        first = iter(self.pieces.encode([h for h, p in zip(pieces.take(pa.array(heads)).to_pylist(), cut, strict=True) if p]))
        before = [b"".join(v for v in next(first if p else whole) if v) for p in cut]
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(before), np.uint32)])
        sizes = np.concatenate([self.sizes, np.array([len(b) // 4 for b in before], np.int64)])
        which = np.empty(len(rest), np.int64)
        which[rest] = places[coded.indices.to_numpy()]
        which[heads] = len(self.sizes) + np.arange(len(texts))
        n = sizes[which]
        at = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat((np.cumsum(sizes) - sizes)[which] - at[:-1], n) + np.arange(at[-1])], at[ends[1:]] - at[heads]
