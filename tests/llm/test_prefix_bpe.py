"""Prefix tables and texts (12) against the library, plain merging, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from solstice.llm import prefix_bpe
from solstice.llm.prefix_bpe import PrefixTable, TextEncoder, Vocabulary

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    v = Vocabulary.of_file(request.param)
    return TextEncoder(v, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def random_text(r, most=30):
    n = r.randint(0, most)
    if r.random() < 0.3:
        return "".join(chr(r.choice([r.randint(0, 0x250), r.randint(0, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(n))
    alphabet = r.choice(["ab ", "abcdefghij ", " \n\t", "0123456789", "é漢字か🙂 ", "'sretvmld ", "!#$%= -_", "aA ", "\x1c   x"])
    return "".join(r.choice(alphabet) for _ in range(n))


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_texts_have_the_library_s_ids(both, odd_texts):
    encoder, library = both
    r = random.Random(1)
    for t in [t or "" for t in odd_texts] + [random_text(r) for _ in range(5000)] + ["a" * 3000, "ab" * 2000, "=" * 999, "<|endoftext|>"]:
        assert ids_of(encoder.encode(t)) == library.encode_ordinary(t), t[:50]


def test_new_letters_are_classed_as_the_library_does(both):
    encoder, library = both
    for c in random.Random(2).sample(sorted(encoder.stand_ins), 200):
        t = f"a{chr(c)}b 1{chr(c)} {chr(c)}"
        assert ids_of(encoder.encode(t)) == library.encode_ordinary(t)


def test_pairs_are_valid_where_merging_gives_them_back(both):
    v, r = both[0].vocabulary, random.Random(3)
    short = [i for i, b in v.bytes_of.items() if len(b) < 4]
    for pool in (range(len(v.ranks)), short):
        for _ in range(5000):
            a, b = r.choice(pool), r.choice(pool)
            assert v.goes_with(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_every_prefix_has_its_own_encoding(both):
    v, r = both[0].vocabulary, random.Random(4)
    for _ in range(100):
        data = random_text(r).encode()
        table = PrefixTable(v, data)
        for k in range(len(data) + 1):
            table.truncate(len(data) - k)
            assert table.ids() == v.merged(data[: len(data) - k])


def test_appends_and_edits_give_what_encoding_anew_gives(both):
    v, r = both[0].vocabulary, random.Random(5)
    for _ in range(300):
        table = PrefixTable(v)
        for _ in range(4):
            table.append(random_text(r, 12).encode())
            n = len(table.data)
            a = r.randint(0, n)
            b = r.randint(a, min(n, a + 5))
            table.edit(a, b, random_text(r, 3).encode())
            assert table.ids() == v.merged(table.data) and len(table.last) == len(table.data)


def test_an_edit_works_out_only_what_lies_near_it(both):
    v = both[0].vocabulary
    data = b"".join(random.Random(6).choice([b"the", b"water", b"xq", b"ing", b"zz"]) for _ in range(4000))
    table = PrefixTable(v, data)
    assert table.edit(1000, 1002, b"QQQ") < 3 * v.longest
    assert table.ids() == PrefixTable(v, data[:1000] + b"QQQ" + data[1002:]).ids()


def test_tokens_that_merging_never_makes():
    """A whole pre-token in the ranks is that token; inside longer ones it is never made."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"cd": 257, b"abcd": 300, b"bc": 258, b"xyz": 301}
    v = Vocabulary(ranks)
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    for t in ["xyz", "xyza", "abcd", "abcdabcd"] + ["".join(r.choice("abcdxyz") for _ in range(r.randint(1, 12))) for _ in range(500)]:
        assert v.encode(t.encode()) == library.encode_ordinary(t)


def test_query_digests(spark, make_docs, odd_texts):
    r = random.Random(8)
    texts = [*odd_texts, *(random_text(r, 200) for _ in range(50))]
    ids = [*range(len(texts) - 2), None, 3]
    path = PATHS[0]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Vocabulary.of_file(path).ranks, special_tokens={})
    encoded = prefix_bpe.encode(make_docs(texts, ids=ids), path, public_tokenizers.PATTERN)
    got = prefix_bpe.digests(prefix_bpe.decode(encoded, path)).collect()
    want = []
    for i, t in zip(ids, texts, strict=True):
        w = library.encode_ordinary(t or "")
        want.append((i, len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert prefix_bpe.digests(prefix_bpe.decode(prefix_bpe.encode(make_docs([]), path, public_tokenizers.PATTERN), path)).count() == 0


def test_edits_of_encoded_documents(spark, make_docs):
    r, path = random.Random(9), PATHS[0]
    texts = [" ".join(random_text(r, 8) for _ in range(30)) for _ in range(80)] + ["", None, "one"]
    encoded = {x.doc_id: bytes(x.ids) for x in prefix_bpe.encode(make_docs(texts), path, public_tokenizers.PATTERN).collect()}
    rows, want = [], {}
    for i, t in enumerate(texts):
        edits, now = [], t or ""
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, len(now))
            b = r.randint(a, min(len(now), a + 9))
            new = random_text(r, 6)
            edits.append((a, b, new))
            now = now[:a] + new + now[b:]
        rows.append((i, t, encoded[i], edits, "clash"))
        want[i] = now
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids binary, edits array<struct<start:int,end:int,new:string>>, n_tokens string")
    encoder = TextEncoder.of_worker(path, public_tokenizers.PATTERN)
    for x in prefix_bpe.edit(frame, path, public_tokenizers.PATTERN).collect():
        assert (x.text, bytes(x.ids)) == (want[x.doc_id], encoder.encode(want[x.doc_id])) and x.n_tokens == len(x.ids) // 4


def test_stand_ins_cover_every_difference():
    single = {bytes([i]): i for i in range(256)}
    stand_ins = prefix_bpe.odd_characters(regex)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = bytes(tiktoken.Encoding("x", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        shown = every.translate(stand_ins)
        assert theirs == "".join(c for c, s in zip(every, shown, strict=True) if regex.match(kind, s))
