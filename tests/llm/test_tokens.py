import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from solstice.llm import rans, token_counts
from solstice.llm.tokens import PieceEncoder, pieces_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(seed, n):
    r = random.Random(seed)
    alphabet = ["ab", "c", " ", " ", "  ", "\n", "\t", "é", "漢", "1", "!", "'s", "<|endoftext|>", "\u00a0", "don't", "\x1c"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_pieces_give_the_text_and_the_library_s_ids(library, odd_texts):
    encoder = PieceEncoder(PATH, counts=False, keep=50)
    texts = random_texts(1, 300) + [t or "" for t in odd_texts]
    for text, values in zip(texts, encoder.encode(texts), strict=True):
        assert "".join(pieces_of(text)) == text
        assert np.frombuffer(b"".join(values), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 4), (65_536, 256)])
def test_counts_agree_with_whole_texts(make_docs, library, odd_texts, chunk, overlap):
    texts = [t for t in odd_texts if chunk > 1000 or len(t or "") < 1000] + random_texts(2, 20) + ["w" * 190 + " <|endoftext|>" * 60, " " * 1000 + "b", "it's " * 500]
    got = {r.doc_id: r for r in token_counts.count_tokens(make_docs(texts), PATH, 100, chunk, overlap).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), i


def test_counts_of_repeated_rows_null_ids_and_no_rows(make_docs):
    rows = token_counts.count_tokens(make_docs(["a b" * 400] * 2 + ["c"], ids=[1, 1, None]), PATH, chunk=300, overlap=8).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (1, 401), (1, 401)]
    assert token_counts.count_tokens(make_docs([]), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 33, 65_535, 65_537, 140_000])
def test_segments_decode_to_what_was_coded(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_256).astype(np.uint32)
    blob = rans.encode_segment([None, 7], [n // 2, n - n // 2], ids)
    s = rans.Segment(blob)
    assert (s.decode() == ids).all() and s.doc_ids == [None, 7] and s.lengths.tolist() == [n // 2, n - n // 2]
    if s.blocks > 1:
        assert (s.decode(1, 2) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()


def test_damage_is_noticed():
    blob = bytearray(rans.encode_segment([1], [1000], np.arange(1000, dtype=np.uint32)))
    blob[len(blob) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Segment(bytes(blob))


def test_scaled_frequencies_keep_every_symbol():
    counts = np.array([10**12, 1, 1, 5])
    f = rans.scaled(counts, 4)
    assert f.sum() == 16 and f.min() >= 1 and f.argmax() == 0
    assert rans.scaled(np.ones(16, int), 4).tolist() == [1] * 16


def test_files_round_trip_in_order(make_docs, library, odd_texts):
    texts = odd_texts + random_texts(3, 40)
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    docs = make_docs([texts[i] for i in order], ids=order)
    got = sorted(rans.round_trip(docs, PATH).collect())
    start = 0
    for i, r in enumerate(got):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rans.round_trip(make_docs([]), PATH).count() == 0


def test_small_segments_and_reading_ids(make_docs, library, spark, tmp_path):
    texts = ["some words " * (i % 7) for i in range(60)]
    path = f"file://{tmp_path}/tokens"
    rans.write_tokens(make_docs(texts), PATH, path, segment=50)
    got = {r.doc_id: (r.start, r.ids) for r in rans.read_tokens(spark, path).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (start, ids)
        start += len(ids)


def test_files_of_null_and_repeated_ids(make_docs, library, spark):
    texts = [f"text {i % 37} " * (i % 5) for i in range(120)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, as on large input
    try:
        rows = rans.round_trip(make_docs(texts, ids=ids).repartition(5), PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for i, t in zip(ids, texts, strict=True):
        coded = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(coded), zlib.crc32(coded.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    # ids ascend with the place in the files, those without one first, and every document starts where the one before ends
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(i or -1 for i in ids)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_word_ids_equal_the_library_and_unknown_words_are_encoded_together():
    from solstice.llm.tokens import WordIds

    rnd = random.Random(5)
    odd = ["a", "b", " ", " ", "\n", "Ġ", "é", "1", ".", "'s", "<|endoftext|>", "\t", "　", "日", "́", "\x1d", "᠎", "​", "\xa0"]
    texts = ["", " ", "a\n b", "x\n\n", "b c\n\n d", "end with a line\n", "a  b", *("".join(rnd.choices(odd, k=rnd.randint(0, 30))) for _ in range(3000))]
    texts += [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(50)]
    words = WordIds(PATH)
    ids, n = words.encode(texts)
    ends = n.cumsum().tolist()
    expected = [words.pieces.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n.tolist(), strict=True)] == expected

    class Counting:
        asked = 0

        def encode_batch_fast(self, some, **options):
            Counting.asked += len(some)
            return library.encode_batch_fast(some, **options)

    library = words.pieces.library
    words.pieces.library = Counting()
    words.encode([" ".join(f"x{i}y" for i in range(5000)), "and more"])
    # 5,000 unknown words in five texts, one more for what is left, and two words without a space before them
    assert Counting.asked <= 8
    words._forget()
    assert words.encode(["and more"])[0].tolist() == library.encode("and more", add_special_tokens=False).ids


def test_segments_close_at_the_document_that_fills_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(100)], "doc_id LONG, text STRING").coalesce(1)
    rans.write_tokens(docs, PATH, f"file://{tmp_path}/t", segment=20)
    sizes = [r["n_ids"] for r in spark.read.parquet(f"file://{tmp_path}/t").select("n_ids").collect()]
    assert sum(n < 20 for n in sizes) <= 4 and max(sizes) < 20 + 8 * 2
    got = {r["doc_id"]: r["ids"] for r in rans.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    library = PieceEncoder(PATH, counts=False).library
    assert got == {i: [*library.encode("word " * (i % 7), add_special_tokens=False).ids, 0] for i in range(100)}


def test_word_ids_stay_right_when_words_are_forgotten(library, monkeypatch):
    from solstice.llm import tokens

    monkeypatch.setattr(tokens, "_REMEMBERED", 2000)
    words, rnd = tokens.WordIds(PATH), random.Random(9)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["often", f"rare{rnd.randint(0, 9999)}", "x.\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(8)]
        ids, n = words.encode(texts)
        assert [a.tolist() for a in np.split(ids, n.cumsum())[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(words.words) == len(words.sizes) == len(words.met) < 1000
