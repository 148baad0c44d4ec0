import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from solstice.llm import bm25_wand, bwt_repeats, kneser_ney, minhash_forest
from solstice.llm.components import components

SYLLABLES = ["ka", "lo", "mi", "ter", "sun", "dra", "pel", "vo", "nis", "ge"]


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_links(texts, similarity=0.8):
    sets = [shingles(t or "") for t in texts]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= similarity * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, near in enumerate(links):
            root[i] = min([root[i], *(root[j] for j in near)])
    return [len(x) for x in links], root


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates_agree_with_all_pairs(make_docs, odd_texts, block):
    r = random.Random(1)
    base = [prose(r, 60) for _ in range(6)]
    texts = [*base, base[0], base[0]]
    for b in base[:4]:
        for _ in range(6):
            w = b.split()
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
            texts.append(" ".join(w))
    texts += [t for t in odd_texts if t is None or len(t) < 1000] + ["a b c d"]
    n_links, root = plain_links(texts)
    got = {x.doc_id: x for x in minhash_forest.near_duplicates(make_docs(texts), block=block).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id) == (n_links[i], root[i]), (i, texts[i])


def test_near_duplicates_of_repeated_ids(make_docs):
    r = random.Random(2)
    a, b = prose(r, 40), prose(r, 40)
    got = minhash_forest.near_duplicates(make_docs([a, a, b, a, None], ids=[5, 5, 5, None, 9])).collect()
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in got) == Counter([(5, 5, 1), (5, 5, 1), (5, 5, 0), (None, None, 0), (9, 9, 0)])
    assert minhash_forest.near_duplicates(make_docs([])).count() == 0


def plain_nodes(leaves, k):
    """Classes that share a prefix of k values in some tree, as sets."""
    nodes = {}
    for tree, label, node in leaves:
        nodes.setdefault((tree, (label & (2**64 - 1)) >> (64 - 8 * k)), set()).add(node)
    return [x for x in nodes.values() if len(x) > 1]


def joined(groups):
    """Connected components of overlapping sets."""
    out = []
    for g in map(set, groups):
        for other in [x for x in out if x & g]:
            g |= other
            out.remove(other)
        out.append(g)
    return sorted(map(sorted, out))


@pytest.mark.parametrize("partitions", [1, 7])
def test_tries_join_what_shares_a_prefix(spark, request, partitions):
    r = random.Random(21)
    # Few values per place, so that nodes are large and ranges cut through them; negative labels too.
    leaves = [(tree, int.from_bytes(bytes(r.choice([0, 255]) for _ in range(8)), "big", signed=True), 1000 * tree + i) for tree in range(3) for i in range(300)]
    for name, value in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(name)
        request.addfinalizer(lambda name=name, before=before: spark.conf.set(name, before))
        spark.conf.set(name, value)
    got = minhash_forest.tries(spark.createDataFrame(leaves, "tree int, label long, node long"), 5, 8).collect()
    for k in (5, 6, 7, 8):
        assert joined([(x.node, x.heads[k - 5]) for x in got if x.node != x.heads[k - 5]]) == joined(plain_nodes(leaves, k))


def test_matched_prefixes_follow_the_similarities(spark, make_docs):
    r = random.Random(22)
    trees, depth, floor = 32, 8, minhash_forest.prefix_length(32, 8, 0.8, 0.9999)

    def depth_for(edits):
        texts = []
        for _ in range(60):
            w = prose(r, 200).split()
            texts.append(" ".join(w))
            for at in range(edits):
                w[10 + 20 * at] = "edit"
            texts.append(" ".join(w))
        signed = make_docs(texts).mapInArrow(lambda batches: minhash_forest._labels(trees, depth, batches), "doc_id long, key binary, labels array<long>")
        labels = spark.createDataFrame([(x.doc_id, x.labels) for x in signed.collect()], "node long, labels array<long>")
        leaves = [(t, x, row.node) for row in labels.collect() for t, x in enumerate(row.labels)]
        edges = minhash_forest.tries(spark.createDataFrame(leaves, "tree int, label long, node long"), floor, depth)
        return minhash_forest.matched_depth(edges, labels, trees, floor, depth, 0.8, 0.9999)

    # One edited word leaves a similarity of 0.95; four leave 0.82, which needs shorter prefixes.
    assert depth_for(1) == depth and depth_for(4) < depth
    assert depth_for(0) == depth


def test_recall_near_the_threshold(make_docs):
    r = random.Random(23)
    texts = []
    for i in range(300):
        w = prose(r, 120 + i % 40).split()
        texts.append(" ".join(w))
        for at in range(1 + i % 2):
            w[20 + 40 * at] = "edit"
        if i % 3:
            w = w[: len(w) - i % 9]
        texts.append(" ".join(w))
    want = [plain_links(texts[i : i + 2])[0][0] for i in range(0, len(texts), 2)]
    got = {x.doc_id: x.n_links for x in minhash_forest.near_duplicates(make_docs(texts)).collect()}
    found = sum(got[2 * i] == n for i, n in enumerate(want) if n)
    assert sum(want) >= 200 and found >= 0.999 * sum(want) and all(got[2 * i] == 0 for i, n in enumerate(want) if not n)


def test_floor_of_the_prefixes():
    for trees, recall in ((32, 0.9999), (8, 0.99), (64, 0.999)):
        k = minhash_forest.prefix_length(trees, 8, 0.8, recall)
        assert 1 - (1 - 0.8**k) ** trees >= recall and (k == 8 or 1 - (1 - 0.8 ** (k + 1)) ** trees < recall)
    with pytest.raises(ValueError, match="more trees"):
        minhash_forest.prefix_length(1, 8, 0.8, 0.99)


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict((x.node, x.component) for x in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def plain_cut(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        mark = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        gone = np.cumsum(mark)[: len(d)] > 0
        kept = bytes(x for x, g in zip(d, gone.tolist(), strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_agree_with_all_strings(make_docs, odd_texts):
    r = random.Random(3)
    shared = [prose(r, 60)[: r.randint(196, 230)] for _ in range(6)] + [prose(r, 300)]
    texts = [t for t in odd_texts if t is None or len(t) < 1000] + ["y" * 450, "ab" * 300]
    for _ in range(40):
        parts = [prose(r, r.randint(0, 40)) for _ in range(r.randint(1, 3))] + [r.choice(shared) for _ in range(r.randint(0, 2))]
        r.shuffle(parts)
        texts.append("".join(parts))
    for s in (199, 200, 201):
        x = prose(r, 80)[:s]
        texts += [x, "é" + x, x + "漢", x[:100] + "#" + x[100:]]
    texts += [texts[20], shared[6], shared[6][:260] + "!" + shared[6][260:]]
    got = {x.doc_id: x for x in bwt_repeats.cut_repeats(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_cut(texts)):
        assert tuple(got[i])[1:] == want, (i, texts[i])


def test_repeats_do_not_cross_documents_and_know_repeated_rows(make_docs):
    r = random.Random(4)
    x = prose(r, 90)[:300]
    got = bwt_repeats.cut_repeats(make_docs([x[:150], x[150:], x, x], ids=[1, 2, 3, 3]), keep_text=True).collect()
    assert Counter((g.doc_id, g.n_removed, bytes(g.kept)) for g in got) == Counter([(1, 0, x[:150].encode()), (2, 0, x[150:].encode()), (3, 300, b""), (3, 300, b"")])
    assert bwt_repeats.cut_repeats(make_docs([])).count() == 0


def test_long_text_is_cut_in_anchor_chunks():
    r = random.Random(5)
    data = bytes(r.randrange(97, 123) for _ in range(30_000))
    whole, hashes = bwt_repeats.anchors(data)
    old = bwt_repeats._CHUNK
    try:
        bwt_repeats._CHUNK = 1000
        parts, other = bwt_repeats.anchors(data)
    finally:
        bwt_repeats._CHUNK = old
    assert (whole == parts).all() and (hashes == other).all() and (np.diff(whole) <= bwt_repeats.SPAN).all()


def test_wand_finds_all_that_reach_the_threshold(make_docs, spark):
    r = random.Random(6)
    items = [prose(r, r.randint(10, 60)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    entries, shards = bm25_wand.postings(table, 40, 1000)
    rows = entries.drop("shard").toArrow()
    index = bm25_wand.Index(rows, 0.1)
    assert shards == 1
    weights = {}
    number = {u: i for i, u in enumerate(sorted(set(zip(rows["item_id"].to_pylist(), rows["unit"].to_pylist(), strict=True))))}
    for item, unit, term, w in zip(*(rows[c].to_pylist() for c in ("item_id", "unit", "term", "weight")), strict=True):
        weights.setdefault(number[item, unit], {})[term] = w
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in weights.values())
    for _ in range(200):
        query = set(prose(r, 30).split()) | set(r.choice(items).split()[: r.randint(0, 60)])
        for threshold in (0.2, 0.4, 0.6):
            want = {u: s for u, w in weights.items() if (s := sum(x for t, x in w.items() if t in query)) >= threshold - 1e-9}
            got = dict(index.above([index.terms[t] for t in query if t in index.terms], threshold))
            assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in got)


@pytest.mark.parametrize("shard_units", [20_000, 7])
def test_contaminated_documents_are_found(make_docs, odd_texts, spark, shard_units):
    r = random.Random(7)
    items = [prose(r, r.randint(12, 90)) for _ in range(20)] + [None, "", "!!"]
    texts = [t for t in odd_texts if t is None or len(t) < 1000] + [prose(r, 150) for _ in range(30)]
    clean = len(texts)
    for i in range(20):
        texts.append(prose(r, 40) + " " + items[i].upper().replace(" ", ",\n ") + ". " + prose(r, 40))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in bm25_wand.contaminated(make_docs(texts), table, shard_units=shard_units).collect()}
    assert got == {(clean + i, i) for i in range(20)}
    if shard_units > 7:
        half = [" ".join(t.split()[: len(t.split()) // 2]) for t in items[:20]]
        assert bm25_wand.contaminated(make_docs(half), table).count() == 0
        assert bm25_wand.contaminated(make_docs([]), table).count() == 0 and bm25_wand.contaminated(make_docs(texts), table.limit(0)).count() == 0


def plain_model(symbols_of, texts):
    """Interpolated modified Kneser-Ney probability by dictionaries, order 4."""
    counts = {4: Counter()}
    for t in texts:
        s = [0, 0, 0, *symbols_of(t)]
        counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    held = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [0.5, 1.0, 1.2]
        for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if n1 and a:
                d[k - 1] = max(0.1, min(k * 0.95, k - (k + 1) * y * b / a))
        held[n] = d
    followers = {n: {} for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            followers[n].setdefault(g[:-1], []).append(x)

    def p(gram):
        if not gram:
            return 1 / kneser_ney.SIZE
        n = len(gram)
        seen = followers[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d = held[n]
        taken = lambda x: d[min(x, 3) - 1]
        x = counts[n].get(gram, 0)
        return ((x - taken(x)) if x else 0) / sum(seen) + sum(map(taken, seen)) / sum(seen) * p(gram[1:])

    return p


def test_model_agrees_with_dictionaries(make_docs, spark):
    r = random.Random(8)
    texts = [prose(r, 30) for _ in range(30)]
    docs = make_docs(texts)
    trusted = docs.select("doc_id")
    letters, shards = kneser_ney.train(docs, trusted)
    fit = [x.doc_id for x in docs.filter(~kneser_ney.held_out(docs.doc_id)).collect()]
    of = lambda t: [letters["en"][ord(c)] for c in t]
    p = plain_model(of, [texts[i] for i in fit])
    table = kneser_ney.Costs(shards["en"].value).of(np.arange(kneser_ney.SIZE**kneser_ney.ORDER, dtype=np.uint32))
    for _ in range(300):
        gram = [r.randint(0, 20) for _ in range(4)]
        if r.random() < 0.7:
            t = of(r.choice(texts))
            i = r.randrange(3, len(t))
            gram = t[i - 3 : i + 1]
        at = sum(s << (6 * (3 - k)) for k, s in enumerate(gram))
        assert abs(table[at] + 1000 * np.log(p(tuple(gram)))) <= 1.01
    total = sum(np.exp(-table[at].astype(float) / 1000) for at in range(64 * 1000, 64 * 1001))
    assert abs(total - 1) < 0.01


def test_strange_documents_go_and_clean_ones_stay(make_docs, odd_texts):
    r = random.Random(9)
    clean = [prose(r, 60) for _ in range(120)]
    junk = ["".join(r.choice("QXZ#%&0918") for _ in range(300)) for _ in range(5)]
    texts = clean + junk + odd_texts + ["unjudged language " * 20]
    langs = ["en"] * (125 + len(odd_texts)) + [None]
    docs = make_docs(texts, langs)
    got = {x.doc_id: x for x in kneser_ney.judge(docs, docs.filter("doc_id < 100").select("doc_id")).collect()}
    assert len(got) == len(texts) and all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 125))
    assert got[125].kept and got[125].nats is None and got[len(texts) - 1].kept
    assert kneser_ney.judge(make_docs([]), docs.select("doc_id")).count() == 0
    assert all(x.kept for x in kneser_ney.judge(docs, docs.limit(0).select("doc_id")).collect())


def test_grams_do_not_cross_texts():
    grams = kneser_ney.Grams({"en": {ord(c): i + 1 for i, c in enumerate("abcd")}})
    texts = ["ab", "", "c", "dabc", "漢", "abcd"]
    together, sizes = grams.of("en", texts)
    assert sizes.tolist() == [2, 0, 1, 4, 1, 4]
    assert together.tolist() == [x for t in texts for x in grams.of("en", [t])[0].tolist()]
    assert grams.of("en", ["abcd"])[0][-1] == (1 << 18) + (2 << 12) + (3 << 6) + 4


@pytest.mark.parametrize("shard_units", [20_000, 2])
def test_repeated_items_and_late_rare_words_are_found(make_docs, spark, shard_units):
    r = random.Random(16)
    once, three = prose(r, 30), prose(r, 30)
    # Five items share their first 24 words, so that the weight of those is common and stands before the rare words.
    same = prose(r, 24)
    close = [same + " " + prose(r, 3) for _ in range(5)]
    items = [three, three, three, once, *close]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(r, 40) + " " + x + " " + prose(r, 40) for x in (three, close[2])]
    got = {(x.doc_id, x.item_id): x.score for x in bm25_wand.contaminated(make_docs(texts), table, shard_units=shard_units).collect()}
    assert {(0, 0), (0, 1), (0, 2), (1, 6)} <= set(got) and min(got[0, 0], got[1, 6]) > 0.999


def test_long_passages_of_longer_items_are_found(make_docs, spark):
    r = random.Random(17)
    items = [prose(r, 400), prose(r, 100), prose(r, 60)]
    w = [x.split() for x in items]
    passages = [w[0][130:230], w[0][:30], w[1][:70], w[2][:42], w[2][:28]]
    texts = [prose(r, 40) + " " + " ".join(p) + " " + prose(r, 40) for p in passages]
    rows = [(i, x, None) for i, x in enumerate(items)]
    table = spark.createDataFrame(rows, "item_id long, text string, answer string")
    assert {(x.doc_id, x.item_id) for x in bm25_wand.contaminated(make_docs(texts), table).collect()} == {(0, 0), (2, 1), (3, 2)}
    # Where there are answers, question and answer are both needed.
    known = table.filter("item_id = 2").selectExpr("item_id", "text", "'the very answer' as answer")
    docs = make_docs([items[2], items[2] + " the very answer"])
    assert [x.doc_id for x in bm25_wand.contaminated(docs, known, "answer").collect()] == [1]


def test_repeated_rows_and_null_ids_are_reported_alike_in_every_number_of_shards(make_docs, spark):
    r = random.Random(18)
    items = [prose(r, 150) for _ in range(4)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [items[0], items[0], items[0] + " " + items[1], items[1], items[1], items[2], None, ""]
    ids = [1, 1, 1, None, None, 7, None, 8]
    found = [sorted(map(str, bm25_wand.contaminated(make_docs(texts, ids=ids), table, shard_units=n).collect())) for n in (20_000, 3, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 7


def test_a_small_language_is_judged_beside_a_large_one(make_docs):
    r = random.Random(19)
    small = [prose(r, 60) for _ in range(60)] + ["".join(r.choice("QXZ#%&0918") for _ in range(400))]
    other = ["ein anderer satz " * 200 for _ in range(150)]
    for more in (0, len(other)):
        texts = small + other[:more]
        docs = make_docs(texts, ["xx"] * len(small) + ["de"] * more)
        got = {x.doc_id: x.kept for x in kneser_ney.judge(docs, docs.filter("doc_id < 60").select("doc_id"), quantile=1.0, min_held=3).collect()}
        assert not got[60] and sum(got[i] for i in range(60)) >= 55


def plain_costs(texts, fit, letters):
    """Nats of each text by dictionaries: symbols by plain_model, then each character among those of its group, after the three before it."""
    group = lambda c: -1 if letters is None else None if ord(c) in letters else ord(c) % 4
    symbols = lambda t: [letters.get(ord(c), 60 + ord(c) % 4) for c in t]
    of_symbols = plain_model(symbols, fit) if letters is not None else None
    events = lambda t: [(group(c), *[0 if i < k else ord(t[i - k]) for k in (3, 2, 1)], ord(c)) for i, c in enumerate(t) if group(c) is not None]
    counts = {4: Counter(e for t in fit for e in events(t))}
    for n in (3, 2, 1):
        counts[n] = Counter((e[0], *e[2:]) for e in counts[n + 1])
    followers, off = Counter(), {}
    for n, c in counts.items():
        m = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        off[n] = [max(0.1, min(k * 0.95, k - (k + 1) * m[0] / (m[0] + 2 * m[1]) * m[k] / m[k - 1])) if m[0] and m[k - 1] else (0.5, 1.0, 1.2)[k - 1] for k in (1, 2, 3)]
        for e, x in c.items():
            followers[n, e[:-1], "all"] += x
            followers[n, e[:-1], "off"] += off[n][min(x, 3) - 1]

    def member(e):
        p = 1 / 0x110000 if e[0] < 0 else 4 / 0x110000
        for n in range(1, 5):
            key, x = (e[0], *e[5 - n :]), counts[n].get((e[0], *e[5 - n :]), 0)
            total = followers[n, key[:-1], "all"]
            if total:
                p = (x - off[n][min(x, 3) - 1] if x else 0) / total + followers[n, key[:-1], "off"] / total * p
        return p

    def nats(t):
        s = [0, 0, 0, *symbols(t)] if letters is not None else []
        return -sum(np.log(of_symbols(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) - sum(np.log(member(e)) for e in events(t))

    return [nats(t) / len(t) if t else None for t in texts]


def test_every_character_counts_as_in_dictionaries(make_docs):
    r = random.Random(21)
    words = ["".join(chr(0x4E00 + r.randrange(150)) for _ in range(r.randint(1, 3))) for _ in range(60)]
    some = lambda n: "".join(r.choice(words) + r.choice([" ", "", "!", "\U0001f600"]) for _ in range(n))
    large, small = [some(r.randint(1, 60)) for _ in range(40)], [some(4) for _ in range(25)]
    texts = [*large, large[0], "new \u7fff\ud7ff", None, "", *small, small[0]]
    langs = [None] * 44 + ["xx"] * 26
    ids = [*range(40), 0, None, 42, 43, *range(44, 69), None]
    docs = make_docs(texts, langs, ids)
    assert sum(map(len, large)) > 1000 > sum(map(len, small)) + len(small[0])
    trusted = docs.filter("doc_id % 4 < 3").select("doc_id")
    letters = kneser_ney.alphabets(docs, 1000)
    assert set(letters) == {None} and len(letters[None]) == 59
    fit_ids = {x.doc_id for x in docs.join(trusted, "doc_id", "left_semi").filter(~kneser_ney.held_out(docs.doc_id)).collect()}
    fit = [[t for t, x, i in zip(texts, langs, ids, strict=True) if t and x == lang and i in fit_ids] for lang in (None, "xx")]
    plain = plain_costs(texts[:44], fit[0], letters[None]) + plain_costs(texts[44:], fit[1], None)
    got = kneser_ney.judge(docs, trusted).collect()
    assert len(got) == len(texts)
    found = sorted(((x.lang or "", x.doc_id is None, x.doc_id or 0, x.nats) for x in got), key=str)
    wanted = sorted(((x or "", i is None, i or 0, n) for x, i, n in zip(langs, ids, plain, strict=True)), key=str)
    for a, b in zip(found, wanted, strict=True):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 0.002)


def test_rare_characters_short_texts_and_small_languages_are_judged(make_docs):
    r = random.Random(22)
    letters = [chr(0x4E00 + i) for i in range(600)]
    words = ["".join(r.choice(letters) for _ in range(3)) for _ in range(200)]
    some = lambda n: "".join(r.choice(words) for _ in range(n))
    # Other characters of the same group for each.
    other = lambda t: "".join(r.choice(letters[ord(c) % 4 :: 4]) for c in t)
    texts = [some(100) for _ in range(200)] + [other(some(100)) for _ in range(5)]
    texts += [some(r.randint(5, 30)) for _ in range(100)] + [other(some(10)) for _ in range(5)]
    small = [" ".join(r.choice(["ko", "lumi", "ter"]) for _ in range(6)) for _ in range(25)] + ["QX#%&0918" * 5]
    docs = make_docs([*texts, *small, "", None], ["zz"] * len(texts) + ["yy"] * len(small) + ["zz"] * 2)
    assert sum(map(len, small)) < 1000
    trusted = docs.filter("doc_id < 200 or doc_id between 205 and 304 or doc_id between 310 and 334").select("doc_id")
    got = {x.doc_id: x for x in kneser_ney.judge(docs, trusted, min_held=3).collect()}
    empty = [got.pop(i) for i in (336, 337)]
    assert all(x.kept and x.nats is None for x in empty)
    assert all(x.nats is not None and x.threshold is not None for x in got.values())
    assert not any(got[i].kept for i in [*range(200, 205), *range(305, 310), 335])
    assert sum(x.kept for x in got.values()) >= 325 - 6
