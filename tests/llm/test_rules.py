import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from solstice.llm import divergence, length_buckets, pii, url_rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("alphabet", ["aZ09.%+-@@.. 12345()\n", "0123.4444 -.5", "+12() .-3"])
def test_base_spans_agree_with_the_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(8000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot doe at mail dot example dot com now", 0, "john dot doe at mail dot example dot com"),
        ("x john (at) mail.example.com y", 0, "john (at) mail.example.com"),
        ("ｊohn＠mail．com hi", 0, "ｊohn＠mail．com"),
        ("jоhn@mail.com", 0, "jоhn@mail.com"),
        ("john@ma\u200bil.com", 0, "john@ma\u200bil.com"),
        ("ask hein.19 at mail5.example.com today", 0, "hein.19 at mail5.example.com"),
        ("a user&#64;host&#46;org b", 0, "user&#64;host&#46;org"),
        ("x ann@mail dot org", 0, "ann@mail dot org"),
        ("dial +1 nine eight eight five five five 2485 now", 3, "+1 nine eight eight five five five 2485"),
        ("at 192[.]168[.]0[.]1 now", 1, "192[.]168[.]0[.]1"),
        ("one nine two dot one six eight dot one dot one", 1, "one nine two dot one six eight dot one dot one"),
        ("call plus one five five five one two three four five six seven", 3, "plus one five five five one two three four five six seven"),
    ],
)
def test_disguised_spans_are_found_in_source_offsets(text, kind, found):
    spans = pii.added_spans(text, pii.base_spans(text))
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["look at example.com", "version 2 at example.com", "in 1999 at home", "100% at it.", "he is at it in the hall", "john at the dot", "one two three four", "", "meet at nine"])
def test_prose_is_left_alone(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_pii_of_odd_rows_and_redaction(make_docs, odd_texts):
    texts = odd_texts + ["write a@b.co or +1 (555) 123-4567", "a@b.co"]
    docs = make_docs(texts)
    got = {r.doc_id: r for r in pii.counts(pii.find_pii(docs)).collect()}
    assert len(got) == len(texts) and got[len(texts) - 2].spans == "email:6:12,phone:16:33" and got[0].spans == "" and got[9].n_ip == 1
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[len(texts) - 2].text == "write <EMAIL> or <PHONE>" and clean[len(texts) - 2].n_chars == 24
    assert clean[0].text is None and clean[6].text == texts[6] and pii.redact(docs).columns == docs.columns
    assert pii.counts(pii.find_pii(make_docs([]))).count() == 0


def test_base_figures_agree_with_a_plain_count():
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "c#", "\n", " ", " ", "\u00a0", "\t", "dd"]) for _ in range(r.randint(0, 120)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(covered))
        assert divergence.words_of(text) == words and divergence.base_figures(text, words)[:5] == want


def test_divergent_documents_go(make_docs, odd_texts):
    r = random.Random(1)
    common = "the of and to in is it that was for on are as with his they at be this from".split()
    clean = [" ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice("etaoinshr") for _ in range(6)) for _ in range(120)) for _ in range(80)]
    junk = ["## %% " * 3 + " ".join(f"{w}$$%%##" for w in c.upper().split()) for c in clean[:4]]
    got = {r.doc_id: r for r in divergence.judge(make_docs(clean + junk + odd_texts + [None], langs=["en"] * 84 + ["xx"] * len(odd_texts) + [None])).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept or got[i].base_failed for i in range(80, 84))
    assert got[84].base_failed and got[84].n_words == 0 and len(got) == 85 + len(odd_texts)
    assert divergence.judge(make_docs([])).count() == 0


def test_buckets_are_optimal():
    r = random.Random(2)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 4)
        cost = lambda ends: sum(n * (next(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))  # noqa: B023, E731
        from itertools import combinations

        best = min(cost(sorted({*c, lengths[-1]})) for m in range(min(k, len(lengths))) for c in combinations(lengths[:-1], m))
        ends = length_buckets.best_buckets(lengths, counts, k)
        assert len(ends) <= k and cost(ends) == best


def test_packing_holds_every_token_once(make_docs, odd_texts):
    texts = odd_texts + ["w " * n for n in range(1, 60)] + ["same words here"] * 5
    rows = length_buckets.pack(make_docs(texts), max_len=64, multiple=8, buckets=3, budget=256, rows_per_piece=10).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for i, t in enumerate(texts):
        mine = sorted((r.segment, r.length) for r in rows if r.doc_id == i)
        assert sum(n for _, n in mine) == (words(t) + 1 if words(t) else 0) and all(n <= 64 for _, n in mine)
    batches = {}
    for r in rows:
        if r.length:
            assert r.length <= r.bucket_len
            batches.setdefault((r.bucket_len, r.batch), []).append(r.slot)
        else:
            assert r.bucket_len is None and r.batch is None
    assert all(sorted(s) == list(range(len(s))) and (len(s) * b <= 256 or len(s) == 1) for (b, _), s in batches.items())
    for b in {b for b, _ in batches}:
        full = [len(s) for (x, n), s in sorted(batches.items()) if x == b]
        assert len(set(full[:-1])) <= 1
    assert length_buckets.pack(make_docs([])).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(r), r) for r, _ in url_rules.HOST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1] if fits else None


def test_urls_follow_fixed_rules_and_mined_ones(spark):
    urls = [None, "", "no scheme", "http://", "http://A.NET", "HTTP://x.Example.net/en/1?a=b#c", "http://example.net/de/", "http://notexample.com/de/x", "http://example.com/de/x", "https://q.org/fr/#x", "http://q.org?x", "a://b://c/d"]
    urls += [f"http://site{i}.example.org/en/{i}" for i in range(60)] + [f"http://casino{i}.bets.org/win/{i}.html?ref=1" for i in range(60)] + ["http://new.bets.org/win/9.html"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([(i, "bets" in (u or "")) for i, u in enumerate(urls[:-1])], "id long, bad boolean")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, bad).collect()}
    assert len(got) == len(urls)
    verdicts = dict(url_rules.HOST_RULES)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == plain_rule(u), u
        if got[i].rule:
            assert got[i].verdict == verdicts[got[i].rule]
    assert got[len(urls) - 1].verdict == "block" and got[20].verdict == "allow" and got[0].verdict == "allow"
    assert url_rules.judge_urls(pages.limit(0), bad).count() == 0 and {r.verdict for r in url_rules.judge_urls(pages.filter("page_id > 20"), bad.limit(0)).collect()} == {"allow"}


def test_mined_rules_are_those_of_a_plain_count(spark):
    from itertools import combinations

    r = random.Random(9)
    sets = [(sorted(r.sample("abcdef", r.randint(1, 4))), r.random() < 0.4) for _ in range(200)]
    got = {tuple(x.tokens): round(x.confidence, 9) for x in url_rules.mine(spark.createDataFrame(sets, "tokens array<string>, bad boolean"), 0.0, 10, 0.4).collect()}
    want = {}
    for n in range(1, 5):
        for c in combinations("abcdef", n):
            with_c = [b for t, b in sets if set(c) <= set(t)]
            if sum(with_c) >= 10 and sum(with_c) / len(with_c) >= 0.4:
                want[c] = round(sum(with_c) / len(with_c), 9)
    assert got == want


def test_best_mined_rule_is_that_of_a_plain_search(spark):
    """Pruning, index and ties against all rules tried on all URLs; null ids, repeated rows and long URLs among them."""
    r = random.Random(24)
    urls = ["http://" + ".".join(r.sample(["ab", "cd", "ef"], 2)) + "/" + "/".join(r.sample(["u", "v", "w", "x"], r.randint(1, 3))) for _ in range(300)]
    marks = [r.random() < (0.95 if "/u" in u and "cd" in u else 0.9 if "w" in u else 0.1) for u in urls]
    more = [None, urls[0], "http://ab.cd/" + "long" * 20_000 + "/u", "http://cd.ef/" + "/".join(f"s{chr(97 + i % 26) * (1 + i // 26)}" for i in range(400)) + "/u"]
    rows = [(i, u) for i, u in enumerate([*urls, *more])] + [(None, urls[1]), (None, None), (3, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit("clash"))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, True)], "id long, bad boolean")
    got = url_rules.judge_urls(pages, labels, min_count=10, min_confidence=0.7).collect()
    assert Counter(x.page_id for x in got) == Counter(i for i, _ in rows)
    host, path = url_rules.host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = keyed.select("page_id", "url", url_rules.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).collect()
    bad = spark.createDataFrame([(x.tokens, marks[x.page_id]) for x in tokens if x.page_id is not None and x.page_id < len(marks)], "tokens array<string>, bad boolean")
    rules = {frozenset(x.tokens): x.confidence for x in url_rules.mine(bad, 0.0005, 10, 0.7).collect()}
    pruned = {k: c for k, c in rules.items() if not any(o < k and d >= c for o, d in rules.items())}
    assert 1 < len(pruned) < len(rules)
    want = Counter()
    for x in tokens:
        fits = [(c, len(k), sorted(k)) for k, c in pruned.items() if k <= set(x.tokens)]
        want[(x.page_id, tuple(max(fits)[2]) if fits else None)] += 1
    assert Counter((x.page_id, tuple(x.bad_tokens) if x.bad_tokens else None) for x in got) == want
    assert all(x.rule is None and x.verdict == ("block" if x.bad_tokens else "allow") for x in got)


def test_every_character_has_its_own_class():
    got = dict(zip(divergence.CLASSES, divergence.class_counts("😀" * 10 + "。" * 5 + "\u3000" * 4 + "漢" * 3 + "한ﬀ𝟘\U0010fffd").tolist(), strict=True))
    assert got == {"lower": 1, "upper": 0, "letter": 4, "mark": 0, "digit": 1, "space": 4, "punctuation": 5, "symbol": 10, "other": 1}


def test_a_rare_language_has_its_reference_whatever_the_others(make_docs):
    r = random.Random(20)
    prose = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and"]) for _ in range(120)) for _ in range(12)]
    odd = " ".join("%&#@!" for _ in range(120)) + " end"
    for more in (0, 400):
        texts = [*prose, odd, *["viele andere worte stehen hier " * 60] * more]
        got = {x.doc_id: x for x in divergence.judge(make_docs(texts, ["xx"] * 13 + ["de"] * more)).collect()}
        assert got[12].class_distance is not None and got[12].class_distance > 0.25 and got[0].word_distance < 0.45


def test_packing_null_and_repeated_ids(make_docs):
    texts = ["w " * (1 + i % 90) + str(i) for i in range(400)] + ["same words"] * 30
    ids = [None if i % 2 else 3 for i in range(430)]
    rows = length_buckets.pack(make_docs(texts, ids=ids), max_len=64, multiple=8, buckets=3, budget=256, rows_per_piece=10).collect()
    want = [(i, s, min(64, n - 64 * s)) for i, t in zip(ids, texts) for n in [len(t.split()) + 1] for s in range(-(-n // 64))]
    assert sorted(((r.doc_id, r.segment, r.length) for r in rows), key=str) == sorted(want, key=str)
    assert len({(r.bucket_len, r.batch, r.slot) for r in rows}) == len(rows)
    assert all(r.slot < 256 // r.bucket_len and r.length <= r.bucket_len for r in rows)
    # slots of a bucket follow each other without gaps
    for b in {r.bucket_len for r in rows}:
        at = sorted(r.batch * (256 // b) + r.slot for r in rows if r.bucket_len == b)
        assert at == list(range(len(at)))
