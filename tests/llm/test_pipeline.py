import random

import corpus_pipeline
from solstice.llm import queries
from test_corpus import prose


def test_stages_keep_columns_and_do_their_work(spark, tmp_path, make_docs):
    r = random.Random(11)
    clean = [prose(r, 80) for _ in range(60)]
    items = [prose(r, 30) for _ in range(3)]
    texts = clean + ["QX#" * 100] + [clean[3], clean[4] + " more"] + [prose(r, 30) + " " + items[1] + " " + prose(r, 30)] + [prose(r, 50) + " a.b@c.org " + prose(r, 30)] + [None, None]
    ids = [*range(len(texts) - 2), None, None]
    docs = make_docs(texts, ids=ids)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert sorted(kept.columns) == sorted(docs.columns)
        left[name] = {x.doc_id: x.text for x in kept.collect()}
    assert 60 not in left["quality"] and len(left["quality"]) == len(texts) - 2
    assert {61, 62} & set(left["near_duplicates"]) == set() and 63 in left["near_duplicates"]
    assert 63 not in left["decontamination"] and set(range(60)) <= set(left["decontamination"])
    assert "<EMAIL>" in left["personal_data"][64] and left["personal_data"][5] == clean[5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(left["personal_data"]) and sum(x.doc_id is None for x in packed) == 2


def test_repeated_rows_stay_once(spark, make_docs, tmp_path):
    r = random.Random(12)
    a = prose(r, 40)
    rows = corpus_pipeline.near_duplicates(spark, make_docs([a, a, prose(r, 40), a], ids=[3, 3, 4, 7]), "").collect()
    assert sorted(x.doc_id for x in rows) == [3, 4]


def test_verdicts_name_rows_not_ids(spark, make_docs, tmp_path):
    r = random.Random(15)
    a, b, c, item = prose(r, 60), prose(r, 60), prose(r, 60), prose(r, 30)
    left = lambda f, docs: sorted(((x.doc_id, x.text) for x in f(spark, docs, str(tmp_path)).collect()), key=str)
    # A copy without an id goes; a text of its own under a repeated id stays; near copies under one id stay once.
    got = left(corpus_pipeline.near_duplicates, make_docs([a, a, a, b, c, c + " more"], ids=[1, None, 2, 2, 3, 3]))
    assert len(got) == 3 and {(1, a), (2, b)} < set(got) and sum(i == 3 for i, _ in got) == 1
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = a + " " + item + " " + b
    assert left(corpus_pipeline.decontamination, make_docs([held, held, c, b], ids=[None, 4, 4, None])) == sorted([(4, c), (None, b)], key=str)
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [prose(r, 80) for _ in range(50)]
    rest = left(corpus_pipeline.quality, make_docs([*clean, "QX#" * 100, clean[0]], ids=[*range(50), None, None]))
    assert "QX#" * 100 not in [t for _, t in rest] and (None, clean[0]) in rest


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_empty_documents_pass_through_all_stages(spark, make_docs, tmp_path):
    r = random.Random(13)
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(r, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_tells_rare_characters_apart_and_judges_short_texts(spark, make_docs, tmp_path):
    r = random.Random(23)
    letters = [chr(0x4E00 + i) for i in range(600)]
    words = ["".join(r.choice(letters) for _ in range(3)) for _ in range(200)]
    some = lambda n: "".join(r.choice(words) for _ in range(n))
    # Other characters, whose codes leave the same rest by four.
    other = lambda t: "".join(r.choice(letters[ord(c) % 4 :: 4]) for c in t)
    good = [some(100) for _ in range(200)] + [some(r.randint(5, 30)) for _ in range(100)]
    bad = [other(some(100)) for _ in range(3)] + [other(some(10)) for _ in range(3)]
    docs = make_docs([*good, *bad, bad[0], bad[0]], ids=[*range(306), 7, None])
    spark.createDataFrame([(i, 1, 0) for i in range(300) if i != 7], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [x.text for x in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()]
    assert not set(left) & set(bad) and set(left) <= set(good) and len(left) >= 294
