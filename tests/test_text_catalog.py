import json

from pyspark.sql import functions as F

from solstice.functions import text as tx
from solstice.operators import catalog as ct
from solstice.operators import crops, gates, textops
from solstice.plans import briefing

BULLETIN = """<html><!-- 1 January 2000 --><b>ENSO Alert System Status:</b><a>El Ni&ntilde;o Advisory</a><p>12 November 2026</p><u>Synopsis:</u>
<p>El Ni&ntilde;o continues, with a strong-to-very strong event likely (remaining greater than a 79&#37; chance).</p></html>"""


def test_bulletin(spark):
    df = spark.createDataFrame([(1, BULLETIN), (2, "<p>nothing</p>"), (3, "<b>ENSO Alert System Status</b><i>La Ni&ntilde;a / El Ni&ntilde;o Watch</i>")], "id INT, html STRING")
    got = {r.id: r for r in gates.bulletin_problems(textops.parse_bulletin(df)).collect()}
    a = got[1]
    assert (a.issued, a.status, a.phase, a.level, a.expected_strength, a.headline_probability_pct) == ("12 November 2026", "El Niño Advisory", "el_nino", "advisory", "strong", 79)
    assert a.problems == [] and got[2].status is None and len(got[2].problems) == 3 and got[2].phase == "neutral"
    assert got[3].phase == "el_nino" and got[3].level == "watch"


def test_templates_and_phrases(spark):
    row = spark.range(1).select(
        tx.fill(F.lit("{a} and {b}{c}!"), {"a": "{b}", "b": F.lit(3)}).alias("x"), tx.list_text(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("l3"), tx.list_text(F.array(F.lit("a"))).alias("l1"),
        tx.percent_phrase(F.lit(-38.0), "none", "normal", "{n} more", "{n} less").alias("p"), tx.percent_phrase(F.lit(4.4), "none", "normal", "m", "l").alias("q"),
        tx.slot_signature(F.lit("{b} x {a} {b}")).alias("s"), tx.html_escape(F.lit('<a href="x">&</a>')).alias("h"),
    ).first()
    assert row.x == "{b} and 3!" and row.l3 == "a, b and c" and row.l1 == "a" and row.p == "38 less" and row.q == "normal"
    assert row.s == "{a},{b},{b}" and row.h == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"


def test_lint_and_reading(spark):
    texts = [("a", "Act NOW! This is urgent."), ("b", "Only 3 days left. See NOAA."), ("c", "{slot} " + "word " * 23 + "end."), ("d", "épanic is not panicky"), ("e", "A calm line.")]
    got = {(r.key, r.rule, r.match) for r in textops.lint(spark.createDataFrame(texts, "key STRING, text STRING")).collect()}
    assert got == {("a", "exclamation", "!"), ("a", "banned word", "Act NOW"), ("a", "capitals", "NOW"), ("b", "countdown", "3 days left"), ("c", "long sentence", "25"), ("d", "banned word", "panic")}
    r = spark.range(1).select(tx.reading_counts(F.lit("The cat sat. It ate the whole apple! Ok")).alias("c")).first().c
    assert (r.sentences, r.words) == (2, 8) and r.syllables == 8
    m = spark.range(1).select(briefing.short_message(F.lit("h" * 150), F.array(F.lit("step " * 5))).alias("m")).first().m
    assert len(m) == 160 and m.endswith("...")


def test_staples_and_classes(spark):
    names = [("Soybean", "beans"), ("Buckwheat", "wheat"), ("Maize (corn)", "maize"), ("Sweet Potato", "potato"), ("Tea", None), ("Plantain", "banana")]
    df = spark.createDataFrame(names, "n STRING, want STRING")
    assert df.where(~crops.first_keyword_class(F.col("n")).eqNullSafe(F.col("want"))).count() == 0
    df = spark.createDataFrame([(7.8, "very high"), (6.0, "high"), (3.1, "low"), (3.5, "medium"), (1.9, "very low")], "x DOUBLE, want STRING")
    assert df.where(crops.index_class(F.col("x")) != F.col("want")).count() == 0


DOC = {"_lang": "en", "title": "Hi {name}", "ui": {"_note": "x", "a": "1", "deep": {"b": "{not json"}}, "months": ["Jan", "Feb"]}


def test_flatten_and_back(spark):
    df = spark.createDataFrame([("en", json.dumps(DOC))], "lang STRING, doc STRING")
    rows = ct.flatten(df, ["lang"], join_lists=True)
    assert {r.k: r.value for r in rows.collect()} == {"title": "Hi {name}", "ui.a": "1", "ui.deep.b": "{not json", "months": "Jan | Feb"}
    back = json.loads(ct.unflatten(rows, ["lang"]).first().doc)
    assert back == {"title": "Hi {name}", "ui": {"a": "1", "deep": {"b": "{not json"}}, "months": "Jan | Feb"}


def test_delta_cycle(spark):
    source = spark.createDataFrame([("a", "A {x}"), ("b", "B"), ("c", "C"), ("m", "Jan | Feb")], "k STRING, value STRING")
    hashed = {r.k: r.h for r in source.select("k", ct.source_hash(F.col("value")).alias("h")).collect()}
    target = spark.createDataFrame([("a", "ta", hashed["a"], True), ("b", "tb", "old", False), ("z", "tz", "h", True)], "k STRING, value STRING, src_hash STRING, mt BOOLEAN")
    assert {r.k: r.reason for r in ct.needs_work(source, target).collect()} == {"b": "changed", "c": "missing", "m": "missing"}
    assert [r.k for r in ct.stale_keys(source, target).collect()] == ["z"]
    new = spark.createDataFrame([("b", "nb"), ("nope", "x")], "k STRING, value STRING")
    lists = spark.createDataFrame([("m",)], "k STRING")
    out = {r.k: r for r in ct.apply_translations(source, target, new, lists).collect()}
    assert set(out) == {"a", "b", "m"} and out["b"].value == "nb" and out["b"].src_hash == hashed["b"] and out["b"].mt and out["m"].value == "Jan | Feb" and out["a"].value == "ta"
    fixes = spark.createDataFrame([("fr", "a", "X {x}"), ("fr", "a", "X"), ("fr", "q", "Q")], "lang STRING, k STRING, fix STRING")
    assert sorted(r.status for r in ct.check_fixes(source, fixes).collect()) == ["applied", "slot mismatch", "unknown key"]
    overlay = {r.k: r.value for r in ct.overlay(source, target.select("k", "value")).collect()}
    assert overlay == {"a": "ta", "b": "tb", "c": "C", "m": "Jan | Feb"}
    maps = briefing.language_maps(spark.createDataFrame([("en", "a", "A"), ("en", "b", "B"), ("fr", "a", "AA")], "lang STRING, key STRING, value STRING"))
    assert {r.lang: r.strings for r in maps.collect()} == {"en": {"a": "A", "b": "B"}, "fr": {"a": "AA", "b": "B"}}


def test_numbering_over_blocks(spark):
    df = spark.range(1000).withColumn("value", F.lit("x"))
    got = ct.numbered(df, "id", F.floor(F.col("id") / 77))
    assert got.where("rn <> id").count() == 0
    assert ct.work_batches(df, "id", F.floor(F.col("id") / 77)).select(F.max("keys"), F.count("*")).first() == (60, 17)


def test_freshness(spark):
    layers = spark.createDataFrame([("status", "2026-08-01 00:00:00", False), ("conditions", "2026-09-01 00:00:00", False), ("composites", None, False)], "layer STRING, as_of STRING, missing BOOLEAN")
    layers = layers.withColumn("as_of", F.col("as_of").cast("timestamp"))
    limits = spark.createDataFrame([("status", 45), ("forecast", 45), ("conditions", 21), ("composites", 400)], "layer STRING, max_days INT")
    rep = gates.freshness(layers, limits, "2026-10-01 00:00:00")
    assert {r.layer: r.stale for r in rep.collect()} == {"status": True, "forecast": None, "conditions": True, "composites": True}
    assert gates.any_stale(rep).first() == (True, 3)


def test_documents_of_any_depth_come_back(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":"x{[\\"","_p":"y"}}},"l":["1","2"]}}}},"z":"w"}'
    docs = spark.createDataFrame([(1, deep), (2, '{"k":"v"}')], "id INT, doc STRING")
    want = {(1, "a.b.c.d.e.f.g.h", 'x{["'), (1, "a.b.c.d.l", "1 | 2"), (1, "z", "w"), (2, "k", "v")}
    flat = ct.flatten(docs, ["id"], join_lists=True)
    assert {tuple(r) for r in flat.collect()} == want
    assert {tuple(r) for r in ct.flatten(ct.unflatten(flat, ["id"]), ["id"]).collect()} == want


def test_runs_with_too_little_left_fail(spark):
    good, bad = gates.quarantine(spark.range(10).withColumn("u", F.col("id") % 3), "u", F.when(F.col("id") == 4, "odd"))
    assert gates.require_rows(good, 2, "u").count() == 7 and bad.count() == 1
    for args in ((8,), (3, "u")):
        try:
            gates.require_rows(good, *args)
        except gates.TooFewRows:
            continue
        raise AssertionError(args)


def test_grid_difference_of_repeated_points(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "i INT, j INT")
    b = spark.createDataFrame([(1, 1), (3, 3), (3, 3)], "i INT, j INT")
    assert {tuple(r) for r in gates.grid_difference(a, b).collect()} == {(2, 2, "first"), (3, 3, "second")}
