"""Cases that only larger tables met."""

import duckdb
import pandas as pd

from solstice.functions import text
from solstice.operators import catalog, crops
from solstice.plans import views
from solstice.plans.queries import catalog as catalog_q
from solstice.plans.queries import gazetteer as gazetteer_q


def test_index_mismatch_at_the_tolerance(spark):
    """A gap of just the tolerance is decided by the last bit of the cube root."""
    rows = [(i, x + d, x, x, x) for i, (x, d) in enumerate((k / 10, s * 0.3) for k in range(10, 100) for s in (-1, 1))]
    rows = [(i, round(a, 1), h, v, c) for i, a, h, v, c in rows]
    wide = spark.createDataFrame([*rows, (-1, 5.3, 5.0, 5.0, None)], "iso INT, inform DOUBLE, hazard DOUBLE, vulnerability DOUBLE, coping DOUBLE")
    got = {r.iso: r.gap for r in crops.index_mismatch(wide).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE w (iso INT, inform DOUBLE, hazard DOUBLE, vulnerability DOUBLE, coping DOUBLE)")
    db.executemany("INSERT INTO w VALUES (?, ?, ?, ?, ?)", rows)
    gap = "abs(pow(hazard * vulnerability * coping, 1/3.0::DOUBLE) - inform)"
    assert got == dict(db.execute(f"SELECT iso, {gap} FROM w WHERE {gap} > 0.3").fetchall())


def test_equal_sessions_leave_before_the_sets(spark):
    """Month ranges are worked out per distinct session, not per row, and the context per season, not per place."""
    kind = "iso2 STRING, crop STRING, zone STRING, all_year STRING, early_sowing INT, later_sowing INT, early_harvest INT, late_harvest INT"
    sessions = spark.createDataFrame([("KE", "Maize", "z", None, 10, 11, 2, None), ("KE", "Rice", None, "Yes", None, None, None, None)] * 50, kind)
    windows = crops.crop_windows(sessions)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3
    assert {(r.crop, tuple(r.sowing), tuple(r.harvest), r.zones, r.all_year) for r in windows.collect()} == {("Maize", (10, 11), (2,), 1, False), ("Rice", (), (), 0, True)}
    rows = [(1, "KE", [10, 12], 1), (2, "KE", [10, 12], -1), (3, "KE", None, 1), (4, None, [10, 12], 1), (5, "KE", [5], 1), (6, "XX", [10, 12], 1)]
    places = spark.createDataFrame([(*r, "farmer", 0) for r in rows] + [(7, "KE", [10, 12], 1, "urban", 50_000)], "id INT, cc STRING, months ARRAY<INT>, rain_sign INT, livelihood STRING, pop INT")
    placed = crops.with_farming_context(places, crops.country_crops(crops.usable_windows(windows)))
    assert {r.id: r.farmer and (r.farmer.crop, r.farmer.direction) for r in placed.collect()} == {1: ("maize", "wetter"), 2: ("maize", "drier"), **dict.fromkeys((3, 4, 5, 6, 7))}
    assert placed.columns == [*places.columns, "farmer"]


def test_flatten_reads_each_shape_once(spark):
    docs = spark.createDataFrame([("a", '{"x": {"y": "{["}, "l": ["1", "2"]}'), ("b", '{"x": {"y": "z"}, "l": ["3"]}')], "lang STRING, doc STRING")
    rows = {(r.lang, r.k, r.value) for r in catalog.flatten(docs, ["lang"], join_lists=True).collect()}
    assert rows == {("a", "x.y", "{["), ("a", "l", "1 | 2"), ("b", "x.y", "z"), ("b", "l", "3")}
    # a costly row of a small table has a task of its own on every core
    assert catalog_q.nested(views.Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_search_keys_are_normalised_once(spark):
    """Counting prefixes and assigning shards read stored keys: no Python step is left in the plan."""
    tables = views.Tables(spark, "/root/testdata/sf0.001")
    plan = gazetteer_q.g7(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_long_texts_are_folded_in_pieces():
    most = []
    whole, text._folded = text._folded, lambda x: (most.append(len(x)), whole(x))[1]
    try:
        out = text._norm_unicode.func(pd.Series(["Ünï  Çode", None, "日 本"] * 500))
    finally:
        text._folded = whole
    assert out.tolist() == ["ünï çode", None, "日 本"] * 500 and max(most) <= 128
