import itertools
import random

import pytest
from pyspark.sql import functions as F

from solstice.functions import grid as g
from solstice.operators import cube, series, tracks


def naive_runs(values, threshold, min_run):
    out, i = [], 0
    while i < len(values):
        s = 1 if values[i] >= threshold else -1 if values[i] <= -threshold else 0
        j = i
        while s and j < len(values) and values[j] * s >= threshold:
            j += 1
        if s:
            if j - i >= min_run:
                peak = max(range(i, j), key=lambda n: (values[n] * s, -n))
                out.append((s, i, j - 1, peak))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_runs_match_a_plain_loop_for_any_block(spark, block):
    rnd = random.Random(block)
    rows, expected = [], set()
    for key in range(12):
        values = [rnd.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) if rnd.random() < 0.4 else (1.0 if key % 2 else -1.5) for _ in range(40)]
        rows += [(key, i, v, 1990 + i // 12, i % 12 + 1) for i, v in enumerate(values)]
        expected |= {(key, *r) for r in naive_runs(values, 0.5, 3)}
    df = spark.createDataFrame(rows, "key INT, pos LONG, v DOUBLE, year INT, month INT")
    got = series.find_runs(df, ["key"], ("year", "month"), 0.5, 3, block=block)
    assert {(r.key, r.sign, r.first.pos, r.last.pos, r.peak.pos) for r in got.collect()} == expected


def test_event_attributes(spark):
    values = [0.1] * 4 + [0.6, 0.9, 1.5, 2.1, 2.1, 1.0, 0.5] + [0.0] * 3
    rows = [("x", i, v, 1997 + (i + 2) // 12, (i + 2) % 12 + 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key STRING, pos LONG, v DOUBLE, year INT, month INT")
    e = series.run_events(series.find_runs(df, ["key"], ("year", "month"), 0.5, 5), ["key"]).collect()
    assert len(e) == 1
    e = e[0]
    assert (e.type, e.strength, e.n_seasons, e.peak_value) == ("el_nino", "very strong", 7, 2.1)
    assert e.start == "JJA 1997" and e.peak_season == "SON 1997" and e.anchor_year == 1997 and e.analog_label == "1997-98" and e.label == "1997-98"


def test_year_classes(spark):
    rows = [("x", y * 12 + m - 1, 0.2 if y < 1992 else 0.7, y, m) for y in range(1990, 1995) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "key STRING, pos LONG, v DOUBLE, year INT, month INT")
    strong = spark.createDataFrame([("x", 1993, "la_nina")], "key STRING, anchor_year INT, type STRING")
    got = {r.event_year: r.cls for r in series.classify_years(df, strong, ["key"], 1990, 1994).collect()}
    assert got == {1990: "neutral", 1991: "other", 1992: "other", 1993: "la_nina", 1994: "other"}
    counts = {r.cls: r.n_years for r in series.class_counts(series.classify_years(df, strong, ["key"], 1990, 1994), ["key"]).collect()}
    assert counts == {"el_nino": 0, "la_nina": 1, "neutral": 1, "other": 3}


def test_bilinear_reproduces_a_plane(spark):
    n_lat, n_lon = 72, 144
    lat0, lon0, step = -88.75, 1.25, 2.5
    src = spark.range(n_lat * n_lon).select((F.col("id") / n_lon).cast("int").alias("si"), (F.col("id") % n_lon).cast("int").alias("sj"))
    src = src.withColumn("value", 3 * (lat0 + step * F.col("si")) + 0.5)
    w = cube.bilinear_weights(g.target_grid(spark), lat0, step, n_lat, lon0, step, n_lon)
    rows = cube.bilinear_regrid(src, w).join(g.target_grid(spark), "cell_id")
    inner = rows.where(F.abs("lat") < 88)
    assert inner.where(F.abs(F.col("value") - (3 * F.col("lat") + 0.5)) > 1e-9).count() == 0
    assert rows.count() == 16200
    assert rows.where(F.col("lat") == 89).select(F.max(F.abs(F.col("value") - (3 * 88.75 + 0.5)))).first()[0] < 1e-9


def test_composite_needs_every_month_and_three_events(spark):
    rows = []
    for cell in ("x", "y"):
        for y in range(1990, 2012):
            for m in range(1, 13):
                wet = y in (1997, 1998, 2002, 2003, 2006, 2007)
                v = None if (cell == "y" and y == 2002 and m == 11) else (20.0 if wet else 10.0)
                rows.append(("a", cell, y, m, v))
    df = spark.createDataFrame(rows, "source STRING, cell STRING, year INT, month INT, value DOUBLE")
    events = spark.createDataFrame([(1, "en", 1997), (2, "en", 2002), (3, "en", 2006)], "ord INT, phase STRING, anchor INT")
    fact = {(r.cell, r.k): r for r in cube.composite_fact(df, events, 1991, 2011, "a", "b", with_vectors=True).collect()}
    assert fact["x", 10].n == 3 and fact["x", 10].wetter_frac == 100.0 and fact["x", 10].std == 0.0
    assert fact["y", 10].n == 2 and fact["y", 10].pct is None and fact["y", 10].events[1] is None
    assert fact["y", 4].n == 3
    # every cell, phase and season has a row
    assert len(fact) == 24 and fact["y", 10].wetter_frac is None
    full = fact["x", 0]
    assert full.pct == fact["x", 10].pct and full.recent == full.events


def test_source_choice_is_per_cell(spark):
    rows = [("a", "full", m, 1.0) for m in range(1, 13)] + [("a", "part", m, 1.0) for m in range(1, 12)] + [("b", "part", m, 2.0) for m in range(1, 13)]
    clim = spark.createDataFrame(rows, "source STRING, cell STRING, month INT, clim DOUBLE")
    assert {r.cell: r.source for r in cube.choose_source(clim, "a", "b").collect()} == {"full": "a", "part": "b"}


def test_uncovered_source_is_not_chosen(spark):
    rows = [("a", c, y, m, 1.0 if c == "early" or y > 1992 else None) for c in ("early", "late") for y in range(1991, 1996) for m in range(1, 13)]
    rows += [("b", c, y, m, 2.0) for c in ("late", "only_b") for y in range(1991, 1996) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "source STRING, cell STRING, year INT, month INT, value DOUBLE")
    events = spark.createDataFrame([(1, "en", 1992), (1, "ln", 1993)], "ord INT, phase STRING, anchor INT")
    fact = cube.composite_fact(df, events, 1991, 1995, "a", "b").collect()
    assert {(r.cell, r.source) for r in fact} == {("early", "a"), ("late", "b"), ("only_b", "b")} and len(fact) == 3 * 2 * 12
    want = {"early": "a", "late": "b", "only_b": "b"}
    clim = cube.climatology(df, 1991, 1995)
    assert {r.cell: r.source for r in cube.choose_source(clim, "a", "b", covered=cube.coverage(df)).collect()} == want


def test_forecast_reduction_goldens(spark):
    rows = [
        ("ok", "2026-10", 40.0, 140.0), ("ok", "2026-11", 50.0, 170.0), ("ok", "2026-12", 20.0, 80.0), ("desert", "2026-10", 60.0, 66.0), ("cap", "2026-10", 200.0, 220.0),
        ("nan", "2026-10", float("nan"), 100.0), ("nan", "2026-11", 10.0, 60.0),
    ]
    df = spark.createDataFrame(rows, "place STRING, ym STRING, anomaly DOUBLE, mean DOUBLE")
    got = {r.place: r for r in cube.forecast_reduction(df, ["place"], 3).collect()}
    assert set(got) == {"ok", "cap", "nan"}
    assert got["ok"].pct == round(100 * 110 / 280) and got["ok"].n_months == 3 and got["ok"].normal_mm == 280
    assert got["cap"].pct == 300 and got["cap"].capped
    assert got["nan"].pct == 20 and got["nan"].n_months == 1
    assert [m.pct for m in got["ok"].monthly] == [40, 42, 33]


def test_storms(spark):
    rows = [
        ("s1", 1, "1997-06-30 18:00:00", "WP", " ", "40", 10.0, 150.0), ("s1", 2, "1997-07-01 00:00:00", "EP", "70", "20", 10.5, 150.2), ("s1", 3, "1997-07-02 00:00:00", "EP", "", "", 14.0, 151.0),
        ("s2", 4, "2000-08-01 00:00:00", "NA", "", " ", 20.0, -60.0),
    ]
    df = spark.createDataFrame(rows, "sid STRING, fix_id LONG, ts STRING, basin STRING, wmo_wind STRING, usa_wind STRING, lat DOUBLE, lon DOUBLE")
    fixes = tracks.valid_fixes(df)
    got = {r.sid: r for r in tracks.storms(fixes).collect()}
    assert (got["s1"].basin, got["s1"].event_year, got["s1"].max_wind) == ("WP", 1996, 70.0)
    assert got["s2"].max_wind == -1.0
    assert tracks.storm_cells(fixes).where("sid = 's1'").count() == 2
    years = spark.createDataFrame([(1996, "el_nino"), (1997, "el_nino"), (2000, "neutral")], "event_year INT, cls STRING")
    rates = {(r.basin, r.cls): r for r in tracks.basin_rates(tracks.classed_storms(tracks.storms(fixes), years), years).collect()}
    assert len(rates) == 21
    assert rates["WP", "el_nino"].storms_per_year == 0.5 and rates["WP", "la_nina"].storms_per_year is None and rates["WP", "neutral"].storms_per_year == 0.0


def test_zonal_sum_and_gates(spark):
    from solstice.operators import gates, spatial

    px = spark.createDataFrame([(0.5, 0.5, 2.0), (0.6, 0.4, -5.0), (1.0, 1.0, 3.4), (50.0, 50.0, 0.5), (0.2, 0.2, -99.0)], "lat DOUBLE, lon DOUBLE, value DOUBLE")
    assert [(r.cell_id, r.value) for r in spatial.zonal_sum(px, nodata=-99.0).collect()] == [("+001.0_+0001.0", 5)]
    checks = gates.range_gates(px, {"value": (0, 10)}).first()
    assert checks.value == 2.0 and not checks.ok


def test_recent_share_does_not_depend_on_the_order_of_the_normals(spark):
    months = [("a", cell, 2001, m, 496.0 if m == 2 else 0.0) for cell in range(6) for m in (1, 2, 3)]
    normals = dict(zip((1, 2, 3), (282.0, 289.8, 221.8), strict=True))
    clim = [("a", cell, m, normals[m], 5) for cell, order in enumerate(itertools.permutations((1, 2, 3))) for m in order]
    # 100 * 496 / 793.6 is 62.5; added up in doubles, one order gives 63 and the two others 62
    months_of = spark.createDataFrame(months, "source STRING, cell LONG, year INT, month INT, value DOUBLE")
    clim_of = spark.createDataFrame(clim, "source STRING, cell LONG, month INT, clim DOUBLE, n LONG").coalesce(1)
    got = cube.recent_share(months_of, clim_of).collect()
    assert [(r["pct_of_normal"], r["pct_complete"]) for r in got] == [(62.0, 62.0)] * 6


def test_middle_sum_of_fewer_numbers(spark):
    rows = spark.createDataFrame([([0.1, 0.2],), ([0.3],), ([],)], "v ARRAY<DOUBLE>")
    assert [r[0] for r in rows.select(cube.middle_sum(F.col("v"))).collect()] == [0.1 + 0.2, 0.3, None]
