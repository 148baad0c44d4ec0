import json
import os

import pytest
from pyspark.sql import functions as F

from solstice.operators import gates, tracks
from solstice.sources import readers as rd
from solstice.sources import sinks
from solstice.streaming import refresh


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_country_overrides_are_keyed_by_file_name(spark, scratch):
    write(f"{scratch}/c/KE.json", json.dumps({"season_names": {"east-africa": "the short rains"}, "hazards_add": {"el_nino": ["RVF"]}}, indent=1))
    write(f"{scratch}/c/PE.json", json.dumps({"hazards_add": {"el_nino": ["FL", "LS"]}}))
    rows = rd.read_country_overrides(spark, f"{scratch}/c")
    assert {r.iso2 for r in rows.collect()} == {"KE", "PE"}
    assert [tuple(r) for r in rd.override_seasons(rows).collect()] == [("KE", "east-africa", "the short rains")]
    assert {r.cc: r.hazards_add for r in rd.override_hazards(rows).collect()} == {"KE": ["RVF"], "PE": ["FL", "LS"]}


def test_text_layouts(spark, scratch):
    p = write(f"{scratch}/oni.txt", " SEAS  YR   TOTAL   ANOM\n DJF 1950   24.72  -1.53\n JFM 1950   25.17  -1.34\n\n bad\n")
    assert [tuple(r) for r in rd.read_index_series(spark, p).collect()] == [("DJF", 1950, -1.53), ("JFM", 1950, -1.34)]
    fields = ["7", 'Saint "Q', "Saint Q", "", "1.5", "2.5", "P", "PPL", "KE", "", "01", "002", "", "", "", "", "", "UTC", "2026"]
    p = write(f"{scratch}/places.txt", "\t".join(fields) + "\n" + "\t".join(fields[:10]) + "\n" + "\t".join(["8", *fields[1:14], "1200"]) + "\n")
    assert [(r.id, r.name, r["pop"]) for r in rd.read_places(spark, p).collect()] == [(7, 'Saint "Q', 0), (8, 'Saint "Q', 1200)]
    p = write(f"{scratch}/tc.csv", "SID,ISO_TIME,LAT,LON,WMO_WIND,BASIN,NATURE\n , ,degrees_north,degrees_east,kts, , \n1980S1,1980-01-01 00:00:00,-10.5,100.0,45,SI,TS\n")
    rows = rd.read_fixes(spark, p).collect()
    assert len(rows) == 1 and rows[0].usa_wind is None and rows[0].lat == -10.5
    p = write(f"{scratch}/review.csv", '"key","english","translation","status"\n"a","say ""hi""","dis ""x""","machine"\n\n"b","B"," ","pending"\n')
    assert [tuple(r) for r in rd.read_review_sheet(spark, p).collect()] == [("a", 'say "hi"', 'dis "x"', "machine"), ("b", "B", " ", "pending")]


def test_geojson_rings(spark, scratch):
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ISO_N3": "404", "X": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"ISO_N3": "-99"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [hole]]}}]}
    polygons = rd.read_polygons(spark, write(f"{scratch}/p.json", json.dumps(doc, indent=1)), "ISO_N3 STRING")
    assert [(r.ord, r.ISO_N3, len(r.polygons)) for r in polygons.collect()] == [(0, "404", 1), (1, "-99", 2)]
    edges = rd.polygon_edges(polygons)
    assert edges.groupBy("poly_id").count().orderBy("poly_id").collect() == [(0, 8), (1, 8)]


def test_bad_country_is_set_aside(spark, scratch):
    good = {"country": "KE", "records": [{"crop": {"name": " Maize "}, "aez": {"name": "z"}, "sessions": [{"early_sowing": {"month": 3}}, {"all_year": "Yes"}]}, {"crop": {"name": ""}, "sessions": []}]}
    p = write(f"{scratch}/cal.json", json.dumps(good) + '\n{"country": "UG", "records": [\n')
    rows, bad = rd.read_crop_sessions(spark, p)
    assert [(r.iso2, r.crop, r.early_sowing, r.all_year) for r in rows.collect()] == [("KE", "Maize", 3, None), ("KE", "Maize", None, "Yes")]
    assert bad.count() == 1


def test_publication_keeps_the_last_good_build(spark, scratch):
    root = f"{scratch}/pub"
    assert sinks.current(spark, root) is None
    check = lambda df: gates.size_gate(df, "rows", 2, 10)
    sinks.publish(spark.range(3), root, check)
    with pytest.raises(sinks.GateFailed):
        sinks.publish(spark.range(1), root, check)
    assert sinks.current(spark, root).count() == 3
    sinks.publish(spark.range(5), root, check)
    assert sinks.current(spark, root).count() == 5


def test_incremental_refresh(spark, scratch):
    land, root, state = f"{scratch}/land", f"{scratch}/root", f"{scratch}/state"
    check = lambda df: gates.range_gates(df, {"v": (0, 100)})

    def arrive(*values):
        spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").coalesce(1).write.mode("append").parquet(land)

    def run():
        return refresh.refresh(refresh.file_stream(spark, land, "v DOUBLE"), root, state, gates=check)

    arrive(1, 2)
    assert run() == [] and sinks.current(spark, root).count() == 2
    arrive(500)
    assert [e for e, _ in run()] == [1] and sinks.current(spark, root).count() == 2
    arrive(3)
    assert run() == [] and sinks.current(spark, root).count() == 3
    assert run() == [] and sinks.current(spark, root).count() == 3
    # a corrected copy arrives, and later the limit that refused the first one is lifted
    arrive(50)
    assert run() == [] and sinks.current(spark, root).count() == 4 and len(sinks.refused(spark, root)) == 1
    check = lambda df: gates.range_gates(df, {"v": (0, 1000)})
    assert run() == [] and sinks.current(spark, root).count() == 5 and sinks.refused(spark, root) == []
    assert len(sinks.compact(spark, root).paths) == 1 and sinks.current(spark, root).count() == 5
    arrive(4)
    assert run() == [] and sinks.current(spark, root).count() == 6


def test_streamed_storms_equal_the_batch(spark, scratch):
    ddl = "sid STRING, fix_id LONG, ts TIMESTAMP, basin STRING, wmo_wind STRING, usa_wind STRING, lat DOUBLE, lon DOUBLE"
    rows = [(f"s{i % 5}", i, f"2000-08-{1 + (i * 7) % 28:02d} 00:00:00", "WP" if i % 2 else "EP", "" if i % 3 == 0 else str(20 + i), " ", 10.0 + i % 4, 120.0 + i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, ddl.replace("TIMESTAMP", "STRING")).withColumn("ts", F.col("ts").cast("timestamp"))
    land, out, state = f"{scratch}/fixes", f"{scratch}/out", f"{scratch}/ck"
    for part in range(4):  # later files hold earlier fixes too
        df.where(F.col("fix_id") % 4 == part).coalesce(1).write.mode("append").parquet(land)
        if part in (1, 3):
            refresh.storm_stream(refresh.file_stream(spark, land, ddl, max_files=1), out, state, delay="60 days")
    got = {tuple(r) for r in refresh.storm_state(spark, out).collect()}
    assert got == {tuple(r) for r in tracks.storms(df).drop("event_year").collect()}
    assert {tuple(r) for r in refresh.storm_cells(spark, out).collect()} == {tuple(r) for r in tracks.storm_cells(df).collect()}


def test_quantities(spark):
    r = spark.range(1).select(sinks.whole(F.lit(2.5)).alias("a"), sinks.whole(F.lit(3.5)).alias("b"), sinks.significant(F.lit(0.00123456), 3).alias("c"), sinks.significant(F.lit(0.0), 3).alias("d"), sinks.significant(F.lit(-2794.5), 3).alias("e")).first()
    assert tuple(r) == (2.0, 4.0, 0.001235, 0.0, -2794.0)


def test_measures_are_taken_while_writing(spark, scratch):
    """One job that reads the input once, the same refusals as the gates on the written table."""
    root, land = f"{scratch}/measured", f"{scratch}/land-measured"
    spark.range(1000).selectExpr("id", "CASE WHEN id = 7 THEN NULL ELSE id / 10 END AS v").repartition(3).write.parquet(land)
    rows = spark.read.parquet(land)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    checks = [*sinks.range_measures({"v": (0, 100), "id": (0, 5000)}), *sinks.finite_measures(["v"]), sinks.size_measure("rows", 500, 2000)]
    sinks.publish(rows.mapInArrow(counted, rows.schema), root, checks)
    assert read.value == 1000 and sinks.current(spark, root).count() == 1000
    bad = {
        "range of v": rows.withColumn("v", F.col("v") * 2), "finite v": rows.withColumn("v", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("v"))),
        "rows": rows.limit(10), "range of id": rows.withColumn("id", -F.col("id")),
    }
    for gate, df in bad.items():
        with pytest.raises(sinks.GateFailed, match=gate) as refusal:
            sinks.publish(df, root, checks)
        # what was written fails the same gates when it is measured again
        assert sinks._failed(checks, spark.read.parquet(refusal.value.path)) == str(refusal.value).split(", ")
    assert sinks.current(spark, root).count() == 1000
    with pytest.raises(sinks.GateFailed):
        sinks.publish(rows.limit(0), root, [sinks.size_measure("rows", 1, 9), sinks.size_measure("sum", 0, 9, F.sum("v"))])
    sinks.publish(rows.limit(3), root, [])
    assert sinks.current(spark, root).count() == 3


def test_ended_storms_leave_the_state_and_late_fixes_count(spark, scratch):
    ddl = "sid STRING, fix_id LONG, ts TIMESTAMP, basin STRING, wmo_wind STRING, usa_wind STRING, lat DOUBLE, lon DOUBLE"
    land, out, state = f"{scratch}/late-fixes", f"{scratch}/late-out", f"{scratch}/late-ck"
    made = []

    def arrive(*rows):
        df = spark.createDataFrame([(sid, i, day + " 00:00:00", "WP", str(w), "", 10.0, 120.0 + i) for sid, i, day, w in rows], ddl.replace("TIMESTAMP", "STRING"))
        made.append(df.withColumn("ts", F.col("ts").cast("timestamp")))
        made[-1].coalesce(1).write.mode("append").parquet(land)
        return refresh.storm_stream(refresh.file_stream(spark, land, ddl, max_files=1), out, state, delay="30 days", span="10 days")

    left = arrive(("a", 1, "2000-01-05", 40), ("a", 2, "2000-01-06", 50), ("b", 3, "2000-01-07", 30))
    assert left["storms"] >= 2
    # twenty days on: a late fix before a's first one, inside the delay, with more wind
    arrive(("c", 4, "2000-01-27", 35), ("a", 5, "2000-01-04", 90))
    assert ("a", 90.0) in {(r.sid, r.max_wind) for r in refresh.storm_state(spark, out).collect()}
    # half a year on, all three have ended; what is left is the new storm
    left = arrive(("d", 6, "2000-07-05", 60))
    left = arrive(("d", 7, "2000-07-06", 65))
    # one storm in one span, and its cells
    assert left == {"storms": 1, "cells": tracks.storm_cells(made[2].unionByName(made[3])).count()}
    assert {r.sid for r in refresh.ended_storms(spark, out).collect()} == {"a", "b", "c"}
    whole = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    want = {tuple(r) for r in tracks.storms(whole).drop("event_year").collect()}
    assert {tuple(r) for r in refresh.storm_state(spark, out).collect()} == want
    # a storm that wakes up after it has left the state adds to what was written of it
    arrive(("a", 8, "2000-07-07", 100))
    refresh.fold_storms(spark, out, f"{scratch}/folded")
    for folder in (out, f"{scratch}/folded"):
        got = {r.sid: (r.glon, r.max_wind) for r in refresh.storm_state(spark, folder).collect()}
        assert got["a"] == (125.0, 100.0) and len(got) == 4
        assert {tuple(r) for r in refresh.storm_cells(spark, folder).collect()} == {tuple(r) for r in tracks.storm_cells(whole.unionByName(made[4])).collect()}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_manifest_pages_cover_the_sorted_keys(spark, scratch, size):
    keys = [f"k{i * 37 % 101:03d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k STRING").repartition(6)
    pages = {r.page: r for r in sinks.manifest_pages(df, "k", f"{scratch}/pages", page_size=size).collect()}
    want = sorted(set(keys))
    assert sorted(pages) == list(range(-(-len(want) // size)))
    assert [k for p in sorted(pages) for k in pages[p]["keys"]] == want
    assert all(r.n_keys <= size and r.first == r["keys"][0] and r.last == r["keys"][-1] for r in pages.values()) and sum(r["count"] for r in pages.values()) == 300
    assert sinks.manifest_pages(df.limit(0), "k", f"{scratch}/none", page_size=size).count() == 0
