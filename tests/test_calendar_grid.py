import datetime as dt

from pyspark.sql import functions as F

from solstice.functions import calendar as c
from solstice.functions import grid as g
from solstice.operators import spatial


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first().asDict(recursive=True)


def months(*m):
    return F.array(*[F.lit(x) for x in m])


def test_season_parsing_index_and_timing(spark):
    now = F.to_date(F.lit("2026-09-07"))
    ond = c.parse_season(F.lit("Oct-Dec"))
    djfm = c.parse_season(F.lit("Dec-Mar"))
    jja = months(6, 7, 8)
    r = one(
        spark, a=ond, b=djfm, none=c.parse_season(F.lit("spring")), every=c.parse_season(F.lit("All year")), null=c.parse_season(F.lit(None).cast("string")),
        ia=c.season_index(ond), ib=c.season_index(djfm), ta=c.season_timing(ond, now), tj=c.season_timing(jja, now),
        ym=c.season_year_months(ond, F.lit(2026)), wrap=c.season_year_months(djfm, F.lit(2026)), label=c.season_label(djfm, F.lit(2026), F.lit(2027)),
        short=c.season_label(ond, F.lit(2026), F.lit(2026)),
    )
    assert r["a"] == [10, 11, 12] and r["b"] == [12, 1, 2, 3] and r["none"] == [] and r["every"] == list(range(1, 13)) == r["null"]
    assert r["ia"] == 10 and r["ib"] == 0
    assert r["ta"] == {"state": "coming", "start_year": 2026, "end_year": 2026, "months_away": 1}
    assert r["tj"]["state"] == "passed" and r["tj"]["start_year"] == 2027
    assert r["ym"] == ["2026-10", "2026-11", "2026-12"] and r["wrap"] == ["2026-12", "2027-01", "2027-02", "2027-03"]
    assert r["label"] == "Dec–Mar 2026-27" and r["short"] == "Oct–Dec 2026"


def test_season_months_follow_labels_or_start_early(spark):
    rows = c.season_month_table(spark).orderBy("k", "pos").collect()
    by_k = {k: [r for r in rows if r.k == k] for k in range(12)}
    letters = "JFMAMJJASOND"
    for k, label in enumerate(c.SEASONS):
        assert "".join(letters[r.month - 1] for r in by_k[k]) == label
    assert [r.year_offset for r in by_k[0]] == [0, 1, 1] and [r.year_offset for r in by_k[11]] == [0, 0, 1]
    early = {r.k: [] for r in rows}
    for r in c.season_month_table(spark, -1).orderBy("k", "pos").collect():
        early[r.k].append(r.month)
    assert early[0] == [11, 12, 1] and early[10] == [9, 10, 11]


def test_month_ranges_and_circular_runs(spark):
    every = F.sequence(F.lit(1), F.lit(12))
    r = one(
        spark, wrap=c.month_range(F.lit(11), F.lit(2)), one=c.month_range(F.lit(3), F.lit(3)), none=c.month_range(F.lit(None).cast("int"), F.lit(3)),
        run=c.circular_run(months(11, 12, 1, 5), F.lit(12)), lone=c.circular_run(months(11, 12, 1, 5), F.lit(5)), off=c.circular_run(months(1, 2), F.lit(6)),
        full=c.circular_run(every, F.lit(7)), eleven=c.circular_run(months(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12), F.lit(12)),
    )
    assert r["wrap"] == [11, 12, 1, 2] and r["one"] == [3] and r["none"] == []
    assert r["run"] == [11, 12, 1] and r["lone"] == [5] and r["off"] is None
    assert sorted(r["full"]) == list(range(1, 13)) and len(r["full"]) == 12
    assert r["eleven"] == [12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_decoding_and_weekly_map(spark):
    days = [dt.date(2026, 9, 7) + dt.timedelta(i) for i in range(7)]  # Monday to Sunday
    rows = spark.createDataFrame([(d,) for d in days], "d DATE").select("d", c.latest_weekly_map(F.col("d")).alias("m")).collect()
    for r in rows:
        expected = r.d - dt.timedelta((r.d.weekday() - 1) % 7) - dt.timedelta(7 if r.d.weekday() == 2 else 0)
        assert r.m == expected
    a = c.months_since(F.lit(780.5), 1960, 1)
    b = c.months_since(F.lit(780.0), 1960, 1)
    r = one(spark, y=c.index_year(a), m=c.index_month(a), y2=c.index_year(b), m2=c.index_month(b), feb=c.days_in_month(F.lit(2000), F.lit(2)), y1900=c.days_in_month(F.lit(1900), F.lit(2)))
    assert (r["y"], r["m"], r["y2"], r["m2"], r["feb"], r["y1900"]) == (2025, 1, 2025, 1, 29, 28)


def test_cell_ids_and_ties(spark):
    point = [(-1.3, 36.8), (0.0, 0.0), (2.0, 180.0), (-90.0, -180.0), (88.0, -179.5)]
    df = spark.createDataFrame(point, "lat DOUBLE, lon DOUBLE")
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select(
        g.cell_id(lat, lon, "half_even").alias("even"), g.cell_id(lat, lon, "half_up").alias("up"), g.cell_id(lat, lon, "half_down").alias("down"),
        g.lat_index(lat).alias("i"), g.lon_index(lon).alias("j"),
    ).collect()
    assert rows[0].up == rows[0].even == rows[0].down == "-001.0_+0037.0"
    assert (rows[1].even, rows[1].up, rows[1].down) == ("-001.0_-0001.0", "+001.0_+0001.0", "-001.0_-0001.0")
    assert rows[1].i == 44 and rows[1].j == 89
    assert rows[2].even.endswith("_+0179.0") and rows[2].up.endswith("_-0179.0")
    assert rows[3].up.startswith("-089.0") and rows[4].up.startswith("+089.0")


def test_snapping_prefers_near_land(spark):
    land = spark.createDataFrame([(44, 90), (44, 179), (10, 10)], "i INT, j INT")
    points = spark.createDataFrame([(1, -1.0, 5.0), (2, -1.0, 1.0), (3, -1.0, -178.0), (4, 60.0, 60.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {r.id: r.cell_id for r in spatial.snap_to_land(points, land).collect()}
    assert got[1] == "-001.0_+0001.0"  # two cells west
    assert got[2] == "-001.0_+0001.0"  # own cell
    assert got[3] == "-001.0_+0179.0"  # across the date line
    assert got[4] == "+059.0_+0059.0"  # no land in reach: own cell (lower index on the tie)


def test_polygons_with_hole(spark):
    def ring(pid, pts):
        return [(pid, *map(float, pts[i]), *map(float, pts[(i + 1) % len(pts)])) for i in range(len(pts))]

    edges = ring(1, [(0, 0), (20, 0), (20, 20), (0, 20)]) + ring(1, [(5, 5), (15, 5), (15, 15), (5, 15)]) + ring(2, [(10, 10), (40, 10), (25, 40)])
    edges = spark.createDataFrame(edges, "poly_id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    pts = spark.createDataFrame([(1, 2.5, 2.5), (2, 10.5, 9.5), (3, 12.5, 18.5), (4, 30.5, 25.0), (5, -10.0, 0.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {(r.id, r.poly_id) for r in spatial.points_in_polygons(pts, edges, ["id"]).collect()}
    assert got == {(1, 1), (3, 1), (3, 2), (4, 2)}


def test_regions_of_points_also_outside_all_boxes(spark):
    boxes = spark.createDataFrame([(1, -10.0, 10.0, -10.0, 10.0), (1, 0.0, 30.0, 0.0, 30.0), (2, 5.0, 5.0, 5.0, 60.0), (3, -20.0, 90.0, -180.0, 180.0)], "region_id INT, lat0 DOUBLE, lat1 DOUBLE, lon0 DOUBLE, lon1 DOUBLE")
    regions = spark.createDataFrame([(1, "A", 1, 0), (2, "B", 5, 1), (3, "C", 1, 2)], "region_id INT, name STRING, priority INT, ord INT")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, -10.0), (3, -50.0, 100.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {r.id: [x.name for x in r.regions] for r in spatial.with_regions(pts, boxes, regions).collect()}
    assert got == {1: ["B", "A", "C"], 2: ["A", "C"], 3: []}
