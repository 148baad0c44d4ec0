import math
import random

from pyspark.sql import functions as F

from solstice.operators import spatial

SIDES = "poly_id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"


def ring(pid, pts):
    return [(pid, *map(float, pts[i]), *map(float, pts[(i + 1) % len(pts)])) for i in range(len(pts))]


def star(rnd, pid, lat, lon, size, corners):
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(corners))
    return ring(pid, [(lon + r * math.cos(a), lat + r * math.sin(a)) for a in turns for r in [size * rnd.uniform(0.3, 1)]])


def hits(df):
    return sorted((r.id, r.poly_id) for r in df.collect())


def test_cover_gives_what_the_sides_give(spark):
    rnd = random.Random(11)
    rows = [s for pid in range(12) for s in star(rnd, pid, rnd.uniform(-50, 50), rnd.uniform(-120, 120), rnd.choice([0.3, 5, 35]), rnd.choice([3, 9, 60]))]
    rows += ring(50, [(-64, -32), (64, -32), (64, 32), (-64, 32)]) + ring(50, [(-32, -16), (32, -16), (32, 16), (-32, 16)])  # sides on cell edges, a hole
    rows += ring(51, [(0, 0), (40, 40), (40, 0), (0, 40)])  # crosses itself
    rows += ring(52, [(10, 10), (20, 10), (20, 20), (10, 20)])[:3]  # does not close
    rows += [*ring(53, [(30, 30), (50, 30), (40, 50)]), (53, None, 1.0, 2.0, 3.0)]  # a side without a place
    rows += ring(54, [(0, 0), (30, 1e-9), (60, 0), (30, 5)]) + ring(54, [(7, 7), (7, 7)])  # nearly flat, and a point
    edges = spark.createDataFrame(rows, SIDES)
    spots = [(rnd.uniform(-80, 80), rnd.uniform(-170, 170)) for _ in range(1500)] + [(float(a), float(b)) for a in range(-48, 49, 4) for b in range(-64, 65, 8)]
    spots += [(y, x) for _, x, y, _, _ in rows if x is not None][:150]  # corners
    spots += [(None, 1.0), (float("nan"), 1.0), (5.0, float("inf")), (95.0, 200.0), (spots[0])]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id INT, lat DOUBLE, lon DOUBLE")
    cover = spatial.polygon_cover(edges).cache()
    want = hits(spatial.points_in_polygons(points, edges, ["id"]))
    assert len(want) > 500
    assert hits(spatial.points_in_cover(points, cover, edges, ["id"])) == want
    # equal points under one key are one
    assert hits(spatial.points_in_cover(points.unionAll(points), cover, edges, ["id"])) == want
    # other sizes, the same rows
    assert hits(spatial.points_in_cover(points, spatial.polygon_cover(edges, (8.0, 2.0)), edges, ["id"], (8.0, 2.0))) == want
    # no cell of a polygon lies in another of its cells
    scale = {0: 16, 1: 4, 2: 1}
    leaves = [(r.poly_id, r.level, r.ci, r.cj) for r in cover.collect()]
    assert len(set(leaves)) == len(leaves)
    seen = set(leaves)
    assert not [c for c in leaves for up in range(c[1]) if (c[0], up, c[2] * scale[c[1]] // scale[up], c[3] * scale[c[1]] // scale[up]) in seen]


def test_interior_points_meet_no_sides(spark):
    circle = ring(1, [(45 * math.cos(2 * math.pi * k / 2000), 45 * math.sin(2 * math.pi * k / 2000)) for k in range(2000)])
    edges = spark.createDataFrame(circle, SIDES)
    cover = spatial.polygon_cover(edges).cache()
    rnd = random.Random(2)
    points = spark.createDataFrame([(i, rnd.uniform(-45, 45), rnd.uniform(-45, 45)) for i in range(3000)], "id INT, lat DOUBLE, lon DOUBLE")
    found = spatial.cover_matches(points, cover, ["id"])
    tested, sure = found.where("NOT inside").count(), found.where("inside").count()
    assert tested * 10 < 3000 < 2 * sure
    assert hits(spatial.points_in_cover(points, cover, edges, ["id"])) == hits(spatial.points_in_polygons(points, edges, ["id"]))
    # the cover follows the outline: a few cells a degree, not one per square degree
    assert cover.where("inside").count() < 600 < cover.where("inside").select(F.sum(F.expr("CASE level WHEN 0 THEN 256 WHEN 1 THEN 16 ELSE 1 END"))).first()[0]


def test_no_polygons(spark):
    edges = spark.createDataFrame([], SIDES)
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id INT, lat DOUBLE, lon DOUBLE")
    assert hits(spatial.points_in_cover(points, spatial.polygon_cover(edges), edges, ["id"])) == []
