"""Spatial joins and zonal sums."""

from pyspark.sql import functions as F

from solstice.functions import grid as g
from solstice.operators import gazetteer, spatial
from solstice.plans import sqltext as s
from solstice.plans.registry import query
from solstice.sources.scratch import stored

CROSS = "(e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1"
HITS_SQL = f"SELECT p.id, e.poly_id, any_value(e.category) AS category FROM v_point p JOIN v_edge e ON {CROSS} GROUP BY 1, 2 HAVING count(*) % 2 = 1"
LAND_SQL = f"SELECT DISTINCT {s.lat_index('lat')} AS i, {s.lon_index('lon')} AS j FROM v_place"


def land(t):
    """Cells that hold a place stand for land."""
    return t.place.select(g.lat_index(F.col("lat")).alias("i"), g.lon_index(F.col("lon")).alias("j")).distinct()


def hits(t):
    return spatial.points_in_polygons(t.point, t.edge, ["id"])


@query("e1_point_in_polygon_first", f"SELECT id, min(poly_id) AS poly_id, CAST(arg_min(CASE WHEN category > 0 THEN category ELSE 900 END, poly_id) AS INT) AS iso_numeric FROM ({HITS_SQL}) GROUP BY 1")
def e1(t):
    attributes = t.edge.groupBy("poly_id").agg(F.max("category").alias("category")).select(
        "poly_id", F.col("poly_id").alias("ord"), spatial.iso_numeric(F.col("category").cast("string")).alias("iso_numeric")
    )
    return spatial.first_polygon(hits(t), attributes, ["id"])


@query("e1_polygon_cover_hits", f"SELECT id, poly_id FROM ({HITS_SQL})")
def e1_cover(t):
    """The same hits by way of a cover that is built once and kept."""
    return spatial.points_in_cover(t.point, stored(spatial.polygon_cover(t.edge), "polygon-cover"), t.edge, ["id"])


@query("e2_point_in_polygon_max_category", f"SELECT id, max(category) AS category FROM ({HITS_SQL.replace('GROUP BY', 'WHERE p.lat BETWEEN -60 AND 72 AND p.lon BETWEEN -180 AND 64 GROUP BY')}) GROUP BY 1")
def e2(t):
    window = t.point.where(F.col("lat").between(-60, 72) & F.col("lon").between(-180, 64))
    found = spatial.points_in_polygons(window, t.edge, ["id"])
    return spatial.max_category(found, t.edge.groupBy("poly_id").agg(F.max("category").alias("category")), ["id"])


REGIONS_SQL = """SELECT p.id, b.region_id, any_value(b.priority) AS priority, any_value(b.name) AS name FROM v_point p
  JOIN v_box b ON p.lat BETWEEN b.lat0 AND b.lat1 AND p.lon BETWEEN b.lon0 AND b.lon1 GROUP BY 1, 2"""


def regions(t):
    found = spatial.points_in_boxes(t.point, t.box, ["id"])
    names = t.nation.selectExpr("n_nationkey AS region_id", "n_name AS name", "n_regionkey AS priority", "n_nationkey AS ord")
    from solstice.functions.joins import dim_join

    return spatial.ranked_regions(dim_join(found, names, "region_id"), ["id"])


@query("e3_region_lookup", f"SELECT id, region_id, CAST(row_number() OVER (PARTITION BY id ORDER BY priority DESC, region_id) AS INT) AS rank FROM ({REGIONS_SQL})")
def e3(t):
    return regions(t).select("id", "region_id", "rank")


@query(
    "e4_land_flag",
    f"""WITH inp AS MATERIALIZED (SELECT DISTINCT cell_id FROM (SELECT p.cell_id, e.poly_id FROM v_grid p JOIN v_edge e ON {CROSS} GROUP BY 1, 2 HAVING count(*) % 2 = 1)),
    cov AS MATERIALIZED (SELECT DISTINCT {s.cell()} AS cell_id FROM v_point WHERE w > 0)
    SELECT g.cell_id, inp.cell_id IS NOT NULL OR cov.cell_id IS NOT NULL AS on_land FROM v_grid g LEFT JOIN inp ON inp.cell_id = g.cell_id LEFT JOIN cov ON cov.cell_id = g.cell_id""",
)
def e4(t):
    cells = g.target_grid(t.spark)
    inside = spatial.points_in_polygons(cells, t.edge, ["cell_id"])
    covered = t.point.where("w > 0").select(g.cell_id(F.col("lat"), F.col("lon")).alias("cell_id"))
    return spatial.land_flag(cells.select("cell_id"), inside, covered)


def snap_sql(land: str) -> str:
    near = f"""SELECT p.*, l.i AS li, l.j AS lj FROM (SELECT id, lat, lon, {s.lat_index('lat')} AS i, {s.lon_index('lon')} AS j FROM v_point) p CROSS JOIN range(-2, 3) a(di) CROSS JOIN range(-2, 3) b(dj)
      JOIN ({land}) l ON l.i = p.i + di AND l.j = (p.j + dj + 180) % 180"""
    return f"""SELECT p.id, {s.cell_text('coalesce(n.i, p.i) * 2 - 89', 'coalesce(n.j, p.j) * 2 - 179')} AS cell_id, p.own AS own_is_land, p.own OR n.i IS NOT NULL AS on_land FROM
      (SELECT q.id, q.i, q.j, l.i IS NOT NULL AS own FROM (SELECT id, {s.lat_index('lat')} AS i, {s.lon_index('lon')} AS j FROM v_point) q LEFT JOIN ({land}) l ON l.i = q.i AND l.j = q.j) p
      LEFT JOIN (SELECT id, li AS i, lj AS j FROM ({near}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {s.haversine('lat', 'lon', '(li * 2 - 89)', '(lj * 2 - 179)')}, li, lj) = 1) n ON n.id = p.id AND NOT p.own"""


@query("e5_snap_to_land", snap_sql(LAND_SQL))
def e5(t):
    return spatial.snap_to_land(t.point.select("id", "lat", "lon"), land(t)).select("id", "cell_id", "own_is_land", "on_land")


@query(
    "e6_cells_near_land",
    f"""SELECT cell_id FROM v_grid g WHERE EXISTS (SELECT 1 FROM ({LAND_SQL}) l WHERE abs(l.i - g.i) <= 2 AND least(abs(l.j - g.j), 180 - abs(l.j - g.j)) <= 2)""",
)
def e6(t):
    return spatial.cells_near_land(g.target_grid(t.spark), land(t)).select("cell_id")


@query(
    "e8_nearest_place_in_cell",
    f"""WITH pl AS (SELECT *, {s.cell()} AS cell_id FROM v_place), near AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY pop DESC, id) <= 30),
    pt AS (SELECT id, lat, lon, {s.cell()} AS cell_id FROM v_point)
    SELECT p.id, n.id AS place_id, CAST(floor(km + 0.5) AS BIGINT) AS km FROM pt p LEFT JOIN
      (SELECT a.id AS pid, b.id, {s.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM pt a JOIN near b ON a.cell_id = b.cell_id
       QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {s.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.pop DESC, b.id) = 1) n ON n.pid = p.id""",
)
def e8(t):
    found = spatial.nearest_listed(t.point.select("id", "lat", "lon"), gazetteer.places_per_cell(t.place))
    return found.select("id", F.col("place.id").alias("place_id"), "km")


PIXEL_SQL = """SELECT CAST((l_partkey*7919 + l_orderkey) % 17900 AS DOUBLE)/100 - 89.5 AS lat, CAST((l_suppkey*104729 + l_orderkey*37) % 36000 AS DOUBLE)/100 - 180 AS lon,
  CASE WHEN l_discount = 0 THEN -9999 ELSE l_quantity - 5 END AS value FROM lineitem"""


def pixels(t):
    return t.lineitem.selectExpr(
        "CAST((l_partkey*7919 + l_orderkey) % 17900 AS DOUBLE)/100 - 89.5 AS lat", "CAST((l_suppkey*104729 + l_orderkey*37) % 36000 AS DOUBLE)/100 - 180 AS lon",
        "CASE WHEN l_discount = 0 THEN -9999 ELSE l_quantity - 5 END AS value",
    )


@query("a11_pixel_ingest", f"SELECT lat, lon, CASE WHEN value = -9999 OR value < 0 THEN 0 ELSE value END AS value FROM ({PIXEL_SQL})")
def a11(t):
    return pixels(t).withColumn("value", spatial.clean_pixel(F.col("value"), -9999.0))


@query("e9_zonal_sum", f"SELECT {s.cell(tie=s.half_even)} AS cell_id, CAST(sum(CASE WHEN value < 0 THEN 0 ELSE value END) AS BIGINT) AS value FROM ({PIXEL_SQL}) GROUP BY 1 HAVING sum(CASE WHEN value < 0 THEN 0 ELSE value END) >= 1")
def e9(t):
    return spatial.zonal_sum(pixels(t), nodata=-9999.0)


@query(
    "e11_place_identity_key",
    """SELECT id, concat_ws('|', trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g')), cc, trim(regexp_replace(lower(a1), '[^a-z0-9 ]+', ' ', 'g')),
      format('{:.2f}', floor(lat * 4 + 0.5) / 4), format('{:.2f}', floor(lon * 4 + 0.5) / 4)) AS place_key FROM v_place""",
)
def e11(t):
    return gazetteer.with_place_key(t.place).select("id", "place_key")
