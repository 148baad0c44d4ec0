"""Grid and coordinate scalars, land snapping and distances."""

from pyspark.sql import functions as F

from solstice.functions import grid as g
from solstice.plans import sqltext as s
from solstice.plans.registry import query


@query("b1_cell_id_half_even", f"SELECT id, {s.cell(tie=s.half_even)} AS cell_id FROM v_point")
def b1(t):
    return t.point.select("id", g.cell_id(F.col("lat"), F.col("lon"), "half_even").alias("cell_id"))


@query("b2_cell_id_half_up", f"SELECT id, {s.cell()} AS cell_id FROM v_point")
def b2(t):
    return t.point.select("id", g.cell_id(F.col("lat"), F.col("lon"), "half_up").alias("cell_id"))


@query(
    "b3_nearest_axis_index",
    f"""WITH ax AS (SELECT unnest([-80.0, -55.0, -30.0, -5.0, 0.0, 10.0, 35.0, 60.0, 85.0]::DOUBLE[]) AS v, unnest(range(9)) AS idx)
    SELECT p.id, {s.lat_index('p.lat')} AS i, {s.lon_index('p.lon')} AS j, CAST(min_by(ax.idx, abs(ax.v - p.lat) * 1000 + ax.idx / 1000.0) AS INT) AS irregular
    FROM v_point p, ax GROUP BY p.id, p.lat, p.lon""",
)
def b3(t):
    axis = F.array(*[F.lit(float(v)) for v in (-80, -55, -30, -5, 0, 10, 35, 60, 85)])
    return t.point.select(
        "id", g.lat_index(F.col("lat")).alias("i"), g.lon_index(F.col("lon")).alias("j"), g.nearest_in(axis, F.col("lat")).alias("irregular")
    )


@query(
    "b4_cell_id_format_parse",
    f"""SELECT id, c AS cell_id, CAST(split_part(c, '_', 1) AS DOUBLE) AS cell_lat, CAST(split_part(c, '_', 2) AS DOUBLE) AS cell_lon
    FROM (SELECT id, {s.cell()} AS c FROM v_place)""",
)
def b4(t):
    cells = t.place.select("id", g.cell_id(F.col("lat"), F.col("lon")).alias("cell_id"))
    lat, lon = g.parse_cell(F.col("cell_id"))
    return cells.select("id", "cell_id", lat.alias("cell_lat"), lon.alias("cell_lon"))


@query(
    "b5_longitude_ranges",
    f"""SELECT id, round({s.pmod('x + 180', 360)} - 180, 6) AS lon180, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon360
    FROM (SELECT id, lon, lon * 3 AS x FROM v_point)""",
)
def b5(t):
    return t.point.select(
        "id", F.round(g.lon_180(F.col("lon") * 3), 6).alias("lon180"), F.round(g.lon_360(F.col("lon")), 6).alias("lon360")
    )


@query(
    "e7_haversine_km",
    f"SELECT id, round({s.haversine('lat', 'lon', s.cell_lat('lat'), s.cell_lon('lon'))}, 4) AS km FROM v_point",
)
def e7(t):
    lat, lon = F.col("lat"), F.col("lon")
    return t.point.select("id", F.round(g.haversine_km(lat, lon, g.cell_lat(lat), g.cell_lon(lon)), 4).alias("km"))


@query("e10_rectangular_region_flag", "SELECT id, lon >= 100 AND lon <= 180 AND lat >= 0 AND lat <= 35 AS wnp FROM v_point")
def e10(t):
    return t.point.select("id", g.in_western_north_pacific(F.col("lat"), F.col("lon")).alias("wnp"))
