"""Spatial joins on plain latitude and longitude columns.

Shapes are cut into fixed buckets first, so that every spatial join is an equi join with an
exact test behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions import grid
from solstice.functions.joins import dim_join

BUCKET = 10.0  # degrees; a shape covers at most 18 x 36 buckets


def _bucket(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - origin) / size).cast("int")


def _covered(shapes: DataFrame, size: float = BUCKET) -> DataFrame:
    """One row per bucket that the shape's ``lat0..lat1, lon0..lon1`` rectangle touches."""
    rows = F.sequence(_bucket(F.col("lat0"), -90, size), _bucket(F.col("lat1"), -90, size))
    cols = F.sequence(_bucket(F.col("lon0"), -180, size), _bucket(F.col("lon1"), -180, size))
    return shapes.withColumn("_bi", F.explode(rows)).withColumn("_bj", F.explode(cols))


def _placed(points: DataFrame, size: float = BUCKET) -> DataFrame:
    return points.withColumns({"_bi": _bucket(F.col("lat"), -90, size), "_bj": _bucket(F.col("lon"), -180, size)})


def _finite(points: DataFrame) -> DataFrame:
    """Points without a place, or at infinity, are in no polygon."""
    return points.where((F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, point_keys: Sequence[str], region: str = "region_id") -> DataFrame:
    """One row per point and region whose boxes hold the point (all four sides inclusive)."""
    cells = _covered(boxes.select(region, "lat0", "lat1", "lon0", "lon1"))
    hits = dim_join(_placed(points.select(*point_keys, "lat", "lon")), cells, ["_bi", "_bj"])
    inside = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    return hits.where(inside).select(*point_keys, region).distinct()


def ranked_regions(hits: DataFrame, point_keys: Sequence[str], keep: int | None = None) -> DataFrame:
    """Number the regions of a point by falling priority, then by ``ord`` (the declared order)."""
    order = Window.partitionBy(*point_keys).orderBy(F.col("priority").desc(), "ord")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if keep is None else out.where(F.col("rank") <= keep)


def with_regions(points: DataFrame, boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Add ``regions``: every region whose boxes hold the point, by falling priority, then declared order.

    ``regions`` has ``region_id, name, priority, ord``. The boxes are nested per bucket and looked up in
    the row, so a point outside all boxes gets an empty list and equal points keep their rows.
    """
    named = boxes.select("region_id", "lat0", "lat1", "lon0", "lon1").join(regions.select("region_id", "name", "priority", "ord"), "region_id")
    entry = F.struct((-F.col("priority")).alias("rank"), "ord", "region_id", "name")
    lists = _covered(named).groupBy("_bi", "_bj").agg(F.collect_list(F.struct("lat0", "lat1", "lon0", "lon1", entry.alias("r"))).alias("_boxes"))
    joined = _placed(points).join(lists, ["_bi", "_bj"], "left")
    inside = F.filter("_boxes", lambda b: F.col("lat").between(b["lat0"], b["lat1"]) & F.col("lon").between(b["lon0"], b["lon1"]))
    found = F.array_sort(F.array_distinct(F.transform(inside, lambda b: b["r"])))
    none = F.array().cast(named.select(F.array(entry).alias("a")).schema["a"].dataType)
    return joined.select(*points.columns, F.coalesce(found, none).alias("regions"))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_keys: Sequence[str], band: float = 2.0) -> DataFrame:
    """One row per point and polygon that strictly contains it.

    ``edges`` has one row per polygon side (``poly_id, x1, y1, x2, y2``, all rings together, so
    holes count). Bounding rectangles select candidates; a candidate then meets only the sides
    in its own latitude band and is inside when an odd number of them lies to its east.
    """
    keys = list(point_keys)
    # rows with equal keys and place are one point, or their crossings would add up
    points = _finite(points.select(*keys, "lat", "lon")).distinct()
    frame = _frames(edges)
    candidates = dim_join(_placed(points.select(*keys, "lat", "lon")), _covered(frame), ["_bi", "_bj"]).where(
        F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    )
    return _odd_crossings(candidates, edges, keys, band).select(*keys, "poly_id").distinct()


def _frames(edges: DataFrame) -> DataFrame:
    """``poly_id, lat0, lat1, lon0, lon1``: the rectangle round the sides of each polygon."""
    return edges.groupBy("poly_id").agg(
        F.min(F.least("y1", "y2")).alias("lat0"), F.max(F.greatest("y1", "y2")).alias("lat1"),
        F.min(F.least("x1", "x2")).alias("lon0"), F.max(F.greatest("x1", "x2")).alias("lon1"),
    )


def _odd_crossings(candidates: DataFrame, edges: DataFrame, keys: Sequence[str], band: float) -> DataFrame:
    """Those of ``keys, lat, lon, poly_id`` with an odd number of the polygon's sides to their east."""
    candidates = candidates.select(*keys, "lat", "lon", "poly_id", F.floor(F.col("lat") / band).cast("int").alias("_band"))
    bands = F.sequence(F.floor(F.least("y1", "y2") / band).cast("int"), F.floor(F.greatest("y1", "y2") / band).cast("int"))
    sides = edges.where("y1 <> y2").select("poly_id", "x1", "y1", "x2", "y2", F.explode(bands).alias("_band"))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    crossing_lon = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    met = dim_join(candidates, sides, ["poly_id", "_band"]).where(spans & (F.col("lon") < crossing_lon))
    return met.groupBy(*keys, "lat", "lon", "poly_id").agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1)


# Cell sizes of a cover in degrees, coarse to fine; each is a whole multiple of the next.
COVER_SIZES = (16.0, 4.0, 1.0)
# A side this close to a cell counts as touching it, far above the rounding of the crossing test.
COVER_MARGIN = 1e-6


def _touched_cells(edges: DataFrame, size: float) -> DataFrame:
    """``poly_id, ci, cj`` of the cells that a side touches; a side is followed row by row, so a long one has as many cells as it is long."""
    x0, x1, y0, y1 = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    m = F.lit(COVER_MARGIN)
    rows = edges.select(
        "poly_id", "x1", "y1", "x2", "y2", x0.alias("w"), x1.alias("e"), y0.alias("s"), y1.alias("n"),
        F.explode(F.sequence(_bucket(y0 - m, -90, size), _bucket(y1 + m, -90, size))).alias("ci"),
    )

    def lon_at(lat: Column) -> Column:
        return F.col("x1") + (F.col("x2") - F.col("x1")) * ((lat - F.col("y1")) / (F.col("y2") - F.col("y1")))

    bottom = F.greatest(F.col("ci") * size - 90 - m, F.col("s"))
    top = F.least((F.col("ci") + 1) * size - 90 + m, F.col("n"))
    sloped = F.col("y1") != F.col("y2")
    west = F.when(sloped, F.greatest("w", F.least(lon_at(bottom), lon_at(top)))).otherwise(F.col("w"))
    east = F.when(sloped, F.least("e", F.greatest(lon_at(bottom), lon_at(top)))).otherwise(F.col("e"))
    cols = F.sequence(_bucket(west - m, -180, size), _bucket(east + m, -180, size))
    return rows.select("poly_id", "ci", F.explode(cols).alias("cj")).distinct()


def polygon_cover(edges: DataFrame, sizes: Sequence[float] = COVER_SIZES) -> DataFrame:
    """``poly_id, level, ci, cj, inside, lat0, lat1, lon0, lon1``: cells that cover the polygons, each as large as it can be.

    Cells that no side touches lie wholly inside or wholly outside; their centre tells which, and those outside are left
    out. Touched cells are cut into those of the next size; touched cells of the last size have ``inside`` false, and
    points in them need the sides. The number of cells grows with the length of the sides, not with the area. A polygon
    whose sides do not close (a corner with an odd number of ends, or without a place) gets the coarse cells of its rectangle,
    with ``inside`` false, so its sides decide everywhere in it; only these have the rectangle's corners. Build the cover once per polygon table and keep it.
    """
    edges = edges.select("poly_id", "x1", "y1", "x2", "y2")
    ends = edges.select("poly_id", F.col("x1").alias("x"), F.col("y1").alias("y")).unionAll(edges.select("poly_id", "x2", "y2"))
    lost = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")
    unclosed = ends.groupBy("poly_id", "x", "y").agg(F.count("*").alias("n")).where((F.col("n") % 2 == 1) | lost).select("poly_id").distinct()
    closed = edges.join(unclosed, "poly_id", "left_anti")
    touched = [_touched_cells(closed, sizes[-1])]
    for size, finer in reversed(list(zip(sizes, sizes[1:]))):
        cut = round(size / finer)
        touched.insert(0, touched[0].select("poly_id", F.floor(F.col("ci") / cut).cast("int").alias("ci"), F.floor(F.col("cj") / cut).cast("int").alias("cj")).distinct())

    def rectangles(sides: DataFrame) -> DataFrame:
        return _covered(_frames(sides), sizes[0]).withColumnsRenamed({"_bi": "ci", "_bj": "cj"})

    whole = None
    for level, size in enumerate(sizes):
        if level == 0:
            cells = rectangles(closed).select("poly_id", "ci", "cj")
        else:
            cut = round(sizes[level - 1] / size)
            steps = F.sequence(F.lit(0), F.lit(cut - 1))
            cells = touched[level - 1].withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
            cells = cells.select("poly_id", (F.col("ci") * cut + F.col("di")).alias("ci"), (F.col("cj") * cut + F.col("dj")).alias("cj"))
        free = cells.join(touched[level], ["poly_id", "ci", "cj"], "left_anti").select(
            "poly_id", F.lit(level).alias("level"), "ci", "cj", ((F.col("ci") + 0.5) * size - 90).alias("lat"), ((F.col("cj") + 0.5) * size - 180).alias("lon")
        )
        whole = free if whole is None else whole.unionAll(free)
    columns, corners = ["poly_id", "level", "ci", "cj"], ["lat0", "lat1", "lon0", "lon1"]
    nowhere = [F.lit(None).cast("double").alias(c) for c in corners]
    within = _odd_crossings(whole, closed, ["level", "ci", "cj"], sizes[-1]).select(*columns, F.lit(True).alias("inside"), *nowhere)
    edge = touched[-1].select("poly_id", F.lit(len(sizes) - 1).alias("level"), "ci", "cj", F.lit(False).alias("inside"), *nowhere)
    rest = rectangles(edges.join(unclosed, "poly_id", "left_semi")).select("poly_id", F.lit(0).alias("level"), "ci", "cj", F.lit(False).alias("inside"), *corners)
    return within.unionAll(edge).unionAll(rest)


def points_in_cover(points: DataFrame, cover: DataFrame, edges: DataFrame, point_keys: Sequence[str], sizes: Sequence[float] = COVER_SIZES) -> DataFrame:
    """``points_in_polygons`` by way of a ``polygon_cover`` of the same sides: points in inside cells meet no side at all."""
    keys = list(point_keys)
    found = cover_matches(points, cover, keys, sizes)
    sure = found.where("inside").select(*keys, "poly_id")
    tested = _odd_crossings(found.where("NOT inside"), edges, keys, sizes[-1]).select(*keys, "poly_id")
    return sure.unionAll(tested).distinct()


def cover_matches(points: DataFrame, cover: DataFrame, point_keys: Sequence[str], sizes: Sequence[float] = COVER_SIZES) -> DataFrame:
    """``point keys, lat, lon, poly_id, inside`` for every cell of the cover that holds a point: one look-up per size."""
    cells = F.array(*[F.struct(F.lit(k).alias("level"), _bucket(F.col("lat"), -90, size).alias("ci"), _bucket(F.col("lon"), -180, size).alias("cj")) for k, size in enumerate(sizes)])
    placed = _finite(points.select(*point_keys, "lat", "lon")).distinct().withColumn("_c", F.explode(cells)).select(*point_keys, "lat", "lon", "_c.level", "_c.ci", "_c.cj")
    near = F.col("lat").between(F.col("lat0"), F.col("lat1")) & F.col("lon").between(F.col("lon0"), F.col("lon1"))
    met = dim_join(placed, cover, ["level", "ci", "cj"]).where(F.col("lat0").isNull() | near)
    return met.select(*point_keys, "lat", "lon", "poly_id", "inside")


def first_polygon(hits: DataFrame, attributes: DataFrame, point_keys: Sequence[str]) -> DataFrame:
    """Attributes of the first declared polygon (lowest ``ord``) that holds each point."""
    columns = [c for c in attributes.columns if c not in ("poly_id", "ord")]
    joined = dim_join(hits, attributes, "poly_id")
    best = joined.groupBy(*point_keys).agg(F.min(F.struct("ord", "poly_id", *columns)).alias("_b"))
    return best.select(*point_keys, "_b.poly_id", *[f"_b.{c}" for c in columns])


def max_category(hits: DataFrame, attributes: DataFrame, point_keys: Sequence[str]) -> DataFrame:
    return dim_join(hits, attributes.select("poly_id", "category"), "poly_id").groupBy(*point_keys).agg(F.max("category").alias("category"))


def iso_numeric(code: Column, fallback: int = 900) -> Column:
    """Numeric country code; anything that is not a positive number becomes the fallback."""
    number = F.try_to_number(code, F.lit("999")).cast("int")
    return F.when(number > 0, number).otherwise(fallback)


def land_flag(cells: DataFrame, in_polygon: DataFrame, covered: DataFrame) -> DataFrame:
    """``cell_id, on_land``: inside a polygon, or with data coverage."""
    hit = in_polygon.select("cell_id").distinct().withColumn("_p", F.lit(True))
    data = covered.select("cell_id").distinct().withColumn("_c", F.lit(True))
    joined = cells.join(hit, "cell_id", "left").join(data, "cell_id", "left")
    return joined.select(*cells.columns, F.coalesce("_p", "_c", F.lit(False)).alias("on_land"))


def land_neighbours(land: DataFrame, reach: int = 2) -> DataFrame:
    """For every cell with land in reach: ``i, j`` and the land cells around it.

    ``land`` holds ``i, j`` of the land cells (at most the size of the grid), so a row has at
    most ``(2*reach+1)^2`` neighbours. Longitude wraps, latitude does not.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = (
        land.select(F.col("i").alias("li"), F.col("j").alias("lj"))
        .withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
        .select((F.col("li") - F.col("di")).alias("i"), F.pmod(F.col("lj") - F.col("dj"), F.lit(grid.N_LON)).alias("j"), "di", "dj", "li", "lj")
        .where(F.col("i").between(0, grid.N_LAT - 1))
    )
    near = F.struct("di", "dj", (F.col("li") * 2 - 89.0).alias("lat"), (F.col("lj") * 2 - 179.0).alias("lon"))
    return around.groupBy("i", "j").agg(F.collect_set(near).alias("near_land"))


def snap_to_land(points: DataFrame, land: DataFrame, reach: int = 2) -> DataFrame:
    """Add ``cell_id``: the point's own cell when it is land, else the closest land cell in reach, else its own.

    The neighbour table has at most one row per grid cell, so points are never multiplied or shuffled.
    """
    lon = grid.lon_180(F.col("lon"))
    placed = points.withColumns({"i": grid.lat_index(F.col("lat")), "j": grid.lon_index(F.col("lon"))})
    joined = placed.join(F.broadcast(land_neighbours(land, reach)), ["i", "j"], "left")
    own_lat, own_lon = F.col("i") * 2 - 89.0, F.col("j") * 2 - 179.0
    ranked = F.transform(
        "near_land",
        lambda c: F.struct(
            grid.haversine_km(F.col("lat"), lon, c["lat"], c["lon"]).alias("km"), c["di"].alias("di"), c["dj"].alias("dj"),
            c["lat"].alias("lat"), c["lon"].alias("lon"),
        ),
    )
    own_is_land = F.exists("near_land", lambda c: (c["di"] == 0) & (c["dj"] == 0))
    use_own = F.col("near_land").isNull() | own_is_land
    # a column of its own, so that the distances are worked out once a point, and not for every use of the best cell
    found = joined.withColumns({"_best": F.when(~use_own, F.array_min(ranked)), "_own": own_is_land})
    cell = grid.format_cell(F.coalesce("_best.lat", own_lat), F.coalesce("_best.lon", own_lon))
    return found.select(*points.columns, cell.alias("cell_id"), F.coalesce("_own", F.lit(False)).alias("own_is_land"), F.col("near_land").isNotNull().alias("on_land"))


def cells_near_land(cells: DataFrame, land: DataFrame, reach: int = 2) -> DataFrame:
    """Cells that are land or have land in reach; ``cells`` has ``i, j``."""
    return cells.join(F.broadcast(land_neighbours(land, reach).select("i", "j")), ["i", "j"], "left_semi")


def nearest_listed(points: DataFrame, listed: DataFrame) -> DataFrame:
    """Closest of the places listed for the point's own cell.

    ``listed`` holds ``cell_id, places`` with a short array per cell (see
    ``gazetteer.places_per_cell``), so each point looks at no more than that many places.
    """
    # one row per grid cell
    joined = dim_join(points.withColumn("cell_id", grid.cell_id(F.col("lat"), F.col("lon"))), listed, "cell_id", "left", bounded=True)
    ranked = F.transform(
        "places",
        lambda p: F.struct(grid.haversine_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("km"), p["rank"].alias("rank"), p.alias("place")),
    )
    best = F.array_min(ranked)
    return joined.select(*points.columns, "cell_id", best["place"].alias("place"), F.floor(best["km"] + 0.5).alias("km"))


def zonal_sum(pixels: DataFrame, nodata: float | None = None, tie: str = "half_even") -> DataFrame:
    """``cell_id, value``: clean pixel values summed per grid cell, cells of at least one kept.

    Groups by the numeric cell centre; only the result rows are formatted.
    """
    cells = pixels.select(
        grid.cell_lat(F.col("lat"), tie).alias("_lat"), grid.cell_lon(F.col("lon"), tie).alias("_lon"), clean_pixel(F.col("value"), nodata).alias("v")
    )
    out = cells.groupBy("_lat", "_lon").agg(F.sum("v").alias("total")).where("total >= 1")
    return out.select(grid.format_cell(F.col("_lat"), F.col("_lon")).alias("cell_id"), F.bround("total", 0).cast("bigint").alias("value"))


def clean_pixel(value: Column, nodata: float | None = None) -> Column:
    kept = F.when(value.isNull() | F.isnan(value) | (value < 0), 0.0)
    if nodata is not None:
        kept = kept.when(value == nodata, 0.0)
    return kept.otherwise(value)
