"""Grid coordinates: cell keys, nearest axis index, longitude ranges, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 2-degree grid with centres at odd degrees, and the earth radius in km.
STEP = 2
N_LAT, N_LON = 90, 180
LAT0, LON0 = -89, -179
EARTH_KM = 6371


def round_tie(x: Column, tie: str = "half_up") -> Column:
    """Round to a whole number; ``tie`` decides what happens at exactly .5."""
    if tie == "half_even":
        return F.bround(x, 0)
    if tie == "half_up":
        return F.floor(x + 0.5).cast("double")
    if tie == "half_down":
        return F.ceil(x - 0.5).cast("double")
    raise ValueError(tie)


def cell_lat(lat: Column, tie: str = "half_up") -> Column:
    return F.greatest(F.lit(-89.0), F.least(F.lit(89.0), round_tie((lat + 1) / 2, tie) * 2 - 1))


def cell_lon(lon: Column, tie: str = "half_up") -> Column:
    return F.pmod(round_tie((lon + 1) / 2, tie) * 2 - 1 + 179, F.lit(360.0)) - 179


def format_cell(lat: Column, lon: Column) -> Column:
    """``-001.0_+0037.0``; built from casts, which cost far less per row than a format call."""

    def signed(x: Column, width: int) -> Column:
        return F.concat(F.when(x < 0, "-").otherwise("+"), F.lpad(F.abs(x).cast("decimal(5,1)").cast("string"), width, "0"))

    return F.concat(signed(lat, 5), F.lit("_"), signed(lon, 6))


def parse_cell(cell: Column) -> tuple[Column, Column]:
    parts = F.split(cell, "_")
    return parts[0].cast("double"), parts[1].cast("double")


def cell_id(lat: Column, lon: Column, tie: str = "half_up") -> Column:
    return format_cell(cell_lat(lat, tie), cell_lon(lon, tie))


def lon_180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def lon_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def axis_index(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest point of a regular axis; the lower index wins a tie."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((x - first) / step - 0.5))).cast("int")


def lat_index(lat: Column) -> Column:
    return axis_index(lat, LAT0, STEP, N_LAT)


def lon_index(lon: Column) -> Column:
    return axis_index(lon_180(lon), LON0, STEP, N_LON)


def nearest_in(axis: Column, x: Column) -> Column:
    """0-based index of the nearest value of an irregular axis held as an array."""
    return F.array_min(F.transform(axis, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def target_grid(spark: SparkSession) -> DataFrame:
    """All cells of the grid: ``i, j, lat, lon, cell_id``. Always 16 200 rows."""
    n = F.col("id")
    return (
        spark.range(N_LAT * N_LON)
        .select((n / N_LON).cast("int").alias("i"), (n % N_LON).cast("int").alias("j"))
        .select("i", "j", (F.col("i") * 2 - 89.0).alias("lat"), (F.col("j") * 2 - 179.0).alias("lon"))
        .withColumn("cell_id", format_cell(F.col("lat"), F.col("lon")))
    )


def in_western_north_pacific(lat: Column, lon: Column) -> Column:
    return lon.between(100, 180) & lat.between(0, 35)
