"""Storm tracks: ``sid, fix_id, ts, basin, wmo_wind, usa_wind, lat, lon`` fixes to per-year rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.functions import grid

# Fixed values of the method.
BASINS = ["NA", "EP", "WP", "NI", "SI", "SP", "SA"]
CLASSES = ["el_nino", "la_nina", "neutral"]
STORM_KT, HURRICANE_KT = 34, 64
FIRST_YEAR, LAST_YEAR = 1980, 2025


def valid_fixes(fixes: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR + 1) -> DataFrame:
    """Fixes with a usable time and position inside the year range."""
    typed = fixes.withColumns(
        {"ts": F.col("ts").try_cast("timestamp"), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")}
    )
    return typed.where(F.year("ts").between(first_year, last_year) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def wind(*columns: str) -> Column:
    """First column that holds a number; blanks are skipped."""
    return F.coalesce(*[F.trim(F.col(c).cast("string")).try_cast("double") for c in columns])


def storms(fixes: DataFrame) -> DataFrame:
    """One row per storm: first fix (by time, then id), July-June year, maximum wind or -1."""
    first = F.min(F.struct("ts", "fix_id", "basin", "lat", "lon")).alias("g")
    out = fixes.groupBy("sid").agg(first, F.coalesce(F.max(wind("wmo_wind", "usa_wind")), F.lit(-1.0)).alias("max_wind"))
    year = cal.event_year(F.year("g.ts"), F.month("g.ts"))
    return out.select("sid", "g.basin", year.alias("event_year"), F.col("g.lat").alias("glat"), F.col("g.lon").alias("glon"), "max_wind")


def storm_cells(fixes: DataFrame) -> DataFrame:
    """Distinct grid cells visited by each storm."""
    lat, lon = grid.cell_lat(F.col("lat"), "half_even"), grid.cell_lon(F.col("lon"), "half_even")
    cells = fixes.select("sid", lat.alias("_lat"), lon.alias("_lon")).distinct()
    return cells.select("sid", grid.format_cell(F.col("_lat"), F.col("_lon")).alias("cell_id"))


def classed_storms(storm: DataFrame, years: DataFrame, basins: Sequence[str] = BASINS) -> DataFrame:
    """Storms of at least gale force in a listed basin and a classed year; adds ``cls`` and ``hurricane``."""
    kept = storm.where((F.col("max_wind") >= STORM_KT) & F.col("basin").isin(list(basins)))
    # one row per calendar year
    classes = years.where(F.col("cls").isin(CLASSES)).select("event_year", "cls")
    return kept.join(F.broadcast(classes), "event_year").withColumn("hurricane", (F.col("max_wind") >= HURRICANE_KT).cast("int"))


def year_counts(years: DataFrame) -> DataFrame:
    counted = years.groupBy().agg(*[F.count_if(F.col("cls") == c).alias(c) for c in CLASSES])
    return counted.unpivot([], CLASSES, "cls", "years")


def per_year(x: Column, n: Column, digits: int) -> Column:
    return F.when(n > 0, F.bround(x / n, digits))


def basin_rates(classed: DataFrame, years: DataFrame, basins: Sequence[str] = BASINS) -> DataFrame:
    """Every basin and class: storms and hurricanes per year, mean genesis position."""
    spark = classed.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in basins])).alias("basin"))
    dense = names.join(F.broadcast(year_counts(years)), how="cross")
    found = classed.groupBy("basin", "cls").agg(
        F.count("*").alias("storms"), F.sum("hurricane").alias("hurricanes"), F.bround(F.avg("glon"), 1).alias("genesis_lon_mean"),
        F.bround(F.avg("glat"), 1).alias("genesis_lat_mean"),
    )
    n = F.col("years")
    return dense.join(found, ["basin", "cls"], "left").select(
        "basin", "cls", "years",
        per_year(F.coalesce("storms", F.lit(0)), n, 1).alias("storms_per_year"),
        per_year(F.coalesce("hurricanes", F.lit(0)), n, 1).alias("hurricane_per_year"),
        "genesis_lon_mean", "genesis_lat_mean",
    )


def cell_rates(classed: DataFrame, cells: DataFrame, years: DataFrame) -> DataFrame:
    """Every visited cell and class with at least one year: storms and hurricanes per year."""
    visits = cells.join(classed.select("sid", "cls", "hurricane"), "sid")
    wide = visits.groupBy("cell_id").agg(
        *[F.count_if(F.col("cls") == c).alias(f"{c}_s") for c in CLASSES],
        *[F.sum(F.when(F.col("cls") == c, F.col("hurricane")).otherwise(0)).alias(f"{c}_h") for c in CLASSES],
    )
    rows = wide.select(
        "cell_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"{c}_s").alias("s"), F.col(f"{c}_h").alias("h")) for c in CLASSES])).alias("r")
    ).select("cell_id", "r.cls", "r.s", "r.h")
    n = F.col("years")
    return rows.join(F.broadcast(year_counts(years).where("years > 0")), "cls").select(
        "cell_id", "cls", per_year(F.col("s"), n, 2).alias("storms_per_year"), per_year(F.col("h"), n, 2).alias("hurricane_per_year")
    )


def contrast(rates: DataFrame, checks: Sequence[tuple[str, str, str, str, str, float]]) -> DataFrame:
    """Boolean checks between classes: ``(name, basin, measure, larger class, smaller class, margin)``."""
    wide = rates.groupBy("basin").pivot("cls", CLASSES).agg(
        F.first("genesis_lon_mean").alias("genesis_lon_mean"), F.first("hurricane_per_year").alias("hurricane_per_year")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), F.lit(basin).alias("for_basin"),
                F.coalesce(F.col(f"{big}_{measure}") > F.col(f"{small}_{measure}") + margin, F.lit(False)).alias("ok"),
            )
            for name, basin, measure, big, small, margin in checks
        ]
    )
    return wide.select("basin", F.explode(rows).alias("c")).where("basin = c.for_basin").select("c.check", "basin", "c.ok")


def display_rates(rates: DataFrame, min_neutral: float = 0.33) -> DataFrame:
    """Rate pair shown for a cell: null unless neutral years have a meaningful rate."""
    wide = rates.groupBy("cell_id").agg(
        F.max(F.when(F.col("cls") == "el_nino", F.col("storms_per_year"))).alias("en_rate"),
        F.max(F.when(F.col("cls") == "neutral", F.col("storms_per_year"))).alias("neutral_rate"),
    )
    shown = F.col("neutral_rate") >= min_neutral
    return wide.select("cell_id", F.when(shown, F.col("en_rate")).alias("en_rate"), F.when(shown, F.col("neutral_rate")).alias("neutral_rate"))
