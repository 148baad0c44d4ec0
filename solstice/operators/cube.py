"""Statistics over long monthly cubes ``(source, cell, year, month, value)``.

One row per source, cell and month; a missing value is NULL. The cell is the only wide
shuffle key: climatology, season totals and composites all reuse a partitioning by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.functions import grid
from solstice.functions.joins import dim_join

# Fixed values of the method.
MIN_EVENTS = 3
MIN_SEASON_NORMAL = 5.0
PCT_LOW, PCT_HIGH = -100.0, 300.0


def clip(x: Column, low: float, high: float) -> Column:
    """Clip to a range; a null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def mask_range(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high) & ~F.isnan(value), value)


def monthly_cube(readings: DataFrame, low: float = 0.0, high: float = 5000.0) -> DataFrame:
    """Bring decoded readings to the cube contract: out-of-range is missing, one row per month."""
    return (
        readings.withColumn("value", mask_range(F.col("value"), low, high))
        .groupBy("source", "cell", "year", "month")
        .agg(F.max("value").alias("value"))
    )


def by_cell(cube: DataFrame) -> DataFrame:
    """Partition once by cell; the not-null filters keep every consumer's plan identical, so the shuffle is reused."""
    return cube.where("cell IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL AND source IS NOT NULL").repartition("cell")


def climatology(cube: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``source, cell, month, clim, n``: mean over the base years, missing months ignored."""
    base = F.when(F.col("year").between(first_year, last_year), F.col("value"))
    return cube.groupBy("source", "cell", "month").agg(F.avg(base).alias("clim"), F.count(base).alias("n")).where("n > 0")


def climatology_vector(clim: DataFrame) -> DataFrame:
    """One row per source and cell with the twelve monthly means in order, nulls kept."""
    columns = [F.max(F.when(F.col("month") == m, F.bround("clim", 0))).alias(f"_{m}") for m in range(1, 13)]
    wide = clim.groupBy("source", "cell").agg(*columns)
    return wide.select("source", "cell", F.array(*[f"_{m}" for m in range(1, 13)]).alias("clim_month"))


def coverage(cube: DataFrame, first_months: int = 24) -> DataFrame:
    """Cells with any value in the first months of each source."""
    index = cal.month_index(F.col("year"), F.col("month"))
    order = Window.partitionBy("source").orderBy("idx")
    months = (
        cube.select("source", index.alias("idx"), "year", "month").distinct()
        .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first_months).select("source", "year", "month")
    )
    # at most ``first_months`` rows per source
    early = dim_join(cube, months, ["source", "year", "month"], bounded=True)
    return early.groupBy("source", "cell").agg(F.bool_or(F.col("value").isNotNull()).alias("covered"))


def choose_source(
    clim: DataFrame, primary: str, fallback: str, cells: DataFrame | None = None, covered: DataFrame | None = None
) -> DataFrame:
    """``cell, source``: the primary source where it is covered and has all twelve normals.

    ``cells`` adds cells that have no climatology at all.
    """
    full = F.count(F.when(F.col("source") == primary, F.col("clim"))) == 12
    out = clim.groupBy("cell").agg(full.alias("_use"))
    if cells is not None:
        out = cells.join(out, "cell", "left")
    use = F.coalesce("_use", F.lit(False))
    if covered is not None:
        seen = covered.where(F.col("source") == primary).select("cell", F.col("covered").alias("_covered"))
        out = out.join(seen, "cell", "left")
        use = use & F.coalesce("_covered", F.lit(False))
    return out.select("cell", F.when(use, primary).otherwise(fallback).alias("source"))


def event_months(spark: SparkSession, events: DataFrame, month_shift: int = 0) -> DataFrame:
    """``phase, ord, k, year, month`` for every event; 36 rows per event."""
    table = cal.season_month_table(spark, month_shift)
    year = cal.season_start_year(F.col("anchor"), F.col("first_month")) + F.col("year_offset")
    return events.join(F.broadcast(table), how="cross").select("phase", "ord", "k", year.cast("int").alias("year"), "month")


def season_totals(cube: DataFrame, event_month: DataFrame) -> DataFrame:
    """``source, cell, phase, ord, k, total, n``; total is null unless all three months have a value."""
    rows = dim_join(cube, event_month, ["year", "month"])
    out = rows.groupBy("source", "cell", "phase", "ord", "k").agg(F.sum("value").alias("_s"), F.count("value").alias("n"))
    return out.withColumn("total", F.when(F.col("n") == 3, F.col("_s"))).drop("_s")


def season_normals(clim: DataFrame, month_shift: int = 0) -> DataFrame:
    """``source, cell, k, normal``: sum of the three monthly normals, null when one is missing."""
    table = cal.season_month_table(clim.sparkSession, month_shift).select("k", "month")
    out = clim.join(F.broadcast(table), "month").groupBy("source", "cell", "k").agg(F.sum("clim").alias("_s"), F.count("clim").alias("_n"))
    return out.select("source", "cell", "k", F.when(F.col("_n") == 3, steady(F.col("_s"))).alias("normal"))


def steady(x: Column) -> Column:
    """Drop the digits that depend on the order in which a sum was added up."""
    return F.round(x, 9)


def percent_anomaly(total: Column, normal: Column) -> Column:
    return F.when(normal > MIN_SEASON_NORMAL, clip((total / normal - 1.0) * 100.0, PCT_LOW, PCT_HIGH))


def event_anomalies(cube: DataFrame, clim: DataFrame, event_month: DataFrame, month_shift: int = 0) -> DataFrame:
    """``source, cell, phase, ord, k, pct`` per event."""
    totals = season_totals(cube, event_month)
    joined = totals.join(season_normals(clim, month_shift), ["source", "cell", "k"])
    return joined.select("source", "cell", "phase", "ord", "k", percent_anomaly(F.col("total"), F.col("normal")).alias("pct"))


def composite_columns(min_events: int = MIN_EVENTS, digits: int | None = 0) -> list[Column]:
    """Mean, share above zero, population spread and count across events; null below ``min_events``."""
    n = F.count("pct")

    def tidy(x: Column) -> Column:
        return F.when(n >= min_events, x if digits is None else F.bround(x, digits))

    return [
        tidy(F.avg("pct")).alias("pct"),
        tidy(100.0 * F.avg((F.col("pct") > 0).cast("double"))).alias("wetter_frac"),
        tidy(F.stddev_pop("pct")).alias("std"),
        n.alias("n"),
    ]


def composite(anomalies: DataFrame, by: Sequence[str] = ("cell", "phase", "k"), min_events: int = MIN_EVENTS, digits: int | None = 0) -> DataFrame:
    return anomalies.groupBy(*by).agg(*composite_columns(min_events, digits))


def event_vectors(anomalies: DataFrame, events: DataFrame, by: Sequence[str] = ("cell", "phase", "k")) -> DataFrame:
    """Anomaly of every event in event order (nulls kept) and of the last three events.

    The number of events per phase bounds the collected group.
    """
    n_events = events.groupBy("phase").agg(F.max("ord").alias("_n"))
    values = anomalies.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ord", F.bround("pct", 0).alias("pct")))).alias("_m"))
    rows = values.join(F.broadcast(n_events), "phase")
    vector = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda o: F.element_at("_m", o))
    rows = rows.select(*by, vector.alias("events"))
    return rows.withColumn("recent", F.slice("events", F.greatest(F.size("events") - 2, F.lit(1)), F.lit(3)))


def covered_cells(cube: DataFrame, primary: str, first_months: int = 24) -> DataFrame:
    """``cell, covered`` for every cell: whether the primary source has a value in its first months."""
    index = cal.month_index(F.col("year"), F.col("month"))
    months = cube.where(F.col("source") == primary).select("year", "month", index.alias("_i")).distinct().orderBy("_i").limit(first_months)
    early = dim_join(cube, months.select("year", "month", F.lit(True).alias("_early")), ["year", "month"], "left", bounded=True)
    seen = F.col("_early") & (F.col("source") == primary) & F.col("value").isNotNull()
    return early.groupBy("cell").agg(F.coalesce(F.bool_or(seen), F.lit(False)).alias("covered"))


def cell_normals(clim: DataFrame, covered: DataFrame, primary: str, fallback: str, month_shift: int = 0) -> DataFrame:
    """``cell, source, normals``: the chosen source and its twelve season normals, one row per cell.

    The primary source is chosen where ``covered`` says so and all twelve monthly normals exist. The
    months are pivoted by plain aggregates, so the row stays partitioned by cell alone and joins back
    to the season totals without another shuffle.
    """

    def month(source: str, m: int) -> Column:
        return F.max(F.when((F.col("source") == source) & (F.col("month") == m), F.col("clim")))

    wide = clim.groupBy("cell").agg(
        F.array(*[month(primary, m) for m in range(1, 13)]).alias("_p"), F.array(*[month(fallback, m) for m in range(1, 13)]).alias("_f")
    )
    use = F.col("covered") & F.coalesce(F.forall("_p", lambda x: x.isNotNull()), F.lit(False))
    chosen = covered.join(wide, "cell", "left").select(
        "cell", F.when(use, primary).otherwise(fallback).alias("source"), F.when(use, F.col("_p")).otherwise(F.col("_f")).alias("_c")
    )

    def normal(k: Column) -> Column:
        # position in the year of the three months of season k, counted from zero
        first, second, third = (F.get("_c", F.pmod(k - 1 + month_shift + p, F.lit(12))) for p in range(3))
        return steady(first + second + third)

    return chosen.select("cell", "source", F.transform(F.sequence(F.lit(0), F.lit(11)), normal).alias("normals"))


def composite_fact(
    cube: DataFrame,
    events: DataFrame,
    first_year: int,
    last_year: int,
    primary: str,
    fallback: str,
    month_shift: int = 0,
    digits: int | None = 0,
    with_vectors: bool = False,
) -> DataFrame:
    """Composite of every cell, phase and season from the source chosen for the cell, with nulls and ``n`` = 0 where no event counts.

    One shuffle of the cube, by cell: coverage, climatology, season totals, their join and the
    composite all run inside that partitioning. The event vectors come out of the same aggregate.
    """
    placed = by_cell(cube)
    normals = cell_normals(climatology(placed, first_year, last_year), covered_cells(placed, primary), primary, fallback, month_shift)
    totals = season_totals(placed, event_months(cube.sparkSession, events, month_shift)).withColumnRenamed("source", "_source")
    anomalies = (
        totals.join(normals, "cell")
        # not written as an equality, which would become a second join key and force a new shuffle
        .where(F.array_contains(F.array("source"), F.col("_source")))
        .select("cell", "phase", "ord", "k", percent_anomaly(F.col("total"), F.get("normals", F.col("k"))).alias("pct"))
    )
    by_event = [F.map_from_entries(F.collect_list(F.struct("ord", F.bround("pct", 0).alias("pct")))).alias("by_event")] if with_vectors else []
    fact = anomalies.groupBy("cell", "phase", "k").agg(*composite_columns(digits=digits), *by_event)
    # at most one entry per phase and season of a cell; blank ones are made for the slots that have none
    per_cell = fact.groupBy("cell").agg(F.collect_list(F.struct(*fact.columns[1:])).alias("_facts"))
    entry = {f.name: f.dataType for f in fact.schema.fields[1:]}
    phases = events.groupBy("phase").agg(F.max("ord").alias("n_events")).select("phase", "n_events", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    slot = F.struct("phase", F.col("k").cast(entry["k"]).alias("k"))
    slots = phases.agg(F.collect_list(slot).alias("_slots"), F.map_from_entries(F.collect_set(F.struct("phase", "n_events"))).alias("_sizes"))
    rows = normals.select("cell", "source").join(per_cell, "cell", "left").join(F.broadcast(slots), how="cross")
    own = F.coalesce("_facts", F.array().cast(per_cell.schema["_facts"].dataType))
    left = F.array_except("_slots", F.transform(own, lambda f: F.struct(f["phase"].alias("phase"), f["k"].alias("k"))))
    blank = F.transform(left, lambda x: F.struct(*[(x[c] if c in ("phase", "k") else F.lit(None)).cast(kind).alias(c) for c, kind in entry.items()]))
    rows = rows.select("cell", "source", "_sizes", F.explode(F.concat(own, blank)).alias("f"))
    vector = F.transform(F.sequence(F.lit(1), F.element_at("_sizes", F.col("f.phase"))), lambda o: F.element_at("f.by_event", o))
    out = rows.select("cell", "source", "f.phase", "f.k", "f.pct", "f.wetter_frac", "f.std", F.coalesce("f.n", F.lit(0)).cast("bigint").alias("n"), *([vector.alias("events")] if with_vectors else []))
    return out.withColumn("recent", F.slice("events", F.greatest(F.size("events") - 2, F.lit(1)), F.lit(3))) if with_vectors else out


def bilinear_weights(target: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int) -> DataFrame:
    """Four weighted source indices per target cell (longitude wraps, latitude is clipped).

    ``target`` has ``cell_id, lat, lon``; the source axis is regular with longitudes 0..360.
    """
    y = (F.col("lat") - lat0) / dlat
    x = (grid.lon_360(F.col("lon")) - lon0) / dlon
    si = F.greatest(F.lit(0), F.least(F.lit(n_lat - 2), F.ceil(y) - 1))
    sj = F.greatest(F.lit(0), F.least(F.lit(n_lon - 1), F.ceil(x) - 1))
    rows = target.select("cell_id", si.alias("i0"), sj.alias("j0"), clip(y - si, 0.0, 1.0).alias("ly"), clip(x - sj, 0.0, 1.0).alias("lx"))
    corners = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("i0") + di).cast("int").alias("si"),
                    F.pmod(F.col("j0") + dj, F.lit(n_lon)).cast("int").alias("sj"),
                    ((F.col("ly") if di else 1 - F.col("ly")) * (F.col("lx") if dj else 1 - F.col("lx"))).alias("w"),
                )
                for di in (0, 1)
                for dj in (0, 1)
            ]
        )
    )
    return rows.select("cell_id", corners.alias("c")).select("cell_id", "c.si", "c.sj", "c.w")


def bilinear_regrid(source: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of the four corners; null when a corner is missing.

    ``source`` has ``keys, si, sj, value``. The weights are four rows per target cell.
    """
    rows = dim_join(source, weights, ["si", "sj"])
    out = rows.groupBy(*keys, "cell_id").agg(F.sum(F.col("w") * F.col("value")).alias("_s"), F.count("value").alias("_n"))
    return out.select(*keys, "cell_id", F.when(F.col("_n") == 4, F.col("_s")).alias("value"))


def nearest_regrid(source: DataFrame, target: DataFrame, lat0: float, dlat: float, n_lat: int, lon0: float, dlon: float, n_lon: int) -> DataFrame:
    """Value of the nearest source cell for every target cell; ``source`` has ``si, sj`` and values."""
    cells = target.select(
        "cell_id",
        grid.axis_index(F.col("lat"), lat0, dlat, n_lat).alias("si"),
        grid.axis_index(F.col("lon"), lon0, dlon, n_lon).alias("sj"),
    )
    return dim_join(source, cells, ["si", "sj"]).drop("si", "sj")


def middle_sum(values: Column) -> Column:
    """Sum of a few numbers, the same in whatever order they come: each is added last once, and the middle one of these sums is taken.

    Of three numbers these are all the sums there are, so the middle one rounds as most orders do.
    """
    placed = F.array_sort(values)

    def others(i: Column) -> Column:
        return F.aggregate(F.filter(placed, lambda _, j: j != i), F.lit(0.0), lambda s, x: s + x)

    sums = F.array_sort(F.transform(placed, lambda x, i: others(i) + x))
    return F.get(sums, F.floor((F.size(sums) - 1) / 2).cast("int"))


def recent_share(cube: DataFrame, clim: DataFrame, n_months: int = 3, min_normal: float = 15.0) -> DataFrame:
    """``source, cell, pct_of_normal, pct_complete``: total of the last months as a whole percentage of their normal, clipped to 0..500.

    ``pct_of_normal`` counts a missing month as zero; ``pct_complete`` is null unless every month has a value and a normal.
    """
    index = cal.month_index(F.col("year"), F.col("month"))
    order = Window.partitionBy("source").orderBy(F.col("idx").desc())
    months = (
        cube.select("source", index.alias("idx"), "year", "month").distinct()
        .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n_months).select("source", "year", "month")
    )
    # at most ``n_months`` rows per source
    recent = dim_join(cube, months, ["source", "year", "month"], bounded=True).groupBy("source", "cell").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    normals = (
        dim_join(clim, months.select("source", "month").distinct(), ["source", "month"], bounded=True)
        # at most ``n_months`` entries
        .groupBy("source", "cell").agg(middle_sum(F.collect_list("clim")).alias("normal"), F.count("clim").alias("n_normal"))
    )
    rows = recent.join(normals, ["source", "cell"])
    complete = (F.col("n") == n_months) & (F.col("n_normal") == n_months)
    pct = clip(F.bround(100.0 * F.col("total") / F.col("normal"), 0), 0.0, 500.0)
    return rows.where(F.col("normal") > min_normal).select("source", "cell", pct.alias("pct_of_normal"), F.when(complete, pct).alias("pct_complete"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def season_forecast(months: Column, of_months: Column) -> Column:
    """Struct of a season forecast from an array of monthly ``ym, anomaly, mean`` structs.

    Null when no month is usable or the normal is too dry for a percentage.
    """

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = F.array_sort(F.filter(months, lambda m: finite(m["anomaly"]) & finite(m["mean"])))

    def bound(value: Column, body) -> Column:
        # worked out once: a column used several times inside an expression is worked out for every use
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def total(rows: Column, name: str) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, m: acc + m[name])

    def pct(anomaly: Column, normal: Column) -> Column:
        return half_up(100 * anomaly / normal).cast("double")

    def month(m: Column) -> Column:
        normal = m["mean"] - m["anomaly"]
        return F.struct(m["ym"].alias("ym"), F.when(normal >= 5, clip(pct(m["anomaly"], normal), PCT_LOW, PCT_HIGH)).cast("int").alias("pct"))

    def season(rows: Column, anomaly: Column, normal: Column) -> Column:
        return F.when(
            (F.size(rows) > 0) & (normal >= 10),
            F.struct(
                clip(pct(anomaly, normal), PCT_LOW, PCT_HIGH).cast("int").alias("pct"),
                (pct(anomaly, normal) > 300).alias("capped"),
                F.size(rows).alias("n_months"),
                of_months.cast("int").alias("of_months"),
                half_up(normal).alias("normal_mm"),
                half_up(anomaly).alias("anomaly_mm"),
                F.transform(rows, month).alias("monthly"),
            ),
        )

    def summed(rows: Column) -> Column:
        totals = F.struct(total(rows, "anomaly").alias("anomaly"), total(rows, "mean").alias("mean"))
        return bound(totals, lambda s: season(rows, s["anomaly"], s["mean"] - s["anomaly"]))

    return bound(rows, summed)


def forecast_months(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monthly forecast rows nested per place; one row per place and month, a handful of months per run."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("ym", "anomaly", "mean")).alias("months"))


def forecast_reduction(rows: DataFrame, keys: Sequence[str], of_months: int) -> DataFrame:
    """Season forecast from monthly ``ym, anomaly, mean`` rows already limited to the wanted months."""
    reduced = forecast_months(rows, keys).withColumn("_f", season_forecast(F.col("months"), F.lit(of_months)))
    return reduced.where("_f IS NOT NULL").select(*keys, "_f.*")
