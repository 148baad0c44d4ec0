"""Climatology and composites kept up to date by sums that add up.

Two keyed tables hold what the statistics need: counts and sums per source, cell and month of the year over the base years,
and per source, cell, phase, event and season. New months add to the rows they touch; the cube is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.functions.joins import dim_join
from solstice.operators import cube as op
from solstice.sources import keyed

MONTH_KEYS = ("source", "cell", "month")
SEASON_KEYS = ("source", "cell", "phase", "ord", "k")


def _sums(value: Column) -> list[Column]:
    return [F.count(value).alias("n"), F.sum(value).alias("s")]


def month_sums(cube: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``source, cell, month, n, s`` over the base years."""
    return cube.where(F.col("year").between(first_year, last_year)).groupBy(*MONTH_KEYS).agg(*_sums(F.col("value")))


def season_sums(cube: DataFrame, event_month: DataFrame) -> DataFrame:
    """``source, cell, phase, ord, k, n, s`` over the months of the events."""
    return dim_join(cube, event_month, ["year", "month"]).groupBy(*SEASON_KEYS).agg(*_sums(F.col("value")))


def _add(spark: SparkSession, root: str, sums: DataFrame, keys: Sequence[str], run_id: str, n_parts: int) -> None:
    now = keyed.state(spark, root)
    if now is not None and now.run_id >= run_id:
        return
    # the sums are used several times; the months behind them are read once
    sums = sums.persist()
    rows = sums
    if now is not None:
        # rows that stand are read for the keys that arrive only
        rows = sums.unionByName(keyed.read(spark, root).join(sums.select(*keys), list(keys), "left_semi"))
    keyed.upsert(rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), root, keys, n_parts=n_parts, run_id=run_id)
    sums.unpersist()


def add_months(cube: DataFrame, root: str, event_month: DataFrame, first_year: int, last_year: int, run_id: str, n_parts: int = 64) -> None:
    """Add months that were not there before; ``run_id``s rise, and one that was added already is skipped, in either table.

    ``event_month`` is ``cube.event_months``. Base years and events are those the tables began with: other ones need tables of their own.
    """
    spark = cube.sparkSession
    placed = op.by_cell(cube)
    _add(spark, f"{root}/months", month_sums(placed, first_year, last_year), MONTH_KEYS, run_id, n_parts)
    _add(spark, f"{root}/seasons", season_sums(placed, event_month), SEASON_KEYS, run_id, n_parts)


def climatology(spark: SparkSession, root: str) -> DataFrame:
    """As ``cube.climatology``."""
    rows = keyed.read(spark, f"{root}/months").where("n > 0")
    return rows.select(*MONTH_KEYS, (F.col("s") / F.col("n")).alias("clim"), "n")


def anomalies(spark: SparkSession, root: str, month_shift: int = 0) -> DataFrame:
    """As ``cube.event_anomalies``."""
    normals = op.season_normals(climatology(spark, root), month_shift)
    totals = keyed.read(spark, f"{root}/seasons").withColumn("total", F.when(F.col("n") == 3, F.col("s")))
    return totals.join(normals, ["source", "cell", "k"]).select(*SEASON_KEYS, op.percent_anomaly(F.col("total"), F.col("normal")).alias("pct"))
