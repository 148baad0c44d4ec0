"""Event detection in index series: runs, peaks, strength classes, year classes.

A series table has ``key`` columns, an ordering column ``pos`` and a value ``v``; one call
handles any number of series. Long series are cut into blocks of ``pos`` so that one series
holding most of the rows is spread over many tasks; only the outer runs of each block are
stitched together per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions import calendar as cal

BLOCK = 4096


def sign_of(v: Column, threshold: float = 0.5) -> Column:
    return F.when(v >= threshold, 1).when(v <= -threshold, -1).otherwise(0)


def strength(peak: Column) -> Column:
    """Class limits on the absolute peak."""
    a = F.abs(peak)
    return F.when(a >= 2.0, "very strong").when(a >= 1.5, "strong").when(a >= 1.0, "moderate").otherwise("weak")


def find_runs(
    series: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str] = (),
    threshold: float = 0.5,
    min_run: int = 5,
    block: int = BLOCK,
) -> DataFrame:
    """Maximal stretches of consecutive rows with one non-zero sign and at least ``min_run`` rows.

    Returns ``keys, sign, n, first, last, peak``; the last three are structs of
    ``pos, v`` and the ``carry`` columns. The earliest row wins a tied peak.
    """
    keys = list(keys)
    row = F.struct("pos", "v", *carry)
    rows = series.select(
        *keys, "pos", (F.col("pos") / block).cast("bigint").alias("_block"), sign_of(F.col("v"), threshold).alias("sign"), row.alias("_row")
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy("pos")
    turn = F.coalesce((F.lag("sign").over(in_block) != F.col("sign")).cast("int"), F.lit(0))
    rows = rows.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(in_block))
    peak = F.min(F.struct((-F.col("_row.v") * F.col("sign")).alias("rank"), F.col("pos"), F.col("_row")))
    pieces = rows.groupBy(*keys, "_block", "_run", "sign").agg(
        F.count("*").alias("n"), F.min("_row").alias("first"), F.max("_row").alias("last"), peak.alias("peak")
    )
    # runs strictly inside a block are complete; the first and the last may continue next door
    whole_block = Window.partitionBy(*keys, "_block")
    pieces = pieces.withColumn("_edge", (F.col("_run") == 0) | (F.col("_run") == F.max("_run").over(whole_block)))
    inner = pieces.where(~F.col("_edge") & (F.col("sign") != 0)).select(*keys, "sign", "n", "first", "last", "peak")
    along = Window.partitionBy(*keys).orderBy("_block", "_run")
    joined = (F.lag("sign").over(along) == F.col("sign")) & (F.lag("_block").over(along) != F.col("_block"))
    edges = (
        pieces.where("_edge")
        .withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
        .withColumn("_id", F.sum("_new").over(along))
        .groupBy(*keys, "_id", "sign")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("peak").alias("peak"))
        .where("sign != 0")
        .select(*keys, "sign", "n", "first", "last", "peak")
    )
    return inner.unionByName(edges).where(F.col("n") >= min_run).withColumn("peak", F.col("peak._row"))


def run_events(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Describe each run of a monthly index whose rows carry ``year`` and ``month``."""
    names = cal.season_names()

    def season(row: str) -> Column:
        return F.concat_ws(" ", F.get(names, F.col(f"{row}.month") - 1), F.col(f"{row}.year").cast("string"))

    anchor = cal.event_year(F.col("peak.year"), F.col("peak.month"))
    return runs.select(
        *keys,
        F.when(F.col("sign") > 0, "el_nino").otherwise("la_nina").alias("type"),
        season("first").alias("start"),
        season("last").alias("end"),
        F.col("first.year").alias("start_year"),
        F.col("last.year").alias("end_year"),
        cal.event_label(F.col("first.year"), F.col("last.year")).alias("label"),
        F.col("peak.v").alias("peak_value"),
        season("peak").alias("peak_season"),
        anchor.alias("anchor_year"),
        cal.event_label(anchor, anchor + 1).alias("analog_label"),
        strength(F.col("peak.v")).alias("strength"),
        F.col("n").alias("n_seasons"),
    )


def strong_events(events: DataFrame, keys: Sequence[str], first_year: int = 1979) -> DataFrame:
    """Strong and very strong events per type, numbered in time order."""
    picked = events.where(F.col("strength").isin("strong", "very strong") & (F.col("start_year") >= first_year))
    order = Window.partitionBy(*keys, "type").orderBy("anchor_year", "start_year", "start")
    return picked.withColumn("ord", F.row_number().over(order))


def classify_years(
    series: DataFrame, strong: DataFrame, keys: Sequence[str], first_year: int, last_year: int, threshold: float = 0.5
) -> DataFrame:
    """Class of every July-June year: a strong event's type, ``neutral`` or ``other``.

    Neutral needs all twelve seasons present and inside the threshold.
    """
    keys = list(keys)
    per_year = (
        series.withColumn("event_year", cal.event_year(F.col("year"), F.col("month")))
        .groupBy(*keys, "event_year")
        .agg(F.count("v").alias("n"), F.max(F.abs("v")).alias("worst"))
    )
    years = series.select(*keys).distinct().withColumn("event_year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    peaks = strong.groupBy(*keys, F.col("anchor_year").alias("event_year")).agg(F.min("type").alias("type"))
    neutral = (F.col("n") == 12) & (F.col("worst") < threshold)
    return (
        years.join(per_year, [*keys, "event_year"], "left")
        .join(peaks, [*keys, "event_year"], "left")
        .select(*keys, "event_year", F.coalesce("type", F.when(neutral, "neutral"), F.lit("other")).alias("cls"))
    )


CLASSES = ["el_nino", "la_nina", "neutral", "other"]


def class_counts(years: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of years per class, with a row for every class."""
    counts = years.groupBy(*keys).agg(*[F.count_if(F.col("cls") == c).alias(c) for c in CLASSES])
    return counts.unpivot(list(keys), CLASSES, "cls", "n_years")


def latest(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.max(F.struct("pos", "year", "month", "v")).alias("r")).select(*keys, "r.year", "r.month", "r.v")
