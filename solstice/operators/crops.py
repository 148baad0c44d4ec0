"""Crop windows, farming context of a season, and country indicators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solstice.functions import calendar as cal
from solstice.functions.joins import dim_join

# Staple classes and their keywords, first match wins ("soybean" holds "bean").
STAPLES = [
    ("maize", ["maize", "corn"]),
    ("rice", ["rice"]),
    ("wheat", ["wheat"]),
    ("sorghum", ["sorghum"]),
    ("millet", ["millet"]),
    ("beans", ["bean"]),
    ("cassava", ["cassava", "manioc"]),
    ("potato", ["potato"]),
    ("groundnut", ["groundnut", "peanut"]),
    ("soybean", ["soy"]),
    ("cowpea", ["cowpea"]),
    ("teff", ["teff"]),
    ("barley", ["barley"]),
    ("banana", ["banana", "plantain"]),
    ("cotton", ["cotton"]),
    ("coffee", ["coffee"]),
]
# Order in which staples are mentioned.
STAPLE_ORDER = ["maize", "rice", "wheat", "sorghum", "millet", "beans", "cassava", "potato", "groundnut", "soybean"]
# Indicator codes, their columns and the class limits on the index.
INDICATORS = {"INFORM": "inform", "HA": "hazard", "VU": "vulnerability", "CC": "coping"}
CLASS_LIMITS = [(6.5, "very high"), (5.0, "high"), (3.5, "medium"), (2.0, "low")]
MAX_CROPS = 3


def first_keyword_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]] = STAPLES) -> Column:
    """First class with a keyword inside the lower-case text; null when none has."""
    low = F.lower(text)
    tests = [F.when(_any([low.contains(w) for w in words]), name) for name, words in classes]
    return F.coalesce(*tests)


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def crop_windows(sessions: DataFrame) -> DataFrame:
    """One row per country and crop: sowing and harvest months over all zones and sessions.

    ``sessions``: ``iso2, crop, zone, all_year, early_sowing, later_sowing, early_harvest, late_harvest``.
    Equal sessions count once, and leave before anything is worked out. Distinct month ranges (at most 144) are merged, so
    sessions are never multiplied into months; zones are counted in a first pass per zone.
    """

    def months(a: str, b: str) -> Column:
        return cal.month_range(F.col(a), F.coalesce(b, a))

    asked = ("iso2", "crop", "zone", "all_year", "early_sowing", "later_sowing", "early_harvest", "late_harvest")
    # counted, as the optimizer drops a plain distinct before sets
    ranged = sessions.groupBy(*asked).agg(F.count("*").alias("_n")).where("_n > 0").withColumns({"_s": months("early_sowing", "later_sowing"), "_h": months("early_harvest", "late_harvest")})
    per_zone = ranged.groupBy("iso2", "crop", F.coalesce("zone", F.lit("")).alias("zone")).agg(
        F.bool_or(F.lower(F.coalesce("all_year", F.lit("no"))) == "yes").alias("_all"),
        _union(F.collect_set("_s")).alias("_s"), _union(F.collect_set("_h")).alias("_h"),
    )
    out = per_zone.groupBy("iso2", "crop").agg(
        F.array_sort(_union(F.collect_set("_s"))).alias("sowing"), F.array_sort(_union(F.collect_set("_h"))).alias("harvest"),
        F.count_if(F.col("zone") != "").alias("zones"), F.bool_or("_all").alias("all_year"),
    )
    return out.withColumn("staple", first_keyword_class(F.col("crop")))


def _union(arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def usable_windows(windows: DataFrame) -> DataFrame:
    """Crops with a window, or grown all year."""
    return windows.where((F.size("sowing") > 0) | (F.size("harvest") > 0) | F.col("all_year"))


def country_staples(windows: DataFrame) -> DataFrame:
    return usable_windows(windows).groupBy("iso2").agg(F.array_sort(F.collect_set("staple")).alias("staples"))


def country_crops(windows: DataFrame) -> DataFrame:
    """``iso2, crops``: the crops of a country in the order they are mentioned.

    One entry per crop name, so the array has the length of the country's crop list.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STAPLE_ORDER]), F.col("staple"))
    rank = F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(100)
    entry = F.struct(
        rank.alias("rank"), (-F.col("zones")).alias("fewer"), F.col("crop").alias("name"),
        F.coalesce("staple", F.lower("crop")).alias("crop"), "sowing", "harvest", "all_year",
    )
    return windows.groupBy("iso2").agg(F.array_sort(F.collect_list(entry)).alias("crops"))


def farming_context(crops: Column, months: Column, sign: Column) -> Column:
    """Struct ``crop, crops, stage, window, direction`` of a season, or null.

    Planting is looked at before harvest; the first stage with an overlapping crop decides.
    """

    def at(stage: str) -> Column:
        hits = F.filter(crops, lambda c: ~c["all_year"] & F.arrays_overlap(c[stage], months))
        names = F.slice(F.array_distinct(F.transform(hits, lambda c: c["crop"])), 1, MAX_CROPS)
        first = F.get(hits, F.lit(0))[stage]
        anchor = F.get(F.filter(first, lambda m: F.array_contains(months, m)), F.lit(0))
        return F.when(
            F.size(hits) > 0,
            F.struct(
                F.get(names, F.lit(0)).alias("crop"), names.alias("crops"), F.lit("planting" if stage == "sowing" else "harvest").alias("stage"),
                cal.circular_run(first, anchor).alias("window"), F.when(sign > 0, "wetter").otherwise("drier").alias("direction"),
            ),
        )

    usable = crops.isNotNull() & (F.size(months) > 0) & (sign != 0)
    return F.when(usable, F.coalesce(at("sowing"), at("harvest")))


def pivot_indicators(scores: DataFrame, codes: dict[str, str] = INDICATORS, key: str = "iso3") -> DataFrame:
    """Long ``key, ind, score`` to one column per indicator, one decimal; unknown codes and nulls dropped."""
    known = scores.where(F.col("ind").isin(list(codes)) & F.col("score").isNotNull() & F.col(key).isNotNull())
    wide = known.groupBy(key).agg(*[F.max(F.when(F.col("ind") == code, F.bround("score", 1))).alias(name) for code, name in codes.items()])
    return wide


def complete_rows(wide: DataFrame, columns: Sequence[str] = tuple(INDICATORS.values())) -> DataFrame:
    return wide.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))


@F.pandas_udf(T.DoubleType())
def _cube_root(x: pd.Series) -> pd.Series:
    """The C library's power, as SQL engines take it: the JVM's differs in the last bit, which decides gaps of just the tolerance."""
    return pd.Series([None if math.isnan(v) else math.nan if v < 0 else math.pow(v, 1 / 3) for v in x], dtype="float64")


def index_mismatch(wide: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """Rows whose index differs from the geometric mean of its three dimensions."""
    mean = _cube_root(F.col("hazard") * F.col("vulnerability") * F.col("coping"))
    return wide.withColumn("gap", F.abs(mean - F.col("inform"))).where(F.col("gap") > tolerance)


def index_class(index: Column) -> Column:
    out = F.when(index >= CLASS_LIMITS[0][0], CLASS_LIMITS[0][1])
    for limit, name in CLASS_LIMITS[1:]:
        out = out.when(index >= limit, name)
    return out.otherwise("very low")


def is_rural(pop: Column) -> Column:
    return F.coalesce((pop > 0) & (pop < 20_000), F.lit(False))


def with_farming_context(places: DataFrame, crops: DataFrame) -> DataFrame:
    """Add ``farmer``; ``places`` has ``cc, months, rain_sign, livelihood, pop``.

    The context is worked out once per country, season and sign that occur, not per place.
    """
    wanted = (F.col("livelihood") == "farmer") | is_rural(F.col("pop"))
    keys = ["cc", "months", "rain_sign"]
    # one row per country
    seasons = dim_join(places.where(wanted).select(*keys).distinct(), crops.select(F.col("iso2").alias("cc"), "crops"), "cc", bounded=True)
    known = seasons.select(*keys, farming_context(F.col("crops"), F.col("months"), F.col("rain_sign")).alias("farmer")).where("farmer IS NOT NULL")
    # a place without one of the three has no context; a row per country, season (144 month ranges) and sign at most
    joined = dim_join(places, known.withColumnRenamed("farmer", "_farmer"), keys, "left", bounded=True)
    return joined.select(*places.columns, F.when(wanted, F.col("_farmer")).alias("farmer"))
