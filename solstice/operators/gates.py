"""Quality gates: every check is a DataFrame row, evaluated by one action per publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.functions.joins import dim_join


def slice_quality(slices: DataFrame, keys: Sequence[str], min_share: float = 0.5, max_abs: float = 1.0) -> DataFrame:
    """Share of present values and largest magnitude of every slice of a cube."""
    stats = slices.groupBy(*keys).agg(
        F.avg(F.col("value").isNotNull().cast("double")).alias("finite_share"), F.coalesce(F.max(F.abs("value")), F.lit(0.0)).alias("max_abs")
    )
    return stats.withColumn("ok", (F.col("finite_share") > min_share) & (F.col("max_abs") < max_abs))


def usable_slices(slices: DataFrame, keys: Sequence[str], min_share: float = 0.5, max_abs: float = 1.0) -> DataFrame:
    return slice_quality(slices, keys, min_share, max_abs).where("ok").select(*keys)


def count_drop(current: DataFrame, previous: DataFrame, gate: str, keep_share: float = 0.9) -> DataFrame:
    """Gate row that fails when the row count fell below a share of the previous build's ``count``."""
    now = current.agg(F.count("*").cast("double").alias("value"))
    before = previous.select((F.col("count") * keep_share).cast("double").alias("lo"))
    # both sides are single rows
    return now.join(F.broadcast(before), how="cross").select(
        F.lit(gate).alias("gate"), "value", "lo", F.lit(None).cast("double").alias("hi"), (F.col("value") >= F.col("lo")).alias("ok")
    )


def range_gates(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per column: number of values outside the range (nulls are allowed); all in one pass."""
    counts = df.agg(*[F.count_if(~F.col(c).between(lo, hi)).cast("double").alias(c) for c, (lo, hi) in bounds.items()])
    rows = counts.unpivot([], list(bounds), "column", "value")
    return rows.select(
        F.concat(F.lit("range of "), "column").alias("gate"), "value", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), (F.col("value") == 0).alias("ok")
    )


def size_gate(df: DataFrame, gate: str, lo: float, hi: float, value=None) -> DataFrame:
    """Row count (or another aggregate) inside ``lo..hi``."""
    measured = F.count("*") if value is None else value
    out = df.agg(measured.cast("double").alias("value"))
    return out.select(F.lit(gate).alias("gate"), "value", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.coalesce(F.col("value").between(lo, hi), F.lit(False)).alias("ok"))


def union_gates(*gates: DataFrame) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def direction_checks(fact: DataFrame, checks: DataFrame, on: Sequence[str], value: str = "pct") -> DataFrame:
    """Known signs against a fact table: ``checks`` has ``name, expect`` (wetter, drier), ``required`` and the join columns.

    A check without a value fails.
    """
    matched = dim_join(fact, checks.select("name", *on), on).select("name", *on, F.col(value).alias("_v"))
    rows = checks.join(matched, ["name", *on], "left")
    right = F.coalesce((F.col("_v") > 0) == (F.col("expect") == "wetter"), F.lit(False))
    return rows.select(*checks.columns, F.col("_v").alias("value"), right.alias("ok"))


def failed_required(checked: DataFrame) -> DataFrame:
    """Failures that refuse a publication; documented exceptions have ``required = false``."""
    return checked.where(~F.col("ok") & F.col("required"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def freshness(layers: DataFrame, limits: DataFrame, now: str) -> DataFrame:
    """Age of every layer in days against its limit; a missing layer has no age and no verdict.

    ``layers``: ``layer, as_of`` (timestamp), ``missing``; ``limits``: ``layer, max_days``.
    """
    rows = limits.join(layers, "layer", "left")
    seconds = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("as_of")
    rows = rows.withColumns({"age_days": F.floor(seconds / 86400 + 0.5), "missing": F.coalesce("missing", F.lit(True))})
    stale = F.when(~F.col("missing"), F.col("age_days").isNull() | (F.col("age_days") > F.col("max_days")))
    return rows.select("layer", "as_of", "age_days", "max_days", "missing", stale.alias("stale"))


def any_stale(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("stale"), F.lit(False)).alias("alert"), F.count_if(F.col("stale")).alias("stale_layers"))


def bulletin_problems(parsed: DataFrame, min_synopsis: int = 20) -> DataFrame:
    """Add ``problems``: what a parsed bulletin lacks; empty when it may be published."""
    p = F.col("headline_probability_pct")

    def problem(test, text: str):
        return F.when(test, F.lit(text))

    checks = F.array(
        problem(F.coalesce("issued", F.lit("")) == "", "issued date missing"),
        problem(F.coalesce("status", F.lit("")) == "", "status line missing"),
        problem(F.coalesce(F.char_length("synopsis"), F.lit(0)) < min_synopsis, "synopsis missing"),
        problem(F.coalesce(~p.between(0, 100), F.lit(False)), "probability out of bounds"),
    )
    return parsed.withColumn("problems", F.filter(checks, lambda x: x.isNotNull()))


def non_finite(df: DataFrame) -> DataFrame:
    """One row per floating column: how many values are NaN or infinite."""
    columns = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    bad = [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "column", "n").withColumn("ok", F.col("n") == 0)


def grid_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Grid points that only one of two sources has; empty when the grids are equal."""
    both = a.withColumn("only_in", F.lit("first")).unionByName(b.withColumn("only_in", F.lit("second")))
    sides = both.groupBy(*a.columns).agg(F.min("only_in").alias("only_in"), F.max("only_in").alias("_other"))
    return sides.where(F.col("only_in") == F.col("_other")).drop("_other")


def latest_period_gate(cube: DataFrame, today: str, max_days: int = 120) -> DataFrame:
    """Age in days of the newest month of each source."""
    newest = cube.groupBy("source").agg(F.max(F.make_date("year", "month", F.lit(1))).alias("latest"))
    age = F.datediff(F.to_date(F.lit(today)), "latest")
    return newest.select("source", "latest", age.alias("age_days"), (age <= max_days).alias("ok"))


def sample_gate(clim: DataFrame, min_samples: int) -> DataFrame:
    """Smallest number of years behind a monthly normal, per source."""
    return clim.groupBy("source").agg(F.min("n").alias("samples")).withColumn("ok", F.col("samples") >= min_samples)


def registry(*layers: DataFrame) -> DataFrame:
    """All provenance rows of all layers in one table; absent columns are null."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def stale_after(issued, now: str, days: int = 45):
    """Time after which a status counts as stale; an unreadable date counts from now."""
    # the bulletin's day has one or two digits
    day = F.coalesce(F.try_to_timestamp(issued, F.lit("d MMMM yyyy")), F.to_timestamp(F.lit(now)))
    return day + F.make_dt_interval(F.lit(days))


class TooFewRows(ValueError):
    """A run that would publish less than its minimum."""


def require_rows(good: DataFrame, minimum: int, unit: str | None = None) -> DataFrame:
    """``good`` itself, or a failed run when it has fewer rows (or distinct ``unit`` values) than the minimum."""
    counted = good if unit is None else good.select(unit).distinct()
    n = counted.limit(minimum).count()
    if n < minimum:
        raise TooFewRows(f"{n} of at least {minimum} {unit or 'rows'} are left")
    return good


def quarantine(rows: DataFrame, unit: str, problem) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and one counted row per bad unit, with the first problem found."""
    marked = rows.withColumn("_p", problem)
    bad = marked.where("_p IS NOT NULL").groupBy(unit).agg(F.min("_p").alias("problem"), F.count("*").alias("n"))
    good = marked.where("_p IS NULL").drop("_p").join(bad.select(unit), unit, "left_anti")
    return good, bad
