"""Decision rules that turn statistics and forecasts into words: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Skill class, probability band, confidence word, template, what to lean on.
RULES = [
    ("good", "strong", "likely", "forecast_confident", "forecast"),
    ("good", "moderate", "leaning", "forecast_confident", "forecast"),
    ("good", "weak", "uncertain", "forecast_weak", "history"),
    ("fair", "strong", "leaning", "forecast_skill_partial", "both"),
    ("fair", "moderate", "uncertain", "forecast_skill_partial", "both"),
    ("fair", "weak", "uncertain", "forecast_weak", "history"),
    ("poor", "strong", "uncertain", "forecast_unreliable", "history"),
    ("poor", "moderate", "uncertain", "forecast_unreliable", "history"),
    ("poor", "weak", "uncertain", "forecast_unreliable", "history"),
    ("unknown", "strong", "leaning", "forecast_unchecked", "both"),
    ("unknown", "moderate", "uncertain", "forecast_unchecked", "both"),
    ("unknown", "weak", "uncertain", "forecast_weak", "history"),
]
# Lowest correlation and ROC area of the skill classes, lowest probability of the bands.
SKILL_LIMITS = {"good": (0.5, 0.7), "fair": (0.3, 0.6)}
BAND_LIMITS = {"strong": 60, "moderate": 45}
# Whom to trust when forecast and history disagree.
TRUST_FORECAST = ["good"]
TRUST_HISTORY = ["poor", "unknown"]
# Shares that make a history consistent or mixed.
CONSISTENT_SHARE, MIXED_SHARE = 0.75, 0.6
# The confidence ladder.
LADDER = ["uncertain", "leaning", "likely"]
MIN_EVENTS, MAX_STEPS = 3, 10


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "skill STRING, band STRING, rule_confidence STRING, template STRING, lean_on STRING")


def rain_sign(phrase: Column) -> Column:
    return F.when(phrase.rlike("(?i)wetter"), 1).when(phrase.rlike("(?i)drier"), -1).otherwise(0)


def agreement(pct: Column, sign: Column, std: Column | None = None) -> Column:
    """How a percentage fits an expected sign: none, weak, agree or disagree."""
    weak = F.abs(pct) <= 5
    if std is not None:
        weak = weak | F.coalesce((std != 0) & (F.abs(pct) < std / 2), F.lit(False))
    return F.when(pct.isNull() | (sign == 0), "none").when(weak, "weak").when((pct > 0) == (sign > 0), "agree").otherwise("disagree")


def base_confidence(curated: Column, agree: Column) -> Column:
    return (
        F.when(curated == "high", F.when(agree == "disagree", "leaning").otherwise("likely"))
        .when((curated == "medium") & (agree == "agree"), "leaning")
        .otherwise("uncertain")
    )


def step(word: Column, by: int) -> Column:
    """Move along uncertain, leaning, likely; the ends stay."""
    ladder = F.array(*[F.lit(w) for w in LADDER])
    place = F.array_position(ladder, word) - 1 + by
    return F.get(ladder, F.greatest(F.lit(0), F.least(F.lit(len(LADDER) - 1), place)).cast("int"))


def skill_class(correlation: Column, roc: Column) -> Column:
    """good, fair or poor; unknown without a correlation. A missing ROC area does not count against a cell."""

    def passes(name: str) -> Column:
        low_corr, low_roc = SKILL_LIMITS[name]
        return (correlation >= low_corr) & (roc.isNull() | (roc >= low_roc))

    return F.when(correlation.isNull(), "unknown").when(passes("good"), "good").when(passes("fair"), "fair").otherwise("poor")


def fallback_probability(pct: Column) -> Column:
    """Stands in for a missing probability: larger anomalies count as more certain."""
    return F.when(F.abs(pct) >= 25, 60).when(F.abs(pct) >= 10, 45).otherwise(0)


def probability_band(probability: Column) -> Column:
    return F.when(probability >= BAND_LIMITS["strong"], "strong").when(probability >= BAND_LIMITS["moderate"], "moderate").when(
        probability.isNotNull(), "weak"
    )


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the wording rule of ``skill, band``; the rule table has one row per pair."""
    return df.join(F.broadcast(rules), ["skill", "band"], "left")


def disagreement(skill: Column) -> Column:
    return F.when(skill.isin(TRUST_FORECAST), "trust_forecast").when(skill.isin(TRUST_HISTORY), "trust_history").otherwise("say_both")


def merged_confidence(base: Column, history: Column, forecast: Column, skill: Column, rule_confidence: Column, lean_on: Column) -> Column:
    """Confidence after the forecast was weighed with the wording rules; without a rule the base stays."""
    by_disagreement = F.when(disagreement(skill) == "trust_forecast", rule_confidence).otherwise(step(base, -1))
    by_agreement = F.when((lean_on != "history") & (skill == "good"), step(base, 1)).otherwise(base)
    return (
        F.when(rule_confidence.isNull(), base)
        .when(forecast == "disagree", by_disagreement)
        .when((forecast == "agree") & (history != "disagree"), by_agreement)
        .when((lean_on == "forecast") & (history == "none"), rule_confidence)
        .otherwise(base)
    )


def merged_confidence_plain(base: Column, history: Column, forecast: Column) -> Column:
    """The same without wording rules: one step down or up."""
    return F.when(forecast == "disagree", step(base, -1)).when((forecast == "agree") & (history != "disagree"), step(base, 1)).otherwise(base)


def consistency(pct: Column, wetter_frac: Column, n: Column) -> Column:
    """Struct ``k, n, direction, cls``: in how many of n events the sign was the composite's."""
    share = F.when(pct >= 0, wetter_frac / 100).otherwise(1 - wetter_frac / 100)
    cls = F.when(share >= CONSISTENT_SHARE, "consistent").when(share <= MIXED_SHARE, "mixed").otherwise("leaning")
    out = F.struct(
        F.floor(share * n + 0.5).alias("k"), n.alias("n"), F.when(pct >= 0, "wetter").otherwise("drier").alias("direction"), cls.alias("cls")
    )
    return F.when(pct.isNotNull() & (n >= MIN_EVENTS), out)


def labelled(values: Column, labels: Column, last: int | None = None) -> Column:
    """Pair event values with labels by position, drop nulls; ``last`` keeps the newest positions only."""
    pairs = F.arrays_zip(values.alias("pct"), labels.alias("label"))
    if last is not None:
        pairs = F.slice(pairs, F.greatest(F.size(values) - last + 1, F.lit(1)), F.lit(last))
    kept = F.filter(pairs, lambda p: p["pct"].isNotNull())
    return F.transform(kept, lambda p: F.struct(p["label"].alias("label"), p["pct"].alias("pct")))


def history(row_n: Column, pct: Column, wetter_frac: Column, std: Column, events: Column, labels: Column, season: Column, source: Column) -> Column:
    """Struct of the historical pattern; too few events give ``too_few`` and no average."""
    enough = (row_n >= MIN_EVENTS) & pct.isNotNull()

    def only(x: Column) -> Column:
        return F.when(enough, x)

    return F.when(
        row_n.isNotNull(),
        F.struct(
            (~enough).alias("too_few"), row_n.alias("n_events"), only(season).alias("season"), only(pct).alias("composite_pct"),
            only(wetter_frac).alias("wetter_frac"), only(std).alias("std"), labelled(events, labels, 3).alias("recent"),
            only(labelled(events, labels)).alias("all"), source.alias("src"),
        ),
    )


def hazard_list(region: Column, added: Column) -> Column:
    """Region hazards, then the country's own, each once."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.array_distinct(F.coalesce(region, empty)), F.coalesce(added, empty))


def chosen_steps(listed: Column, livelihood: Column, limit: int = MAX_STEPS) -> Column:
    """Steps in order that fit the livelihood; each id once."""
    fitting = F.filter(listed, lambda s: F.array_contains(s["for"], "all") | F.array_contains(s["for"], livelihood))
    ids = F.transform(fitting, lambda s: s["id"])
    return F.slice(F.filter(fitting, lambda s, i: F.array_position(ids, s["id"]) == i + 1), 1, limit)


def with_steps(places: DataFrame, steps: DataFrame) -> DataFrame:
    """Add ``steps``: those of the hazards in order, then the always-steps.

    ``places`` has ``hazards, livelihood``; ``steps`` has ``hazard, ord, id, icon, text, why, minutes, for``. The
    list of steps is put together once per distinct hazard list, by equi joins.
    """
    one = F.struct("ord", *[c for c in ("id", "icon", "text", "why", "minutes", "for") if c in steps.columns])
    lists = steps.groupBy("hazard").agg(F.array_sort(F.collect_list(one)).alias("list"))
    asked = places.select(F.col("hazards").alias("_h")).distinct()
    wanted = F.array_append(F.coalesce("_h", F.array().cast("array<string>")), F.lit("always"))
    parts = asked.select("_h", F.posexplode(wanted).alias("pos", "hazard")).join(lists, "hazard")
    listed = parts.groupBy("_h").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "list"))), lambda p: p["list"])).alias("_listed"))
    joined = places.join(listed, F.col("hazards").eqNullSafe(F.col("_h")), "left")
    none = F.array().cast(listed.schema["_listed"].dataType)
    return joined.withColumn("steps", chosen_steps(F.coalesce("_listed", none), F.col("livelihood"))).drop("_h", "_listed")


def conditions(recent_pct: Column, category: Column) -> Column:
    """Struct of the current conditions; null unless one of the two values exists."""
    return F.when(
        recent_pct.isNotNull() | category.isNotNull(), F.struct(recent_pct.alias("recent_rain_pct"), category.cast("int").alias("usdm"))
    )


def present(*items: Column) -> Column:
    """The non-null items in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
