"""The facts row: everything known about a place and its season, one row per place.

Each layer is a left join to a lookup that is keyed by grid cell, region or country, or nested
per place; the places themselves are shuffled only for layers that are keyed by place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.functions import grid
from solstice.functions.joins import dim_join
from solstice.operators import crops as crop_ops
from solstice.operators import cube, rules, spatial


@dataclass
class Provenance:
    """Where a layer comes from."""

    name: str
    version: str | None = None
    url: str | None = None
    retrieved_at: str | None = None


@dataclass
class Profiles:
    """Everything known about a cell, a country, and a region in a phase, one row each."""

    cells: DataFrame  # cell_id, _history, and the columns of the layers per cell
    countries: DataFrame  # cc, service, crops, maps of local season by region and of added hazards by phase
    regions: DataFrame  # region_id, phase, the signal, the region's sources


@dataclass
class FactInputs:
    """Tables of the facts job. Optional layers may be None; their fields are then null."""

    places: DataFrame  # place_id, lat, lon, cc, pop, livelihood
    land: DataFrame  # i, j of the land cells
    composites: DataFrame  # cell_id, source, phase (en, ln), k, pct, wetter_frac, std, n, events
    event_labels: DataFrame  # phase, labels
    regions: DataFrame  # region_id, name, priority, ord, sources
    region_boxes: DataFrame  # region_id, lat0, lat1, lon0, lon1
    region_phases: DataFrame  # region_id, phase, rain, temp, season, confidence, note, hazards
    status: DataFrame  # one row: phase, level, status, expected_strength, headline_probability_pct, issued, synopsis, source, source_url
    steps: DataFrame  # hazard, ord, id, icon, text, why, minutes, for
    services: DataFrame  # cc, name, url
    now: str  # ISO date
    service_fallback: tuple[str, str] = ("World directory of weather services", "https://wmo.int/about-wmo/members")
    country_seasons: DataFrame | None = None  # cc, region_id, local_season
    country_hazards: DataFrame | None = None  # cc, phase, hazards_add
    forecast: DataFrame | None = None  # place_id, ym, anomaly, mean
    forecast_probability: Column | None = None
    skill: DataFrame | None = None  # cell_id, correlation, roc
    rules: DataFrame | None = None
    recent_rain: DataFrame | None = None  # cell_id, recent_rain_pct
    drought: DataFrame | None = None  # cell_id, usdm
    crops: DataFrame | None = None  # iso2, crops
    cyclones: DataFrame | None = None  # cell_id, en_rate, neutral_rate
    cyclone_years: tuple[int, int] | None = None  # strong warm years, neutral years
    cyclone_period: str = "1980-2025"
    source_names: DataFrame | None = None  # id, label, url of the regions' own sources
    profiles: Profiles | None = None  # made by with_profiles; stand in for the layers keyed by cell, country and region
    provenance: dict[str, Provenance] = field(default_factory=dict)  # history source name or layer name


SKILL = {"correlation": "double", "roc": "double"}
RAIN = {"recent_rain_pct": "double"}
DROUGHT = {"usdm": "int"}
STORMS = {"en_rate": "double", "neutral_rate": "double"}
CROPS = {"crops": "array<struct<rank:int,fewer:bigint,name:string,crop:string,sowing:array<int>,harvest:array<int>,all_year:boolean>>"}
HISTORY = ("_src", "_pct", "_wet", "_std", "_n", "_events")


def _one_row(key: str, layers: dict[str, tuple[DataFrame | None, dict[str, str]]]) -> DataFrame:
    """Layers with one row per key side by side, in one exchange; absent layers and missing rows give nulls."""
    present = {name: df.select(key, F.struct(*columns).alias(name)) for name, (df, columns) in layers.items() if df is not None}
    rows = None
    for df in present.values():
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    merged = rows.groupBy(key).agg(*[F.any_value(name, True).alias(name) for name in present])
    columns = [(F.col(f"{name}.{c}") if name in present else F.lit(None)).cast(kind).alias(c) for name, (_, kinds) in layers.items() for c, kind in kinds.items()]
    return merged.select(key, *columns)


def build_profiles(x: FactInputs) -> Profiles:
    """The layers of the facts job gathered per cell, country, and region and phase.

    Every layer has one row per key, as for the joins they replace; a cell has one history entry per phase and season.
    """
    item = _history_rows(x)
    entry = item.groupBy("cell_id").agg(F.collect_list(F.struct("_phase", "k", *HISTORY)).alias("_history"))
    cells = _one_row("cell_id", {
        "_h": (entry, {"_history": entry.schema["_history"].dataType}), "_skill": (x.skill, SKILL), "_rain": (x.recent_rain, RAIN),
        "_drought": (x.drought, DROUGHT), "_storms": (x.cyclones, STORMS),
    })
    seasons = None if x.country_seasons is None else _by_country(x.country_seasons, "region_id", "local_season", "_seasons")
    hazards = None if x.country_hazards is None else _by_country(x.country_hazards, "phase", "hazards_add", "_added")
    crops = None if x.crops is None else x.crops.select(F.col("iso2").alias("cc"), "crops")
    region = x.region_phases.schema["region_id"].dataType.simpleString()
    countries = _one_row("cc", {
        "_service": (_services(x), {"_service": "string", "_service_url": "string"}), "_crops": (crops, CROPS),
        "_seasons": (seasons, {"_seasons": f"map<{region},string>"}), "_added": (hazards, {"_added": "map<string,array<string>>"}),
    })
    return Profiles(cells, countries, _signals(x).join(_region_sources(x), "region_id", "left"))


def with_profiles(x: FactInputs, store: Callable[[DataFrame, str], DataFrame]) -> FactInputs:
    """Inputs whose layers are profile tables, written and read by ``store(table, name)``.

    Written once, the profiles serve every later run of the facts job: a run plans a few joins to stored tables and not the jobs
    that made the layers.
    """
    made = build_profiles(x)
    return replace(x, profiles=Profiles(store(made.cells, "cells"), store(made.countries, "countries"), store(made.regions, "regions")))


def _by_country(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A short map per country (regions of a country, or phases)."""
    return rows.groupBy("cc").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def _services(x: FactInputs) -> DataFrame:
    return x.services.select("cc", F.col("name").alias("_service"), F.col("url").alias("_service_url"))


def _signals(x: FactInputs) -> DataFrame:
    return x.region_phases.withColumn("has_signal", F.lit(True))


def _region_sources(x: FactInputs) -> DataFrame:
    return x.regions.select("region_id", F.col("sources").alias("region_sources")).join(_own_sources(x), "region_id", "left")


def _history_rows(x: FactInputs) -> DataFrame:
    return x.composites.select(
        "cell_id", F.col("phase").alias("_phase"), "k", F.col("source").alias("_src"), F.col("pct").alias("_pct"),
        F.col("wetter_frac").alias("_wet"), F.col("std").alias("_std"), F.col("n").cast("int").alias("_n"), F.col("events").alias("_events"),
    )


def _optional(df: DataFrame, layer: DataFrame | None, on, **nulls: str) -> DataFrame:
    """Left join a layer, or add its columns as nulls when the layer is absent.

    These layers have one row per grid cell (16 200) or per country (and phase or region).
    """
    if layer is None:
        return df.withColumns({name: F.lit(None).cast(kind) for name, kind in nulls.items()})
    return dim_join(df, layer, on, "left", bounded=True)


def build_facts(x: FactInputs) -> DataFrame:
    now = F.to_date(F.lit(x.now))
    # place, cell, status, regions
    # a place is a short row with much work behind it: few row groups of a file must not mean few tasks
    dealt = x.places.repartition(2 * x.places.sparkSession.sparkContext.defaultParallelism, "place_id")
    df = spatial.snap_to_land(dealt, x.land).withColumnsRenamed({"on_land": "_on_land"}).drop("own_is_land")
    df = spatial.with_regions(df, x.region_boxes, x.regions)
    # the newest status; an aggregate without groups is one row
    newest = x.status.agg(F.max(F.struct(F.col("issued").alias("at"), F.struct(*x.status.columns).alias("row"))).alias("s"))
    df = df.join(F.broadcast(newest.select(F.col("s.row").alias("status"))), how="cross")
    df = df.withColumns(
        {
            "region_id": F.get("regions", F.lit(0))["region_id"],
            "region_name": F.get("regions", F.lit(0))["name"],
            "other_regions": F.transform(F.slice("regions", 2, 2), lambda r: r["name"]),
            "phase": F.col("status.phase"),
        }
    )
    # signal of the active phase
    p = x.profiles
    if p:
        df = dim_join(df, p.regions, ["region_id", "phase"], "left")
        df = dim_join(df.join(p.cells, "cell_id", "left"), p.countries, "cc", "left", bounded=True)
    else:
        df = dim_join(df, _signals(x), ["region_id", "phase"], "left")
        df = dim_join(df, _region_sources(x), "region_id", "left")
    df = df.withColumn("has_signal", F.coalesce("has_signal", F.lit(False)))
    months = F.when(F.col("has_signal"), cal.parse_season(F.col("season"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({"months": months, "sign": F.when(F.col("has_signal"), rules.rain_sign(F.col("rain"))).otherwise(0)})
    df = df.withColumns({"timing": cal.season_timing(F.col("months"), now), "k": cal.season_index(F.col("months")).cast("int")})
    # history of the cell in that phase and season
    short = F.when(F.col("phase") == "el_nino", "en").when(F.col("phase") == "la_nina", "ln")
    df = df.withColumn("_phase", short)
    if p:
        entry = F.get(F.filter("_history", lambda h: (h["_phase"] == F.col("_phase")) & (h["k"] == F.col("k"))), F.lit(0))
        df = df.withColumn("_entry", entry).withColumns({c: F.col(f"_entry.{c}") for c in HISTORY})
    else:
        # the composites may be a whole job of their own, so their size is left to the adaptive planner,
        # which broadcasts them or splits the tasks of a cell with very many places
        df = df.join(_history_rows(x), ["cell_id", "_phase", "k"], "left")
    df = df.join(F.broadcast(x.event_labels.select(F.col("phase").alias("_phase"), F.col("labels").alias("_labels"))), "_phase", "left")
    season = F.get(cal.season_names(), F.col("k"))
    df = df.withColumn(
        "history", rules.history(F.col("_n"), F.col("_pct"), F.col("_wet"), F.col("_std"), F.col("_events"), F.col("_labels"), season, F.col("_src"))
    )
    df = df.withColumn("agreement", rules.agreement(F.col("history.composite_pct"), F.col("sign"), F.col("history.std")))
    # forecast of the season months
    wanted = cal.season_year_months(F.col("months"), F.col("timing.start_year"))
    if x.forecast is None:
        nothing = F.lit(None).cast("array<struct<ym:string,anomaly:double,mean:double>>")
        df = df.withColumn("_fm", nothing)
    else:
        df = df.join(cube.forecast_months(x.forecast, ["place_id"]).withColumnRenamed("months", "_fm"), "place_id", "left")
    of_season = F.filter("_fm", lambda m: F.array_contains(F.col("season_months"), m["ym"]))
    df = df.withColumn("season_months", wanted)
    df = df.withColumn("_forecast", cube.season_forecast(of_season, F.size("season_months")))
    df = df.withColumns(
        {
            "forecast_agreement": rules.agreement(F.col("_forecast.pct"), F.col("sign")),
            "_prob": F.lit(None).cast("int") if x.forecast_probability is None else x.forecast_probability.cast("int"),
        }
    )
    # confidence
    if not p:
        df = _optional(df, x.skill, "cell_id", **SKILL)
    has_forecast = F.col("_forecast").isNotNull()
    df = df.withColumns(
        {
            "skill": F.when(has_forecast, rules.skill_class(F.col("correlation"), F.col("roc"))),
            "band": F.when(has_forecast, rules.probability_band(F.coalesce("_prob", rules.fallback_probability(F.col("_forecast.pct"))))),
            "_base": F.when(F.col("has_signal"), rules.base_confidence(F.col("confidence"), F.col("agreement"))).otherwise("uncertain"),
        }
    )
    if x.rules is None:
        empty = {c: F.lit(None).cast("string") for c in ("rule_confidence", "template", "lean_on")}
        merged = rules.merged_confidence_plain(F.col("_base"), F.col("agreement"), F.col("forecast_agreement"))
        df = df.withColumns({**empty, "skill": F.lit(None).cast("string"), "band": F.lit(None).cast("string")})
    else:
        df = rules.with_rule(df, x.rules)
        merged = rules.merged_confidence(
            F.col("_base"), F.col("agreement"), F.col("forecast_agreement"), F.col("skill"), F.col("rule_confidence"), F.col("lean_on")
        )
    clash = F.when((F.col("forecast_agreement") == "disagree") & F.col("rule_confidence").isNotNull(), rules.disagreement(F.col("skill")))
    df = df.withColumns({"final_confidence": merged, "disagreement": clash})
    # current conditions, hazards, steps, service, farming, storms
    if not p:
        df = _optional(df, x.recent_rain, "cell_id", **RAIN)
        df = _optional(df, x.drought, "cell_id", **DROUGHT)
    df = df.withColumn("conditions", rules.conditions(F.col("recent_rain_pct"), F.col("usdm")))
    # outside a warm phase the additions of the cold phase apply
    df = df.withColumn("_add_phase", F.when(F.col("phase") == "el_nino", "el_nino").otherwise("la_nina"))
    if p:
        df = df.withColumns({"hazards_add": F.try_element_at("_added", F.col("_add_phase")), "local_season": F.try_element_at("_seasons", F.col("region_id"))})
    else:
        df = _country_layers(df, x)
    df = df.withColumn("hazards", F.when(F.col("has_signal"), rules.hazard_list(F.col("hazards"), F.col("hazards_add"))).otherwise(
        rules.hazard_list(F.lit(None).cast("array<string>"), F.col("hazards_add"))))
    df = rules.with_steps(df, x.steps)
    grows = ((F.col("livelihood") == "farmer") | crop_ops.is_rural(F.col("pop"))) & F.col("has_signal")
    df = df.withColumn("farmer", F.when(grows, crop_ops.farming_context(F.col("crops"), F.col("months"), F.col("sign"))))
    if not p:
        df = _optional(df, x.cyclones, "cell_id", **STORMS)
    years = x.cyclone_years or (None, None)
    storms = F.struct(
        F.col("en_rate"), F.col("neutral_rate"), F.lit(years[0]).cast("int").alias("en_years"), F.lit(years[1]).cast("int").alias("neutral_years"),
        grid.in_western_north_pacific(F.col("lat"), F.col("lon")).alias("wnp"), F.lit(x.cyclone_period).alias("period"),
    )
    df = df.withColumn("cyclones", F.when(F.col("neutral_rate").isNotNull(), storms))
    return _row(df, x)


def _country_layers(df: DataFrame, x: FactInputs) -> DataFrame:
    added = None if x.country_hazards is None else x.country_hazards.withColumnRenamed("phase", "_add_phase")
    df = _optional(df, added, ["cc", "_add_phase"], hazards_add="array<string>")
    df = dim_join(df, _services(x), "cc", "left", bounded=True)
    df = _optional(df, x.country_seasons, ["cc", "region_id"], local_season="string")
    return _optional(df, None if x.crops is None else x.crops.select(F.col("iso2").alias("cc"), "crops"), "cc", **CROPS)


def _row(df: DataFrame, x: FactInputs) -> DataFrame:
    has = F.col("has_signal")
    forecast = F.when(
        F.col("_forecast").isNotNull(),
        F.struct(
            "_forecast.*", F.col("season_months"), F.col("_prob").alias("probability_pct"), F.col("disagreement"),
            *_meta(x, "forecast", ("source", "name"), ("source_url", "url"), ("issued", "version")),
        ),
    )
    signal = F.when(
        has,
        F.struct("rain", "temp", "season", "local_season", "months", "timing", "hazards", "note", F.col("region_sources").alias("sources")),
    )
    too_few = F.coalesce(F.col("history.too_few"), F.lit(True))
    # the counts are worded only where the wording rules are in use
    consistency = F.when(
        F.lit(x.rules is not None) & ~too_few,
        rules.consistency(F.col("history.composite_pct"), F.col("history.wetter_frac"), F.col("history.n_events")),
    )
    out = df.select(
        "place_id",
        F.lit(x.now).alias("generated_at"),
        F.struct("lat", "lon", "cc", "cell_id", F.col("_on_land").alias("on_land")).alias("place"),
        "status",
        F.when(F.col("region_id").isNotNull(), F.struct(F.col("region_id").alias("id"), F.col("region_name").alias("name"), "confidence")).alias("region"),
        signal.alias("signal"),
        "agreement",
        F.col("final_confidence").alias("confidence"),
        "history",
        consistency.alias("consistency"),
        forecast.alias("forecast"),
        F.when(F.col("rule_confidence").isNotNull(), F.struct("skill", "band", F.col("rule_confidence").alias("confidence"), "template", "lean_on")).alias("forecast_rule"),
        F.col("skill").alias("skill_class"),
        "conditions",
        "forecast_agreement",
        "farmer",
        "cyclones",
        "steps",
        F.struct(
            F.coalesce("_service", F.lit(x.service_fallback[0])).alias("name"), F.coalesce("_service_url", F.lit(x.service_fallback[1])).alias("url")
        ).alias("met_service"),
        "other_regions", "_own_sources",
    )
    return out.withColumns({"sources": source_list(x), "provenance": provenance_chips(x)}).drop("_own_sources")


def _own_sources(x: FactInputs) -> DataFrame:
    """``region_id, _own_sources``: id, label and URL of a region's own sources, in order; a source without a name is its id."""
    listed = x.regions.select("region_id", F.posexplode("sources").alias("pos", "id"))
    if x.source_names is None:
        listed = listed.withColumns({"label": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    else:
        listed = listed.join(x.source_names.select("id", "label", "url"), "id", "left")
    one = F.struct("pos", F.struct("id", F.coalesce("label", "id").alias("label"), "url").alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda e: e["s"])
    return listed.groupBy("region_id").agg(ordered.alias("_own_sources"))


def _meta(x: FactInputs, layer: str, *fields: tuple[str, str]) -> list[Column]:
    p = x.provenance.get(layer)
    return [F.lit(getattr(p, attr) if p else None).cast("string").alias(name) for name, attr in fields]


def source_list(x: FactInputs) -> Column:
    """Sources in fixed order: history, events, status, the region's own, forecast, conditions."""

    def source(key, label, url, when=None) -> Column:
        made = F.struct(_s(key).alias("id"), _s(label).alias("label"), _s(url).alias("url"))
        return made if when is None else F.when(when, made)

    p = x.provenance
    history = [
        source(name, p[name].name, p[name].url, F.col("history.src") == name) for name in _history_names(x)
    ]
    fixed = [source("oni", p["oni"].name, p["oni"].url)] if "oni" in p else []
    status = source("cpc", F.col("status.source"), F.col("status.source_url"))
    forecast = [source("forecast", p["forecast"].name, p["forecast"].url, F.col("forecast").isNotNull())] if "forecast" in p else []
    none = F.array().cast("array<struct<id:string,label:string,url:string>>")
    own = F.coalesce(F.when(F.col("signal").isNotNull(), F.col("_own_sources")), none)
    shown = [
        source("conditions", p[layer].name, p[layer].url, F.col(f"conditions.{value}").isNotNull())
        for layer, value in (("recent_rain", "recent_rain_pct"), ("drought", "usdm")) if layer in p
    ]
    tail = [*forecast, *shown]
    parts = [rules.present(*history, *fixed, status), own]
    if tail:
        parts.append(rules.present(*tail))
    return F.concat(*parts)


def _history_names(x: FactInputs) -> list[str]:
    layers = {"oni", "forecast", "recent_rain", "drought", "crops", "cyclones"}
    return [name for name in x.provenance if name not in layers]


def provenance_chips(x: FactInputs) -> Column:
    """Provenance per layer in fixed order: forecast, status, history, events, conditions, crops, storms."""

    def chip(layer: str, name, as_of, url, retrieved=None, when=None, skill=None) -> Column:
        made = F.struct(
            _s(layer).alias("layer"), _s(name).alias("source"), _s(as_of).alias("as_of"), _s(retrieved).alias("retrieved"), _s(url).alias("url"),
            _s(skill).alias("skill"),
        )
        return made if when is None else F.when(when, made)

    p, items = x.provenance, []
    if "forecast" in p:
        f = p["forecast"]
        items.append(chip("forecast", f.name, f.version, f.url, when=F.col("forecast").isNotNull(), skill=F.col("skill_class")))
    items.append(chip("status", F.col("status.source"), F.col("status.issued"), F.col("status.source_url")))
    for name in _history_names(x):
        h = p[name]
        items.append(chip("history", h.name, h.version, h.url, h.retrieved_at, F.col("history.src") == name))
    if "oni" in p:
        items.append(chip("events", p["oni"].name, p["oni"].version, p["oni"].url))
    for layer, value in (("recent_rain", "recent_rain_pct"), ("drought", "usdm")):
        if layer in p:
            c = p[layer]
            items.append(chip("conditions", c.name, c.version, c.url, c.retrieved_at, F.col(f"conditions.{value}").isNotNull()))
    if "crops" in p:
        items.append(chip("crops", p["crops"].name, p["crops"].version, p["crops"].url, when=F.col("farmer").isNotNull()))
    if "cyclones" in p:
        items.append(chip("cyclones", p["cyclones"].name, p["cyclones"].version, p["cyclones"].url, when=F.col("cyclones").isNotNull()))
    return rules.present(*items)


def _s(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")
