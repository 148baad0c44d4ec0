"""Briefing text from facts rows: an ordered array of blocks per place and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.functions.text import fill, list_text, percent_phrase
from solstice.plans.wording import ENGLISH

BLOCK = "struct<type:string,key:string,text:string,detail:string,source:string>"


def english_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", ENGLISH)], "lang STRING, strings MAP<STRING, STRING>")


def language_maps(catalog: DataFrame, source_lang: str = "en") -> DataFrame:
    """``lang, strings``: one map per language, the source text filling untranslated keys.

    ``catalog`` has ``lang, key, value``; a language has some hundreds of keys.
    """
    maps = catalog.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("own"))
    source = maps.where(F.col("lang") == source_lang).select(F.col("own").alias("src"))
    merged = F.map_zip_with("own", "src", lambda k, own, src: F.coalesce(own, src))
    return maps.join(F.broadcast(source), how="cross").select("lang", merged.alias("strings"))


#: Keys that the code names. They, the months and the families of keys are looked up once per language: a look-up in a map
#: passes over its keys, and a place asks for some hundreds of strings.
FIXED = (
    "agreement_none", "all_year", "conditions_rain", "conditions_usdm", "cyclone_history", "cyclone_wnp", "defer", "dir_drier", "dir_heavier", "dir_lighter",
    "dir_wetter", "el_nino", "expect", "farmer_harvest", "farmer_planting", "forecast_monthly", "forecast_partial", "forecast_says", "headline",
    "headline_neutral", "headline_noregion", "history", "history_all", "history_count", "history_few", "history_mixed", "history_recent", "la_nina",
    "list_last", "list_sep", "near_normal", "neutral", "neutral_explain", "no_data", "noregion_explain", "pct_less_rain", "pct_more_rain", "pct_more_rain_cap",
    "prov_chip", "risks", "season_with_local", "status_line", "steps_title", "this_area", "ui.sources",
)
#: Beginnings of the keys whose rest comes from the facts.
FAMILIES = (
    "agreement_", "conf_", "crops.", "disagreement_", "forecast_", "hazard_icons.", "hazards.", "layers.", "local_seasons.", "rain_", "regions.", "steps.", "temp_",
    "timing_", "usdm_levels.",
)


def _looked_up(languages: DataFrame) -> DataFrame:
    """``lang, strings``, the strings of the fixed keys, the names of the months, and a map per family of keys."""
    strings = F.col("strings")
    fixed = F.struct(*[F.element_at(strings, F.lit(key)).alias(_field(key)) for key in FIXED])
    months = F.array(*[F.element_at(strings, F.lit(f"months.{m}")) for m in range(1, 13)])

    def of(family: str) -> Column:
        return F.map_filter(strings, lambda key, _: key.startswith(family))

    return languages.select("lang", "strings", fixed.alias("_fixed"), months.alias("_months"), F.struct(*[of(f).alias(_field(f)) for f in FAMILIES]).alias("_of"))


def _field(key: str) -> str:
    return key.replace(".", "_")


def _t(key: str) -> Column:
    return F.col(f"_fixed.{_field(key)}")


def _in(family: str, rest: Column) -> Column:
    """The string whose key is ``family`` and ``rest``."""
    return F.element_at(F.col(f"_of.{_field(family)}"), F.concat(F.lit(family), rest))


def _code(word: Column) -> Column:
    return F.regexp_replace(word, "[^a-z]", "_")


def _block(kind: str, key: str, text: Column, when: Column | None = None, detail: Column | None = None, source: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    made = F.struct(
        F.lit(kind).alias("type"), F.lit(key).alias("key"), text.alias("text"), (none if detail is None else detail).alias("detail"),
        (none if source is None else source).alias("source"),
    )
    return made if when is None else F.when(when, made)


def render(facts: DataFrame, languages: DataFrame) -> DataFrame:
    """``place_id, lang, blocks``. ``facts`` may carry ``name``; ``languages`` has one row per language."""
    # every place in every language is what is asked for
    df = facts.crossJoin(F.broadcast(_looked_up(languages)))
    if "name" not in facts.columns:
        df = df.withColumn("name", F.lit(None).cast("string"))
    months = F.col("_months")
    phase = F.col("status.phase")

    def pct(x: Column) -> Column:
        return percent_phrase(x, _t("no_data"), _t("near_normal"), _t("pct_more_rain"), _t("pct_less_rain"))

    def label(run: Column, start=None, end=None) -> Column:
        none = F.lit(None).cast("int")
        return cal.season_label(run, none if start is None else start, none if end is None else end, _t("all_year"), months)

    df = df.withColumns(
        {
            "_name": F.coalesce("name", _t("this_area")),
            "_phase": F.when(phase == "el_nino", _t("el_nino")).when(phase == "la_nina", _t("la_nina")).otherwise(_t("neutral")),
            "_plain": label(F.col("signal.months"), F.col("signal.timing.start_year"), F.col("signal.timing.end_year")),
            "_season": label(F.col("signal.months")),
            "_full": F.col("signal").isNotNull() & (phase != "neutral"),
            "_rain": F.coalesce(_in("rain_", _code(F.col("signal.rain"))), F.col("signal.rain")),
            "_temp": F.coalesce(_in("temp_", _code(F.col("signal.temp"))), F.col("signal.temp")),
            "_conf": _in("conf_", F.col("confidence")),
        }
    )
    full = F.col("_full")
    noregion = F.col("signal").isNull() & (phase != "neutral")
    local = F.col("signal.local_season")
    local_text = F.coalesce(_in("local_seasons.", local), local)
    season = F.when(local.isNotNull(), fill(_t("season_with_local"), {"season": F.col("_plain"), "local": local_text})).otherwise(F.col("_plain"))
    headline = (
        F.when(noregion, fill(_t("headline_noregion"), {"name": F.col("_name")}))
        .when(~full, fill(_t("headline_neutral"), {"name": F.col("_name")}))
        .otherwise(fill(_t("headline"), {"name": F.col("_name"), "rain": F.col("_rain"), "season": season, "conf": F.col("_conf")}))
    )
    risks = F.transform(
        F.slice("signal.hazards", 1, 4),
        lambda h: F.concat(
            F.coalesce(F.concat(_in("hazard_icons.", h), F.lit(" ")), F.lit("")),
            F.coalesce(_in("hazards.", h), h),
        ),
    )
    crop_names = F.transform("farmer.crops", lambda c: F.coalesce(_in("crops.", c), c))
    # columns of their own, as a list text uses its items several times
    df = df.withColumns({"_risks": risks, "_crops": crop_names})
    state = F.col("signal.timing.state")
    away = F.col("signal.timing.months_away")
    timing_key = F.when((state == "coming") & (away <= 1), "coming_one").otherwise(state)
    # forecast
    shown = F.when(F.col("forecast.capped"), fill(_t("pct_more_rain_cap"), {"n": "300"})).otherwise(pct(F.col("forecast.pct")))
    reading = F.when(F.col("forecast.disagreement").isNotNull(), _in("disagreement_", F.col("forecast.disagreement"))).otherwise(
        _in("forecast_", F.col("forecast_agreement"))
    )
    forecast = F.concat_ws(" ", fill(_t("forecast_says"), {"season": F.col("_season"), "pct": shown}), reading, F.element_at("strings", F.col("forecast_rule.template")))
    by_month = F.transform(
        "forecast.monthly",
        lambda m: F.concat_ws(
            " ", F.get(months, F.substring(m["ym"], 6, 2).cast("int") - 1),
            F.when(m["pct"].isNull(), _t("no_data")).otherwise(F.concat(F.when(m["pct"] > 0, "+").otherwise(""), m["pct"].cast("string"), F.lit("%"))),
        ),
    )
    partial = F.when(F.col("forecast.n_months") < F.col("forecast.of_months"), fill(_t("forecast_partial"), {"n": F.col("forecast.n_months"), "of": F.col("forecast.of_months")}))
    # farming, storms, conditions
    farming = fill(
        F.when(F.col("farmer.stage") == "planting", _t("farmer_planting")).otherwise(_t("farmer_harvest")),
        {
            "dir": F.when(F.col("farmer.direction") == "wetter", _t("dir_wetter")).otherwise(_t("dir_drier")), "season": F.col("_season"),
            "crop": list_text(F.col("_crops"), _t("list_sep"), _t("list_last")), "window": label(F.col("farmer.window")),
        },
    )
    storms = F.concat_ws(
        " ",
        fill(
            _t("cyclone_history"),
            {"n_en": F.format_string("%.1f", "cyclones.en_rate"), "n_neutral": F.format_string("%.1f", "cyclones.neutral_rate"), "years": F.col("cyclones.period")},
        ),
        F.when(F.col("cyclones.wnp"), _t("cyclone_wnp")),
    )
    level = _in("usdm_levels.", F.col("conditions.usdm").cast("string"))
    conditions = F.concat_ws(
        " ",
        F.when(F.col("conditions.recent_rain_pct").isNotNull(), fill(_t("conditions_rain"), {"pct": pct(F.col("conditions.recent_rain_pct") - 100)})),
        F.when(F.col("conditions.usdm").isNotNull(), fill(_t("conditions_usdm"), {"level": level})),
    )
    # expectation, confidence, history
    region = F.coalesce(_in("regions.", F.concat_ws(".", F.col("region.id").cast("string"), F.lit("name"))), F.col("region.name"))
    note = F.coalesce(_in("regions.", F.concat_ws(".", F.col("region.id").cast("string"), F.concat(phase, F.lit("_note")))), F.col("signal.note"))
    why = fill(F.coalesce(_in("agreement_", F.col("agreement")), _t("agreement_none")), {"conf": F.col("_conf")})
    c = F.col("consistency")
    lead = F.when(
        c.isNotNull(),
        fill(
            F.when(c["cls"] == "mixed", _t("history_mixed")).otherwise(_t("history_count")),
            {"k": c["k"], "n": c["n"], "phase": F.col("_phase"), "season": F.col("_season"),
             "dir": F.when(c["direction"] == "wetter", _t("dir_heavier")).otherwise(_t("dir_lighter"))},
        ),
    )
    average = fill(
        _t("history"),
        {"season": F.col("_season"), "n": F.col("history.n_events"), "phase": F.col("_phase"), "pct": pct(F.col("history.composite_pct")),
         "wet": F.floor(F.col("history.wetter_frac") + 0.5)},
    )
    recent = F.array_join(F.transform("history.recent", lambda r: F.concat(r["label"], F.lit(": "), pct(r["pct"]))), "; ")
    every = F.array_join(
        F.transform("history.all", lambda r: F.concat(r["label"], F.lit(" "), F.when(r["pct"] > 0, "+").otherwise(""), r["pct"].cast("int").cast("string"), F.lit("%"))), ", "
    )
    listed = F.when(F.size("history.all") > 3, fill(_t("history_all"), {"phase": F.col("_phase"), "list": every}))
    past = full & F.col("history").isNotNull()
    steps = F.array_join(F.transform("steps", lambda s: _step_text(s)), " ")
    provenance = F.array_join(
        F.transform(
            "provenance",
            lambda p: fill(
                _t("prov_chip"),
                {"layer": F.coalesce(_in("layers.", p["layer"]), p["layer"]), "source": p["source"], "as_of": p["as_of"]},
            ),
        ),
        " · ",
    )
    blocks = [
        _block("headline", "headline", headline),
        _block("para", "neutral", F.when(noregion, _t("noregion_explain")).otherwise(_t("neutral_explain")), ~full),
        _block("para", "risks", fill(_t("risks"), {"list": list_text(F.col("_risks"), _t("list_sep"), _t("list_last"))}), full & (F.size("signal.hazards") > 0)),
        _block("para", "timing", fill(_in("timing_", timing_key), {"season": F.col("_plain"), "n": away}), full & state.isin("now", "coming", "passed")),
        _block("para", "forecast_monthly", fill(_t("forecast_monthly"), {"list": F.array_join(by_month, ", ")}), full & (F.size("forecast.monthly") > 1)),
        _block("forecast", "forecast", forecast, full & F.col("forecast").isNotNull(), partial, F.lit("forecast")),
        _block("para", "farmer", farming, full & F.col("farmer").isNotNull()),
        _block("para", "cyclones", storms, full & F.col("cyclones").isNotNull()),
        _block("para", "conditions", conditions, full & F.col("conditions").isNotNull(), None, F.lit("conditions")),
        _block("para", "expect", fill(_t("expect"), {"phase": F.col("_phase"), "region": region, "rain": F.col("_rain"), "temp": F.col("_temp")}), full),
        _block("para", "note", note, full, None, F.get("signal.sources", F.lit(0))),
        _block("para", "confidence", why, full),
        _block("history", "history", F.concat_ws(" ", lead, average), past & ~F.col("history.too_few"), F.concat_ws(" ", fill(_t("history_recent"), {"recent": recent}), listed), F.col("history.src")),
        _block("para", "history", _t("history_few"), past & F.col("history.too_few")),
        _block("status", "status", fill(_t("status_line"), {"status": F.col("status.status"), "issued": F.col("status.issued")}), None, F.col("status.synopsis"), F.col("status.source")),
        _block("steps", "steps", _t("steps_title"), None, steps),
        _block("defer", "defer", fill(_t("defer"), {"service": F.col("met_service.name")}), None, None, F.col("met_service.url")),
        _block("sources", "sources", _t("ui.sources"), None, F.array_join(F.transform("sources", lambda s: s["id"]), ", ")),
        _block("provenance", "provenance", provenance, F.size("provenance") > 0),
    ]
    out = df.withColumn("blocks", F.filter(F.array(*blocks), lambda b: b.isNotNull()))
    return out.select("place_id", "lang", "blocks", F.transform("steps", lambda s: _step_text(s)).alias("step_texts"))


def _step_text(step: Column) -> Column:
    return F.coalesce(_in("steps.", F.concat(step["id"], F.lit(".text"))), step["text"])


def block_text(key: str, blocks: Column | str = "blocks") -> Column:
    return F.get(F.filter(blocks, lambda b: b["key"] == key), F.lit(0))["text"]


def radio_script(headline: Column, risks: Column, timing: Column, steps: Column, defer: Column) -> Column:
    """Headline, risks, timing, the first two steps and the referral in one line; empty parts skipped."""
    parts = F.array(headline, risks, timing, F.array_join(F.slice(steps, 1, 2), " "), defer)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def short_message(headline: Column, steps: Column, limit: int = 160) -> Column:
    """Headline and first step, cut with three points when longer than ``limit``."""
    text = F.trim(F.concat_ws(" ", headline, F.coalesce(F.get(steps, F.lit(0)), F.lit(""))))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def scripts(rendered: DataFrame) -> DataFrame:
    """``place_id, lang, radio, sms`` of rendered briefings."""
    parts = [block_text(k) for k in ("headline", "risks", "timing")]
    return rendered.select(
        "place_id", "lang", radio_script(*parts, F.col("step_texts"), block_text("defer")).alias("radio"),
        short_message(block_text("headline"), F.col("step_texts")).alias("sms"),
    )
