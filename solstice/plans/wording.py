"""English source texts of the briefing; other languages come from the catalog."""

from __future__ import annotations

from solstice.functions.calendar import MONTHS

ENGLISH: dict[str, str] = {
    "agreement_agree": "Past events here point the same way, so this is {conf}.",
    "agreement_disagree": "Past events here point the other way, so this is {conf}.",
    "agreement_none": "There is no local record to compare with, so this is {conf}.",
    "agreement_weak": "Past events here show no clear sign, so this is {conf}.",
    "all_year": "all year",
    "conditions_rain": "The last three months had {pct}.",
    "conditions_usdm": "The drought map shows {level} here.",
    "conf_leaning": "leaning that way",
    "conf_likely": "likely",
    "conf_uncertain": "uncertain",
    "cyclone_history": "In strong El Niño years {n_en} tropical storms a year passed near here, and {n_neutral} in neutral years ({years}).",
    "cyclone_wnp": "Storms tend to form farther east in such years.",
    "defer": "For warnings, follow {service}.",
    "dir_drier": "drier",
    "dir_heavier": "heavier rain",
    "dir_lighter": "lighter rain",
    "dir_wetter": "wetter",
    "disagreement_say_both": "Forecast and past events differ here.",
    "disagreement_trust_forecast": "Forecast and past events differ; trust the forecast this time.",
    "disagreement_trust_history": "Forecast and past events differ; trust the pattern of past events.",
    "el_nino": "El Niño",
    "expect": "During {phase}, {region} tends to have {rain} and {temp}.",
    "farmer_harvest": "The {dir} season {season} overlaps the main {crop} harvest here ({window}).",
    "farmer_planting": "The {dir} season {season} overlaps the main {crop} planting time here ({window}).",
    "forecast_agree": "This fits the usual pattern.",
    "forecast_confident": "Forecasts here have been reliable.",
    "forecast_disagree": "This differs from the usual pattern.",
    "forecast_monthly": "By month: {list}.",
    "forecast_none": "There is no usual pattern to compare with.",
    "forecast_partial": "The forecast covers {n} of {of} months.",
    "forecast_says": "The forecast for {season} shows {pct}.",
    "forecast_skill_partial": "Forecasts here have been partly reliable.",
    "forecast_unchecked": "Forecast reliability here has not been checked.",
    "forecast_unreliable": "Forecasts here have not been reliable.",
    "forecast_weak": "The signal is weak.",
    "headline": "{name}: {rain} is {conf} in {season}.",
    "headline_neutral": "{name}: no strong seasonal signal now.",
    "headline_noregion": "{name}: no clear link with the current event.",
    "history": "In {season}, {n} strong {phase} events brought {pct} on average; {wet}% were wetter.",
    "history_all": "All strong {phase} events: {list}.",
    "history_count": "In {k} of the last {n} strong {phase} events, {season} had {dir}.",
    "history_few": "Too few events were recorded here for an average.",
    "history_mixed": "The last {n} strong {phase} events went both ways in {season}.",
    "history_recent": "Most recent: {recent}.",
    "la_nina": "La Niña",
    "list_last": " and ",
    "list_sep": ", ",
    "near_normal": "near-normal rain",
    "neutral": "neutral conditions",
    "neutral_explain": "Neither phase is active; seasons follow their usual course.",
    "no_data": "no data",
    "noregion_explain": "Research shows no steady effect on rain here.",
    "pct_less_rain": "{n}% less rain than usual",
    "pct_more_rain": "{n}% more rain than usual",
    "pct_more_rain_cap": "over {n}% more rain than usual",
    "prov_chip": "{layer}: {source}, {as_of}",
    "rain_drier": "less rain than usual",
    "rain_much_drier": "much less rain than usual",
    "rain_much_wetter": "much more rain than usual",
    "rain_near_normal": "near-normal rain",
    "rain_wetter": "more rain than usual",
    "risks": "Prepare for: {list}.",
    "season_with_local": "{season} ({local})",
    "status_line": "Status: {status} ({issued}).",
    "steps_title": "What you can do",
    "temp_cooler": "cooler days",
    "temp_warmer": "warmer days",
    "this_area": "This area",
    "timing_coming": "{season} starts in {n} months.",
    "timing_coming_one": "{season} starts next month.",
    "timing_now": "{season} is under way.",
    "timing_passed": "{season} is over for this event.",
    "ui.sources": "Sources",
    "usdm_levels.0": "unusual dryness",
    "usdm_levels.1": "moderate drought",
    "usdm_levels.2": "severe drought",
    "usdm_levels.3": "extreme drought",
    "usdm_levels.4": "exceptional drought",
    **{f"months.{i}": name for i, name in enumerate(MONTHS, 1)},
}
