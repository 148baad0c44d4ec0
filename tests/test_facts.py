import pytest
from pyspark.sql import functions as F

from solstice.operators import rules
from solstice.plans import briefing
from solstice.plans.facts import FactInputs, Provenance, build_facts, with_profiles

NOW = "2026-09-07"


@pytest.fixture(scope="module")
def base(spark):
    """Nairobi, a Kenyan farm, Manila, Brussels, and an ocean point next to land."""
    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    places = df(
        [(1, -1.29, 36.82, "KE", 4000000, "all"), (2, -1.29, 36.82, "KE", 4000000, "farmer"), (3, 14.6, 121.0, "PH", 1600000, "all"), (4, 50.85, 4.35, "BE", 1000000, "all"),
         (5, -1.29, 36.82, "KE", 900, "urban")],
        "place_id LONG, lat DOUBLE, lon DOUBLE, cc STRING, pop LONG, livelihood STRING",
    )
    comp = []
    for cell, pct in (("-001.0_+0037.0", 40.0), ("+015.0_+0121.0", -30.0)):
        comp += [(cell, "a", "en", k, pct, 80.0 if pct > 0 else 10.0, 20.0, 5, [pct, pct + 30, None, pct - 2, pct, pct]) for k in range(12)]
    return dict(
        places=places,
        land=df([(44, 108), (52, 150)], "i INT, j INT"),
        composites=df(comp, "cell_id STRING, source STRING, phase STRING, k INT, pct DOUBLE, wetter_frac DOUBLE, std DOUBLE, n INT, events ARRAY<DOUBLE>"),
        event_labels=df([("en", ["1982-83", "1987-88", "1991-92", "1997-98", "2015-16", "2023-24"])], "phase STRING, labels ARRAY<STRING>"),
        regions=df([("east-africa", "East Africa", 5, 0, ["who"]), ("se-asia", "South-East Asia", 4, 1, ["who"]), ("tropics", "Tropics", 1, 2, [])], "region_id STRING, name STRING, priority INT, ord INT, sources ARRAY<STRING>"),
        region_boxes=df([("east-africa", -5.0, 5.0, 30.0, 45.0), ("se-asia", 0.0, 20.0, 100.0, 130.0), ("tropics", -23.0, 23.0, -180.0, 180.0)], "region_id STRING, lat0 DOUBLE, lat1 DOUBLE, lon0 DOUBLE, lon1 DOUBLE"),
        region_phases=df(
            [("east-africa", "el_nino", "much wetter", "warmer", "Oct-Dec", "high", "Short rains are often heavy.", ["FL"]), ("se-asia", "el_nino", "drier", "warmer", "Dec-Mar", "medium", "Often dry.", ["DR", "WF"]),
             ("tropics", "el_nino", "mixed", "warmer", "all year", "low", "", [])],
            "region_id STRING, phase STRING, rain STRING, temp STRING, season STRING, confidence STRING, note STRING, hazards ARRAY<STRING>",
        ),
        status=df([("el_nino", "advisory", "El Niño Advisory", "strong", 79, "12 August 2026", "It is expected to last.", "Centre", "https://example.org")],
                  "phase STRING, level STRING, status STRING, expected_strength STRING, headline_probability_pct INT, issued STRING, synopsis STRING, source STRING, source_url STRING"),
        steps=df(
            [("FL", 0, "flood-a", "x", "Clear the drains near your home.", "w", 15, ["all"]), ("FL", 1, "flood-farm", "x", "Move seed to a dry place.", "w", 15, ["farmer"]), ("FL", 2, "flood-a", "x", "twice", "w", 1, ["all"]),
             ("RVF", 0, "rvf", "x", "Ask about animal vaccines.", "w", 5, ["farmer"]), ("always", 0, "official", "x", "Follow your weather service.", "w", 5, ["all"])],
            "hazard STRING, ord INT, id STRING, icon STRING, text STRING, why STRING, minutes INT, `for` ARRAY<STRING>",
        ),
        services=df([("KE", "Kenya Meteorological Department", "https://meteo.go.ke")], "cc STRING, name STRING, url STRING"),
        now=NOW,
        provenance={"a": Provenance("Rain cube", "v2", "https://example.org/a", "2026-08-01"), "oni": Provenance("Index", "JJA 2026", "https://example.org/i"), "forecast": Provenance("Model", "2026-09-01", "https://example.org/m"),
                    "recent_rain": Provenance("Recent rain", "through 2026-08", "u", "2026-09-01"), "drought": Provenance("Drought map", None, "v")},
    )


def facts(base, **extra):
    return {r.place_id: r for r in build_facts(FactInputs(**{**base, **extra})).collect()}


def forecast(spark, sign):
    return spark.createDataFrame([(p, ym, sign * a, 100.0) for p in (1, 2, 3) for ym, a in (("2026-10", 40.0), ("2026-11", 50.0), ("2026-12", 20.0), ("2027-05", 900.0))], "place_id LONG, ym STRING, anomaly DOUBLE, mean DOUBLE")


def test_regions_history_service_and_text(spark, base):
    built = build_facts(FactInputs(**base))
    f = {r.place_id: r for r in built.collect()}
    n = f[1]
    assert n.region.id == "east-africa" and n.other_regions == ["Tropics"] and n.signal.timing.state == "coming" and n.confidence == "likely"
    assert n.history.composite_pct == 40.0 and [x.label for x in n.history.recent] == ["1997-98", "2015-16", "2023-24"] and len(n.history.all) == 5
    assert n.agreement == "agree" and n.met_service.name == "Kenya Meteorological Department" and n.forecast is None and n.conditions is None
    assert [s.id for s in n.steps] == ["flood-a", "official"] and [s.id for s in f[2].steps] == ["flood-a", "flood-farm", "official"]
    assert "wmo.int" in f[4].met_service.url and f[4].region is None and f[4].signal is None and f[4].confidence == "uncertain"
    assert f[3].agreement == "agree" and f[3].confidence == "leaning" and f[3].signal.months == [12, 1, 2, 3]
    named = built.join(spark.createDataFrame([(1, "Nairobi"), (3, "Manila"), (4, "Brussels")], "place_id LONG, name STRING"), "place_id", "left")
    rendered = briefing.render(named, briefing.english_catalog(spark))
    blocks = {r.place_id: {b.key: b for b in r.blocks} for r in rendered.collect()}
    assert blocks[1]["headline"].text == "Nairobi: much more rain than usual is likely in Oct–Dec 2026."
    assert blocks[4]["headline"].text.startswith("Brussels: no clear link") and "neutral" in blocks[4]
    assert blocks[1]["timing"].text == "Oct–Dec 2026 starts next month."
    assert "{" not in "".join(b.text for b in blocks[1].values())
    assert "1997-98" in blocks[1]["history"].detail
    order = [b.key for b in rendered.where("place_id = 1").first().blocks]
    assert order == ["headline", "risks", "timing", "expect", "note", "confidence", "history", "status", "steps", "defer", "sources", "provenance"]
    said = {r.place_id: r for r in briefing.scripts(rendered).collect()}
    assert all(len(r.sms) <= 160 for r in said.values()) and len(said[1].radio.split()) < 110


def test_forecast_moves_confidence(spark, base):
    table = rules.rule_table(spark)
    skill = lambda c, r: spark.createDataFrame([("-001.0_+0037.0", c, r)], "cell_id STRING, correlation DOUBLE, roc DOUBLE")
    up = facts(base, forecast=forecast(spark, 1))[1]
    assert up.forecast.pct == round(100 * 110 / 190) and up.forecast_agreement == "agree" and up.confidence == "likely"
    down = facts(base, forecast=forecast(spark, -1))[1]
    assert down.forecast_agreement == "disagree" and down.confidence == "leaning"
    unknown = facts(base, forecast=forecast(spark, -1), rules=table)[1]
    assert unknown.skill_class == "unknown" and unknown.forecast.disagreement == "trust_history"
    good = facts(base, forecast=forecast(spark, -1), rules=table, skill=skill(0.7, 0.8))[1]
    assert good.skill_class == "good" and good.forecast.disagreement == "trust_forecast" and good.confidence == good.forecast_rule.confidence
    poor = facts(base, forecast=forecast(spark, -1), rules=table, skill=skill(0.1, 0.5))[1]
    assert poor.skill_class == "poor" and poor.consistency.k <= poor.consistency.n


def test_optional_layers(spark, base):
    rain = spark.createDataFrame([("-001.0_+0037.0", 62.0)], "cell_id STRING, recent_rain_pct DOUBLE")
    cyc = spark.createDataFrame([("+015.0_+0121.0", 2.5, 2.0)], "cell_id STRING, en_rate DOUBLE, neutral_rate DOUBLE")
    seasons = spark.createDataFrame([("KE", "east-africa", "the short rains")], "cc STRING, region_id STRING, local_season STRING")
    hazards = spark.createDataFrame([("KE", "el_nino", ["RVF"])], "cc STRING, phase STRING, hazards_add ARRAY<STRING>")
    from solstice.operators import crops as cr

    sessions = spark.createDataFrame(
        [("KE", "Maize", "z1", "no", 10, 11, 2, 3), ("KE", "Beans (dry)", "z1", "no", 10, None, 1, None), ("KE", "Tea", "z1", "Yes", None, None, None, None)],
        "iso2 STRING, crop STRING, zone STRING, all_year STRING, early_sowing INT, later_sowing INT, early_harvest INT, late_harvest INT",
    )
    crops = cr.country_crops(cr.usable_windows(cr.crop_windows(sessions)))
    built = build_facts(FactInputs(**{**base, "recent_rain": rain, "cyclones": cyc, "cyclone_years": (8, 12), "country_seasons": seasons, "country_hazards": hazards, "crops": crops}))
    f = {r.place_id: r for r in built.collect()}
    assert f[1].conditions.recent_rain_pct == 62.0 and f[1].conditions.usdm is None and f[3].conditions is None
    assert f[1].signal.local_season == "the short rains" and f[1].signal.hazards == ["FL", "RVF"]
    assert f[1].farmer is None and f[2].farmer.crops == ["maize", "beans"] and f[2].farmer.stage == "planting" and f[2].farmer.window == [10, 11]
    assert f[5].farmer is not None  # a village counts as rural
    assert f[3].cyclones.wnp and f[1].cyclones is None
    assert [p.layer for p in f[1].provenance] == ["status", "history", "events", "conditions"]
    blocks = {r.place_id: {b.key: b.text for b in r.blocks} for r in briefing.render(built, briefing.english_catalog(spark)).collect()}
    assert "38% less rain than usual" in blocks[1]["conditions"] and "the short rains" in blocks[1]["headline"]
    assert "farther east" in blocks[3]["cyclones"] and "planting time" in blocks[2]["farmer"]
    assert "conditions" not in blocks[3]


def test_neutral_phase(spark, base):
    status = base["status"].withColumn("phase", F.lit("neutral"))
    built = build_facts(FactInputs(**{**base, "status": status}))
    f = {r.place_id: r for r in built.collect()}
    assert f[1].signal is None and f[1].history is None and f[1].agreement == "none"
    text = briefing.render(built, briefing.english_catalog(spark)).where("place_id = 1").first().blocks[0].text
    assert text == "This area: no strong seasonal signal now."


def test_rule_ladder(spark):
    rows = [("high", "agree", "likely"), ("high", "disagree", "leaning"), ("high", "none", "likely"), ("medium", "agree", "leaning"), ("medium", "weak", "uncertain"), ("low", "agree", "uncertain")]
    df = spark.createDataFrame(rows, "c STRING, a STRING, want STRING")
    assert df.where(rules.base_confidence(F.col("c"), F.col("a")) != F.col("want")).count() == 0
    cases = [(None, 1, None, "none"), (4.0, 1, None, "weak"), (9.0, 1, 20.0, "weak"), (9.0, 1, 0.0, "agree"), (9.0, 0, None, "none"), (-9.0, 1, None, "disagree"), (-9.0, -1, None, "agree")]
    df = spark.createDataFrame(cases, "p DOUBLE, s INT, std DOUBLE, want STRING")
    assert df.where(rules.agreement(F.col("p"), F.col("s"), F.col("std")) != F.col("want")).count() == 0


def test_profiles_give_the_same_rows(spark, base, scratch):
    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    full = dict(
        base, forecast=forecast(spark, 1), rules=rules.rule_table(spark),
        skill=df([("-001.0_+0037.0", 0.6, 0.8), ("+015.0_+0121.0", None, 0.9)], "cell_id STRING, correlation DOUBLE, roc DOUBLE"),
        recent_rain=df([("-001.0_+0037.0", 60.0)], "cell_id STRING, recent_rain_pct DOUBLE"), drought=df([("+015.0_+0121.0", 2), ("+051.0_+0005.0", 1)], "cell_id STRING, usdm INT"),
        cyclones=df([("+015.0_+0121.0", 1.5, 2.5)], "cell_id STRING, en_rate DOUBLE, neutral_rate DOUBLE"), cyclone_years=(9, 20),
        country_seasons=df([("KE", "east-africa", "vuli"), ("KE", "tropics", "masika"), ("PH", "se-asia", "amihan")], "cc STRING, region_id STRING, local_season STRING"),
        country_hazards=df([("KE", "el_nino", ["RVF"]), ("KE", "la_nina", ["LO"]), ("BE", "la_nina", ["DR"])], "cc STRING, phase STRING, hazards_add ARRAY<STRING>"),
        source_names=df([("who", "Health", "https://example.org/who")], "id STRING, label STRING, url STRING"),
    )

    def store(made, name):
        made.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.schema(made.schema).parquet(f"{scratch}/{name}")

    for given in (full, base):
        plain = build_facts(FactInputs(**given))
        by_profile = build_facts(with_profiles(FactInputs(**given), store))
        assert by_profile.dtypes == plain.dtypes
        want = sorted(map(repr, plain.collect()))
        assert len(want) == 5 and sorted(map(repr, by_profile.collect())) == want
        if given is full:  # the run itself plans only joins to stored tables
            assert by_profile._jdf.queryExecution().optimizedPlan().toString().count("Join") < plain._jdf.queryExecution().optimizedPlan().toString().count("Join")
