"""Decision rules and the facts row."""

from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.functions import grid as g
from solstice.functions.joins import dim_join
from solstice.operators import crops as crop_ops
from solstice.operators import cube, rules as op, spatial, tracks
from solstice.plans import sqltext as s
from solstice.plans.facts import FactInputs, Provenance, build_facts, with_profiles
from solstice.plans.queries import crops as crop_q
from solstice.plans.queries import cube as cube_q
from solstice.plans.queries import tracks as track_q
from solstice.plans.queries.spatial import REGIONS_SQL, snap_sql
from solstice.plans.registry import query
from solstice.sources.scratch import stored

SIGN = "CASE WHEN regexp_matches(rain, '(?i)wetter') THEN 1 WHEN regexp_matches(rain, '(?i)drier') THEN -1 ELSE 0 END"


def agree_sql(pct: str, sign: str, std: str | None = None) -> str:
    weak = f"abs({pct}) <= 5" + (f" OR coalesce({std} <> 0 AND abs({pct}) < {std} / 2, false)" if std else "")
    return f"CASE WHEN {pct} IS NULL OR {sign} = 0 THEN 'none' WHEN {weak} THEN 'weak' WHEN ({pct} > 0) = ({sign} > 0) THEN 'agree' ELSE 'disagree' END"


BASE = "CASE WHEN curated = 'high' THEN CASE WHEN agree = 'disagree' THEN 'leaning' ELSE 'likely' END WHEN curated = 'medium' AND agree = 'agree' THEN 'leaning' ELSE 'uncertain' END"
UP = "CASE {0} WHEN 'uncertain' THEN 'leaning' ELSE 'likely' END"
DOWN = "CASE {0} WHEN 'likely' THEN 'leaning' ELSE 'uncertain' END"
SKILL = "CASE WHEN corr IS NULL THEN 'unknown' WHEN corr >= 0.5 AND (roc IS NULL OR roc >= 0.7) THEN 'good' WHEN corr >= 0.3 AND (roc IS NULL OR roc >= 0.6) THEN 'fair' ELSE 'poor' END"
BAND = "CASE WHEN p >= 60 THEN 'strong' WHEN p >= 45 THEN 'moderate' WHEN p IS NOT NULL THEN 'weak' END"
FALLBACK = "coalesce(prob, CASE WHEN abs(fpct) >= 25 THEN 60 WHEN abs(fpct) >= 10 THEN 45 ELSE 0 END)"
RULE_ROWS = "(VALUES " + ", ".join(str(r) for r in op.RULES) + ") AS r(skill, band, rule_confidence, template, lean_on)"
CLASH = "CASE WHEN skill = 'good' THEN 'trust_forecast' WHEN skill IN ('poor', 'unknown') THEN 'trust_history' ELSE 'say_both' END"
STAGE1 = f"SELECT *, {SIGN} AS sign, {SKILL} AS skill, {FALLBACK} AS p FROM v_rule"
STAGE2 = f"SELECT *, {agree_sql('pct', 'sign', 'std')} AS agree, {agree_sql('fpct', 'sign')} AS fagree, {BAND} AS band FROM ({STAGE1})"
STAGE3 = f"SELECT x.*, {BASE} AS base, rule_confidence, template, lean_on FROM ({STAGE2}) x LEFT JOIN {RULE_ROWS} ON r.skill = x.skill AND r.band = x.band"
MERGED = f"""CASE WHEN rule_confidence IS NULL THEN base WHEN fagree = 'disagree' THEN CASE WHEN skill = 'good' THEN rule_confidence ELSE {DOWN.format('base')} END
  WHEN fagree = 'agree' AND agree <> 'disagree' THEN CASE WHEN lean_on <> 'history' AND skill = 'good' THEN {UP.format('base')} ELSE base END
  WHEN lean_on = 'forecast' AND agree = 'none' THEN rule_confidence ELSE base END"""


def stage(t):
    df = t.rule.withColumns({"sign": op.rain_sign(F.col("rain")), "skill": op.skill_class(F.col("corr"), F.col("roc"))})
    df = df.withColumns(
        {
            "agree": op.agreement(F.col("pct"), F.col("sign"), F.col("std")),
            "fagree": op.agreement(F.col("fpct"), F.col("sign")),
            "band": op.probability_band(F.coalesce("prob", op.fallback_probability(F.col("fpct")))),
        }
    )
    return df.withColumn("base", op.base_confidence(F.col("curated"), F.col("agree")))


@query("r1_rain_sign", f"SELECT id, CAST({SIGN} AS INT) AS sign FROM v_rule")
def r1(t):
    return t.rule.select("id", op.rain_sign(F.col("rain")).alias("sign"))


@query("r3_agreement", f"SELECT id, agree, fagree FROM ({STAGE2})")
def r3(t):
    return stage(t).select("id", "agree", "fagree")


@query("r4_base_confidence", f"SELECT id, {BASE} AS base FROM ({STAGE2})")
def r4(t):
    return stage(t).select("id", "base")


@query("r5_confidence_steps", f"SELECT id, {UP.format('base')} AS up, {DOWN.format('base')} AS down FROM (SELECT id, {BASE} AS base FROM ({STAGE2}))")
def r5(t):
    return stage(t).select("id", op.step(F.col("base"), 1).alias("up"), op.step(F.col("base"), -1).alias("down"))


@query("r6_skill_class", f"SELECT id, {SKILL} AS skill FROM v_rule")
def r6(t):
    return t.rule.select("id", op.skill_class(F.col("corr"), F.col("roc")).alias("skill"))


@query("r7_probability_band", f"SELECT id, band FROM ({STAGE2})")
def r7(t):
    return stage(t).select("id", "band")


@query("r8_rule_lookup", f"SELECT id, rule_confidence, template, lean_on FROM ({STAGE3})")
def r8(t):
    return op.with_rule(stage(t), op.rule_table(t.spark)).select("id", "rule_confidence", "template", "lean_on")


@query("r9_disagreement", f"SELECT id, CASE WHEN fagree = 'disagree' THEN {CLASH} END AS disagreement FROM ({STAGE2})")
def r9(t):
    return stage(t).select("id", F.when(F.col("fagree") == "disagree", op.disagreement(F.col("skill"))).alias("disagreement"))


@query(
    "r10_merged_confidence",
    f"SELECT id, {MERGED} AS confidence, CASE WHEN fagree = 'disagree' THEN {DOWN.format('base')} WHEN fagree = 'agree' AND agree <> 'disagree' THEN {UP.format('base')} ELSE base END AS plain FROM ({STAGE3})",
)
def r10(t):
    df = op.with_rule(stage(t), op.rule_table(t.spark))
    merged = op.merged_confidence(*[F.col(c) for c in ("base", "agree", "fagree", "skill", "rule_confidence", "lean_on")])
    return df.select("id", merged.alias("confidence"), op.merged_confidence_plain(F.col("base"), F.col("agree"), F.col("fagree")).alias("plain"))


@query(
    "r11_consistency",
    """SELECT id, CAST(floor(share * n + 0.5) AS BIGINT) AS k, CASE WHEN pct >= 0 THEN 'wetter' ELSE 'drier' END AS direction, CASE WHEN share >= 0.75 THEN 'consistent' WHEN share <= 0.6 THEN 'mixed' ELSE 'leaning' END AS cls
    FROM (SELECT *, CASE WHEN pct >= 0 THEN wet / 100 ELSE 1 - wet / 100 END AS share FROM v_rule WHERE pct IS NOT NULL AND n >= 3)""",
)
def r11(t):
    c = op.consistency(F.col("pct"), F.col("wet"), F.col("n"))
    return t.rule.withColumn("c", c).where("c IS NOT NULL").select("id", "c.k", "c.direction", "c.cls")


# --- layers of the facts job -------------------------------------------------------------------
NOW = "1998-09-07"
SUPPLIER_LAT = "CAST((s_suppkey*7919) % 17900 AS DOUBLE)/100 - 89.5"
SUPPLIER_LON = "CAST((s_suppkey*104729) % 36000 AS DOUBLE)/100 - 180"
LAND = f"SELECT DISTINCT {s.lat_index(SUPPLIER_LAT)} AS i, {s.lon_index(SUPPLIER_LON)} AS j FROM supplier"
SUPPLIER_CELL = s.cell_text(f"{s.lat_index(SUPPLIER_LAT)} * 2 - 89", f"{s.lon_index(SUPPLIER_LON)} * 2 - 179")
PHASE_SQL = """SELECT n_nationkey AS region_id, 'el_nino' AS phase, CASE n_nationkey % 5 WHEN 0 THEN 'wetter' WHEN 1 THEN 'drier' WHEN 2 THEN 'much wetter' WHEN 3 THEN 'near normal' ELSE 'much drier' END AS rain,
  CASE n_nationkey % 4 WHEN 0 THEN 'Oct-Dec' WHEN 1 THEN 'Dec-Mar' WHEN 2 THEN 'Jun-Aug' ELSE 'All year' END AS season, CASE n_regionkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS curated,
  'H' || n_regionkey AS h1, 'H' || (n_nationkey % 3) AS h2 FROM nation"""


def region_table(t):
    return t.nation.selectExpr("n_nationkey AS region_id", "n_name AS name", "n_regionkey AS priority", "n_nationkey AS ord", "array(concat('src', n_regionkey)) AS sources")


def region_phases(t):
    base = t.nation.selectExpr(
        "n_nationkey AS region_id",
        "CASE n_nationkey % 5 WHEN 0 THEN 'wetter' WHEN 1 THEN 'drier' WHEN 2 THEN 'much wetter' WHEN 3 THEN 'near normal' ELSE 'much drier' END AS rain",
        "CASE n_nationkey % 5 WHEN 0 THEN 'drier' WHEN 1 THEN 'wetter' ELSE 'near normal' END AS other_rain",
        "CASE n_nationkey % 4 WHEN 0 THEN 'Oct-Dec' WHEN 1 THEN 'Dec-Mar' WHEN 2 THEN 'Jun-Aug' ELSE 'All year' END AS season",
        "CASE n_regionkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence",
        "array(concat('H', n_regionkey), concat('H', n_nationkey % 3)) AS hazards",
    )
    warm = base.selectExpr("region_id", "'el_nino' AS phase", "rain", "'warmer' AS temp", "season", "confidence", "concat('note ', region_id) AS note", "hazards")
    cold = base.selectExpr("region_id", "'la_nina' AS phase", "other_rain AS rain", "'cooler' AS temp", "season", "confidence", "concat('note ', region_id) AS note", "hazards")
    return warm.unionByName(cold)


def status_row(t, phase="el_nino"):
    return t.spark.range(1).selectExpr(
        f"'{phase}' AS phase", "'advisory' AS level", "'Warm phase advisory' AS status", "'strong' AS expected_strength", "79 AS headline_probability_pct",
        "'12 August 1998' AS issued", "'The warm phase is expected to continue.' AS synopsis", "'Climate centre' AS source", "'https://example.org/status' AS source_url",
    )


def places(t):
    return t.point.selectExpr(
        "id AS place_id", "lat", "lon", "concat('N', nk) AS cc", "CAST(floor(w * 10) AS BIGINT) AS pop",
        "CASE seg WHEN 'MACHINERY' THEN 'farmer' WHEN 'BUILDING' THEN 'urban' WHEN 'HOUSEHOLD' THEN 'coastal' ELSE 'all' END AS livelihood",
    )


def supplier_cells(t):
    lat, lon = F.expr(SUPPLIER_LAT), F.expr(SUPPLIER_LON)
    return t.supplier.select("*", g.lat_index(lat).alias("i"), g.lon_index(lon).alias("j")).withColumn(
        "cell_id", g.format_cell(F.col("i") * 2 - 89.0, F.col("j") * 2 - 179.0)
    )


def land(t):
    return supplier_cells(t).select("i", "j").distinct()


def step_rows(t):
    nation = t.nation.selectExpr(
        "concat('H', n_regionkey) AS hazard", "n_nationkey AS ord", "concat('step-', n_nationkey % 18) AS id", "'*' AS icon", "concat('Do ', n_name, '.') AS text", "'Because.' AS why",
        "n_nationkey AS minutes", "CASE n_nationkey % 3 WHEN 0 THEN array('all') WHEN 1 THEN array('farmer') ELSE array('urban', 'coastal') END AS `for`",
    )
    always = t.region.selectExpr(
        "'always' AS hazard", "r_regionkey AS ord", "concat('always-', r_regionkey) AS id", "'!' AS icon", "concat('Watch ', r_name, '.') AS text", "'Because.' AS why",
        "5 AS minutes", "array('all') AS `for`",
    )
    return nation.unionByName(always)


def country_hazards(t):
    return t.nation.where("n_regionkey = 1").selectExpr("concat('N', n_nationkey) AS cc", "'el_nino' AS phase", "array('H4', 'H0') AS hazards_add")


def recent_rain(t):
    return supplier_cells(t).groupBy("cell_id").agg(F.max(F.floor(F.col("s_acctbal") / 50).cast("double")).alias("recent_rain_pct")).where("recent_rain_pct < 120")


def drought(t):
    return supplier_cells(t).where("s_acctbal > 5000").groupBy("cell_id").agg(F.max(F.col("s_nationkey") % 5).cast("int").alias("usdm"))


def skill(t):
    return supplier_cells(t).groupBy("cell_id").agg((F.max(F.col("s_suppkey") % 10) / 10).alias("correlation"), (F.max(F.col("s_suppkey") % 7) / 7).alias("roc"))


def cell_cube(t):
    rows = t.lineitem.select(
        F.when(F.col("l_linenumber") % 2 == 1, "a").otherwise("b").alias("source"), F.col("l_suppkey").alias("s_suppkey"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_quantity",
    )
    monthly = rows.groupBy("source", "s_suppkey", "year", "month").agg(F.sum("l_quantity").alias("q"))
    located = monthly.withColumn(
        "cell", g.format_cell(g.lat_index(F.expr(SUPPLIER_LAT)) * 2 - 89.0, g.lon_index(F.expr(SUPPLIER_LON)) * 2 - 179.0)
    )
    return located.groupBy("source", "cell", "year", "month").agg(F.sum("q").alias("value"))


def fact_inputs(t, **changes) -> FactInputs:
    # at most one row per source, grid cell and month, made of all line items: written once, as coverage, normals and totals each read it
    composites = cube.composite_fact(stored(cell_cube(t), "cell-cube"), cube_q.event_rows(t), *cube_q.BASE, primary="a", fallback="b", with_vectors=True)
    windows = crop_q.windows(t).withColumn("iso2", F.concat(F.lit("N"), F.col("iso2").cast("string")))
    rates = tracks.cell_rates(track_q.classed(t), tracks.storm_cells(t.fix), track_q.years(t))
    made = {
        "places": places(t), "land": land(t), "composites": composites.withColumnRenamed("cell", "cell_id"),
        "event_labels": t.spark.createDataFrame([("en", ["1996-97", "1998-99", "1999-00"]), ("ln", ["1995-96", "1997-98", "2000-01"])], "phase STRING, labels ARRAY<STRING>"),
        "regions": region_table(t), "region_boxes": t.box.drop("name", "priority"), "region_phases": region_phases(t), "status": status_row(t),
        "steps": step_rows(t), "services": t.nation.where("n_regionkey <> 4").selectExpr("concat('N', n_nationkey) AS cc", "concat('Service ', n_name) AS name", "concat('https://', n_name) AS url"),
        "now": NOW, "country_seasons": t.nation.selectExpr("concat('N', n_nationkey) AS cc", "(n_nationkey + 1) % 25 AS region_id", "concat('rains of ', n_name) AS local_season"),
        "country_hazards": country_hazards(t),
        "source_names": t.region.selectExpr("concat('src', r_regionkey) AS id", "r_name AS label", "concat('https://example.org/', r_name) AS url"),
        "forecast": t.forecast.selectExpr("place AS place_id", "concat(ym div 100, '-', lpad(ym % 100, 2, '0')) AS ym", "anomaly", "mean"),
        "skill": skill(t), "rules": op.rule_table(t.spark), "recent_rain": recent_rain(t), "drought": drought(t),
        "crops": crop_ops.country_crops(crop_ops.usable_windows(windows)),
        "cyclones": tracks.display_rates(rates).where("neutral_rate IS NOT NULL"), "cyclone_years": (2, 2),
        "provenance": {
            "a": Provenance("Cube A", "v2", "https://example.org/a", "1998-08-01"), "b": Provenance("Cube B", "v1", "https://example.org/b", "1998-08-02"),
            "oni": Provenance("Index", "JJA 1998", "https://example.org/index"), "forecast": Provenance("Model", "1998-09-01", "https://example.org/model"),
            "recent_rain": Provenance("Rain", "through 1998-08", "https://example.org/rain", "1998-09-01"), "drought": Provenance("Drought map", "1998-09-01", "https://example.org/drought", "1998-09-03"),
            "crops": Provenance("Calendar", "v1", "https://example.org/crops"), "cyclones": Provenance("Tracks", "v4", "https://example.org/tracks"),
        },
    }
    return FactInputs(**{**made, **changes})


def facts(t, **changes):
    return build_facts(fact_inputs(t, **changes))


# SQL side: p = places with cell, region, signal; h = composites; f = forecast
RECENT_SQL = f"SELECT {SUPPLIER_CELL} AS cell_id, max(floor(s_acctbal / 50)) AS rr FROM supplier GROUP BY 1 HAVING max(floor(s_acctbal / 50)) < 120"
DROUGHT_SQL = f"SELECT {SUPPLIER_CELL} AS cell_id, CAST(max(s_nationkey % 5) AS INT) AS usdm FROM supplier WHERE s_acctbal > 5000 GROUP BY 1"
SKILL_SQL = f"SELECT {SUPPLIER_CELL} AS cell_id, max(s_suppkey % 10) / 10.0::DOUBLE AS corr, max(s_suppkey % 7) / 7.0::DOUBLE AS roc FROM supplier GROUP BY 1"
RANKED_SQL = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC, region_id) AS rn FROM ({REGIONS_SQL})"
PLACES_SQL = f"""SELECT pt.id, 'N' || pt.nk AS cc, pt.nk, c.cell_id, c.own_is_land AS own, c.on_land, r.region_id, r.name AS region_name, ph.rain, ph.season, ph.curated, ph.h1, ph.h2, n.n_regionkey AS cr,
  CASE pt.seg WHEN 'MACHINERY' THEN 'farmer' WHEN 'BUILDING' THEN 'urban' WHEN 'HOUSEHOLD' THEN 'coastal' ELSE 'all' END AS livelihood,
  CASE season WHEN 'Oct-Dec' THEN 10 WHEN 'Dec-Mar' THEN 0 WHEN 'Jun-Aug' THEN 6 WHEN 'All year' THEN 5 END AS k, CASE season WHEN 'Oct-Dec' THEN 'coming' WHEN 'Dec-Mar' THEN 'coming' WHEN 'Jun-Aug' THEN 'passed' WHEN 'All year' THEN 'now' ELSE 'unknown' END AS state,
  CASE season WHEN 'Oct-Dec' THEN [199810, 199811, 199812] WHEN 'Dec-Mar' THEN [199812, 199901, 199902, 199903] WHEN 'Jun-Aug' THEN [199906, 199907, 199908] WHEN 'All year' THEN [199801 + q FOR q IN range(12)] ELSE [] END AS wanted
  FROM v_point pt JOIN ({snap_sql(LAND)}) c ON c.id = pt.id LEFT JOIN ({RANKED_SQL}) r ON r.id = pt.id AND r.rn = 1 LEFT JOIN ({PHASE_SQL}) ph ON ph.region_id = r.region_id LEFT JOIN nation n ON n.n_nationkey = pt.nk"""
CELL_CUBE = f"SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS source, {SUPPLIER_CELL.replace('s_suppkey', 'l_suppkey')} AS cell, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, sum(l_quantity) AS value FROM lineitem GROUP BY 1,2,3,4"
HISTORY_SQL = cube_q.dense_sql(cube_q.anomaly_sql()).replace("v_cube", f"({CELL_CUBE})").replace("round(avg(pct), 4)", "CAST(round_even(avg(pct), 0) AS DOUBLE)").replace(
    "round(stddev_pop(pct), 4)", "CAST(round_even(stddev_pop(pct), 0) AS DOUBLE)"
)
FORECAST_SQL = """SELECT p.id, sum(anomaly) AS an, sum(mean) - sum(anomaly) AS nr, count(*) AS nm FROM p JOIN v_forecast f ON f.place = p.id AND list_contains(p.wanted, f.ym) GROUP BY 1 HAVING sum(mean) - sum(anomaly) >= 10"""
JOINED = f"""WITH p AS ({PLACES_SQL}), h AS ({HISTORY_SQL}), f AS ({FORECAST_SQL}), z AS (
  SELECT p.*, coalesce({SIGN}, 0) AS sign, h.source AS hsrc, h.pct AS pct, h.std AS std, h.n AS hn, h.wetter_frac AS wet, CASE WHEN f.id IS NOT NULL THEN CAST(greatest(-100, least(300, floor(100 * an / nr + 0.5))) AS INT) END AS fpct, f.id IS NOT NULL AS has_f,
    CASE WHEN f.id IS NOT NULL THEN CASE WHEN sk.corr IS NULL THEN 'unknown' WHEN corr >= 0.5 AND roc >= 0.7 THEN 'good' WHEN corr >= 0.3 AND roc >= 0.6 THEN 'fair' ELSE 'poor' END END AS skill, NULL::INT AS prob, rr, usdm
  FROM p LEFT JOIN h ON h.cell = p.cell_id AND h.phase = 'en' AND h.k = p.k LEFT JOIN f ON f.id = p.id LEFT JOIN ({SKILL_SQL}) sk ON sk.cell_id = p.cell_id
  LEFT JOIN ({RECENT_SQL}) rc ON rc.cell_id = p.cell_id LEFT JOIN ({DROUGHT_SQL}) dr ON dr.cell_id = p.cell_id),
  a AS (SELECT *, {agree_sql('pct', 'sign', 'std')} AS agree, {agree_sql('fpct', 'sign')} AS fagree, CASE WHEN has_f THEN {BAND.replace('p >=', FALLBACK + ' >=').replace('p IS', FALLBACK + ' IS')} END AS band FROM z),
  b AS (SELECT a.*, {BASE} AS base, rule_confidence, template, lean_on FROM a LEFT JOIN {RULE_ROWS} ON r.skill = a.skill AND r.band = a.band)"""
HAZARDS = "list_distinct([x FOR x IN list_concat([h1, h2], CASE WHEN cr = 1 THEN ['H4', 'H0'] ELSE [] END) IF x IS NOT NULL])"


def hazards_sql(p: str = "b") -> str:
    """First occurrence order: region hazards, then the country's own."""
    extra = f"CASE WHEN {p}.cr = 1 THEN ['H4', 'H0'] ELSE [] END"
    own = f"CASE WHEN {p}.h1 IS NULL THEN [] WHEN {p}.h1 = {p}.h2 THEN [{p}.h1] ELSE [{p}.h1, {p}.h2] END"
    return f"list_concat({own}, list_filter({extra}, lambda x: NOT list_contains({own}, x)))"


@query("r2_phase_signal", f"SELECT p.id AS place_id, p.region_id, p.rain, p.season FROM ({PLACES_SQL}) p WHERE p.region_id IS NOT NULL")
def r2(t):
    found = spatial.with_regions(places(t), t.box.drop("name", "priority"), region_table(t))
    top = found.select("place_id", F.get("regions", F.lit(0))["region_id"].alias("region_id"), F.lit("el_nino").alias("phase")).where("region_id IS NOT NULL")
    return dim_join(top, region_phases(t), ["region_id", "phase"]).select("place_id", "region_id", "rain", "season")


@query(
    "r12_history_selection",
    f"{JOINED} SELECT id AS place_id, hsrc AS src, CAST(hn AS INT) AS n_events, pct AS composite_pct, NOT (hn >= 3 AND pct IS NOT NULL) AS too_few FROM b WHERE hn IS NOT NULL",
)
def r12(t):
    return facts(t).where("history IS NOT NULL").select("place_id", "history.src", "history.n_events", "history.composite_pct", "history.too_few")


@query("r13_hazard_list", f"SELECT b.id AS place_id, array_to_string({hazards_sql()}, ',') AS hazards FROM ({PLACES_SQL}) b")
def r13(t):
    return with_hazards(t).select("place_id", F.concat_ws(",", "hazards").alias("hazards"))


def with_hazards(t):
    found = spatial.with_regions(places(t), t.box.drop("name", "priority"), region_table(t))
    top = found.withColumns({"region_id": F.get("regions", F.lit(0))["region_id"], "phase": F.lit("el_nino")})
    rows = dim_join(top, region_phases(t).select("region_id", "phase", F.col("hazards").alias("own")), ["region_id", "phase"], "left")
    rows = dim_join(rows, country_hazards(t), ["cc", "phase"], "left")
    return rows.withColumn("hazards", op.hazard_list(F.col("own"), F.col("hazards_add")))


STEP_SQL = """SELECT 'H' || n_regionkey AS hazard, n_nationkey AS ord, 'step-' || (n_nationkey % 18) AS step, CASE n_nationkey % 3 WHEN 0 THEN ['all'] WHEN 1 THEN ['farmer'] ELSE ['urban', 'coastal'] END AS aud FROM nation
  UNION ALL SELECT 'always', r_regionkey, 'always-' || r_regionkey, ['all'] FROM region"""
STEPS_FOR = f"""SELECT id, string_agg(step, ',' ORDER BY o) AS steps FROM (SELECT id, step, min(pos * 1000 + ord) AS o FROM (
    SELECT b.id, b.livelihood, unnest(list_append({hazards_sql()}, 'always')) AS hz, unnest(range(1, len({hazards_sql()}) + 2)) AS pos FROM ({PLACES_SQL}) b) x JOIN ({STEP_SQL}) st ON st.hazard = x.hz AND (list_contains(aud, 'all') OR list_contains(aud, livelihood))
    GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 10) GROUP BY 1"""


@query("r14_step_selection", f"SELECT id AS place_id, steps FROM ({STEPS_FOR})")
def r14(t):
    chosen = op.with_steps(with_hazards(t), step_rows(t))
    return chosen.select("place_id", F.array_join(F.transform("steps", lambda x: x["id"]), ",").alias("steps"))


@query("r15_service_with_fallback", "SELECT p.id AS place_id, coalesce('Service ' || n_name, 'World directory of weather services') AS service FROM v_point p LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) n ON n.n_nationkey = p.nk")
def r15(t):
    x = fact_services(t)
    return dim_join(places(t), x, "cc", "left").select("place_id", F.coalesce("service", F.lit(FactInputs.service_fallback[0])).alias("service"))


def fact_services(t):
    return t.nation.where("n_regionkey <> 4").selectExpr("concat('N', n_nationkey) AS cc", "concat('Service ', n_name) AS service")


@query(
    "r16_local_season",
    f"SELECT p.id AS place_id, 'rains of ' || n.n_name AS local_season FROM ({PLACES_SQL}) p LEFT JOIN nation n ON n.n_nationkey = p.nk AND (p.nk + 1) % 25 = p.region_id",
)
def r16(t):
    found = spatial.with_regions(places(t), t.box.drop("name", "priority"), region_table(t))
    names = t.nation.selectExpr("concat('N', n_nationkey) AS cc", "map((n_nationkey + 1) % 25, concat('rains of ', n_name)) AS season_names")
    joined = dim_join(found.withColumn("region_id", F.get("regions", F.lit(0))["region_id"]), names, "cc", "left")
    return joined.select("place_id", F.element_at("season_names", F.col("region_id")).alias("local_season"))


@query(
    "r17_current_conditions",
    f"""SELECT c.id AS place_id, rr AS recent_rain_pct, usdm FROM ({snap_sql(LAND)}) c LEFT JOIN ({RECENT_SQL}) a ON a.cell_id = c.cell_id LEFT JOIN ({DROUGHT_SQL}) b ON b.cell_id = c.cell_id WHERE rr IS NOT NULL OR usdm IS NOT NULL""",
)
def r17(t):
    placed = spatial.snap_to_land(places(t), land(t))
    rows = dim_join(dim_join(placed, recent_rain(t), "cell_id", "left", bounded=True), drought(t), "cell_id", "left", bounded=True)
    out = rows.withColumn("c", op.conditions(F.col("recent_rain_pct"), F.col("usdm"))).where("c IS NOT NULL")
    return out.select("place_id", "c.recent_rain_pct", "c.usdm")


@query(
    "r18_sources",
    f"""{JOINED} SELECT id AS place_id, concat_ws(',', hsrc, 'oni', 'cpc', CASE WHEN rain IS NOT NULL THEN 'src' || (region_id % 5) END, CASE WHEN has_f THEN 'forecast' END, CASE WHEN rr IS NOT NULL THEN 'conditions' END, CASE WHEN usdm IS NOT NULL THEN 'conditions' END) AS sources,
    concat_ws(',', CASE WHEN has_f THEN 'forecast' END, 'status', CASE WHEN hsrc IS NOT NULL THEN 'history' END, 'events', CASE WHEN rr IS NOT NULL THEN 'conditions' END, CASE WHEN usdm IS NOT NULL THEN 'conditions' END) AS chips,
    CASE WHEN rain IS NOT NULL THEN (SELECT r_name || ' https://example.org/' || r_name FROM region WHERE r_regionkey = region_id % 5) ELSE '' END AS own FROM b""",
)
def r18(t):
    rows = facts(t, crops=None, cyclones=None)
    ids = F.array_join(F.transform("sources", lambda x: x["id"]), ",")
    chips = F.array_join(F.transform("provenance", lambda x: x["layer"]), ",")
    own = F.filter("sources", lambda x: x["id"].startswith("src"))
    return rows.select("place_id", ids.alias("sources"), chips.alias("chips"), F.array_join(F.transform(own, lambda x: F.concat_ws(" ", x["label"], x["url"])), ",").alias("own"))


@query("r19_other_regions", f"SELECT id AS place_id, string_agg(name, ',' ORDER BY rn) AS other_regions FROM ({RANKED_SQL}) WHERE rn IN (2, 3) GROUP BY 1")
def r19(t):
    found = spatial.with_regions(places(t), t.box.drop("name", "priority"), region_table(t))
    names = F.transform(F.slice("regions", 2, 2), lambda r: r["name"])
    return found.select("place_id", F.array_join(names, ",").alias("other_regions")).where("other_regions <> ''")


FACTS_SQL = f"""{JOINED} SELECT b.id AS place_id, cell_id, on_land, region_id, state AS timing, agree AS agreement, pct AS composite_pct, fpct AS forecast_pct, fagree AS forecast_agreement, skill AS skill_class, template,
    CASE WHEN fagree = 'disagree' AND rule_confidence IS NOT NULL THEN {CLASH} END AS disagreement, CASE WHEN rain IS NULL THEN 'uncertain' ELSE {MERGED} END AS confidence, rr AS recent_rain_pct, usdm, s.steps,
    coalesce('Service ' || n.n_name, 'World directory of weather services') AS service FROM b LEFT JOIN ({STEPS_FOR}) s ON s.id = b.id LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) n ON n.n_nationkey = b.nk"""


def shown(rows):
    return rows.select(
        "place_id", "place.cell_id", "place.on_land", F.col("region.id").alias("region_id"), F.coalesce("signal.timing.state", F.lit("unknown")).alias("timing"), "agreement", "history.composite_pct",
        F.col("forecast.pct").alias("forecast_pct"), "forecast_agreement", "skill_class", "forecast_rule.template", "forecast.disagreement", "confidence",
        "conditions.recent_rain_pct", "conditions.usdm", F.array_join(F.transform("steps", lambda x: x["id"]), ",").alias("steps"), F.col("met_service.name").alias("service"),
    )


@query("r20_facts_row", FACTS_SQL)
def r20(t):
    return shown(facts(t))


@query("r20_facts_from_profiles", FACTS_SQL)
def r20_profiles(t):
    """The same rows over stored profiles of cells, countries and regions."""
    return shown(build_facts(with_profiles(fact_inputs(t), lambda made, name: stored(made, f"profiles-{name}"))))
