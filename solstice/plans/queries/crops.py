"""Crop windows and indicators."""

from pyspark.sql import functions as F

from solstice.operators import crops as op
from solstice.plans import sqltext as s
from solstice.plans.registry import query


def staple_sql(x: str) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in op.STAPLES)
    return f"CASE {tests} END"


# crop names with a staple in some of them, from the order priorities
CROP = "CASE crop WHEN '1-URGENT' THEN 'Sweet corn' WHEN '2-HIGH' THEN 'Soybean' WHEN '3-MEDIUM' THEN 'Millet (pearl)' WHEN '5-LOW' THEN 'Plantain' ELSE crop END"
SESSIONS = f"SELECT iso, {CROP} AS crop, CASE zone WHEN 'P' THEN '' ELSE zone || a END AS zone, a, b, h, a = 12 AND zone = 'P' AND iso % 5 = 0 AND crop = '5-LOW' AS ay FROM v_window"


def sessions(t):
    return t.window.selectExpr(
        "iso AS iso2", f"{CROP} AS crop", "CASE zone WHEN 'P' THEN '' ELSE concat(zone, a) END AS zone",
        "CASE WHEN a = 12 AND zone = 'P' AND iso % 5 = 0 AND crop = '5-LOW' THEN 'Yes' END AS all_year",
        "CASE WHEN zone = 'O' THEN a END AS early_sowing", "b AS later_sowing", "h AS early_harvest", "CAST(NULL AS INT) AS late_harvest",
    )


WINDOW_SQL = f"""SELECT iso, crop, array_to_string(list_sort(list_distinct(flatten(list(sow)))), ',') AS sowing, array_to_string(list_sort(list_distinct(flatten(list(har)))), ',') AS harvest,
  count(DISTINCT nullif(zone, '')) AS zones, bool_or(ay) AS all_year FROM (
    SELECT *, CASE WHEN h IS NULL THEN [] ELSE [h] END AS har, CASE WHEN zone NOT LIKE 'O%' THEN [] ELSE [{s.ring('a', 'i')} FOR i IN range(0, {s.pmod('coalesce(b, a) - a', 12)} + 1)] END AS sow FROM ({SESSIONS})) GROUP BY 1, 2"""


def windows(t):
    return op.crop_windows(sessions(t))


def text(col):
    return F.concat_ws(",", F.col(col).cast("array<string>")).alias(col)


@query("k1_keyword_class", f"SELECT doc_id, {staple_sql('text')} AS staple FROM documents")
def k1(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", op.first_keyword_class(F.col("text")).alias("staple"))


@query("k2_window_months", f"SELECT iso AS iso2, crop, sowing, harvest FROM ({WINDOW_SQL})")
def k2(t):
    return windows(t).select("iso2", "crop", text("sowing"), text("harvest"))


@query("k3_zone_counts", f"SELECT iso AS iso2, crop, zones, all_year FROM ({WINDOW_SQL})")
def k3(t):
    return windows(t).select("iso2", "crop", "zones", "all_year")


@query(
    "k4_country_staples",
    f"SELECT iso AS iso2, array_to_string(list_sort(list(DISTINCT {staple_sql('crop')}) FILTER ({staple_sql('crop')} IS NOT NULL)), ',') AS staples FROM ({WINDOW_SQL}) WHERE sowing <> '' OR harvest <> '' OR all_year GROUP BY 1",
)
def k4(t):
    return op.country_staples(windows(t)).select("iso2", text("staples"))


# season of a customer: three months from the first letter of the segment; the staple order decides the crop
RANK = f"coalesce(list_position({op.STAPLE_ORDER!r}, {staple_sql('crop')}), 100)"


@query(
    "k5_season_crop_overlap",
    f"""WITH w AS (SELECT iso, crop, coalesce({staple_sql('crop')}, lower(crop)) AS name, {RANK} AS rank, zones, stage, unnest(CAST(string_split(months, ',') AS INT[])) AS mo FROM (
        SELECT *, 1 AS stage, sowing AS months FROM ({WINDOW_SQL}) WHERE sowing <> '' UNION ALL SELECT *, 2, harvest FROM ({WINDOW_SQL}) WHERE harvest <> '') WHERE NOT all_year),
    p AS (SELECT c_custkey AS id, c_nationkey AS iso, [c_custkey % 12 + 1, (c_custkey + 1) % 12 + 1] AS months FROM customer),
    h AS (SELECT p.id, stage, name, rank, zones, crop, min(mo) AS anchor FROM p JOIN w ON w.iso = p.iso AND list_contains(p.months, w.mo) GROUP BY ALL),
    f AS (SELECT * FROM h QUALIFY stage = min(stage) OVER (PARTITION BY id)),
    n AS (SELECT id, stage, name, min(rank * 1000000 + 1000 - zones) AS o FROM f GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, name) <= 3)
    SELECT id, CASE stage WHEN 1 THEN 'planting' ELSE 'harvest' END AS stage, string_agg(name, ',' ORDER BY o, name) AS crops FROM n GROUP BY 1, 2""",
)
def k5(t):
    months = F.array((F.col("id") % 12 + 1).cast("int"), ((F.col("id") + 1) % 12 + 1).cast("int"))
    places = t.point.select("id", F.col("nk").alias("cc"), months.alias("months"), F.lit(1).alias("rain_sign"), F.lit("farmer").alias("livelihood"), F.lit(0).alias("pop"))
    out = op.with_farming_context(places, op.country_crops(op.usable_windows(windows(t))))
    return out.where("farmer IS NOT NULL").select("id", "farmer.stage", F.concat_ws(",", "farmer.crops").alias("crops"))


@query("k5_crop_window_runs")
def k5_runs(t):
    months = F.array((F.col("id") % 12 + 1).cast("int"), ((F.col("id") + 1) % 12 + 1).cast("int"))
    places = t.point.select("id", F.col("nk").alias("cc"), months.alias("months"), F.lit(-1).alias("rain_sign"), F.lit("all").alias("livelihood"), F.lit(500).alias("pop"))
    out = op.with_farming_context(places, op.country_crops(op.usable_windows(windows(t))))
    return out.where("farmer IS NOT NULL").select("id", "farmer.crop", "farmer.direction", F.concat_ws(",", F.col("farmer.window").cast("array<string>")).alias("window"))


PIVOT_SQL = """SELECT iso, max(CASE ind WHEN 1 THEN sc END) AS inform, max(CASE ind WHEN 2 THEN sc END) AS hazard, max(CASE ind WHEN 3 THEN sc END) AS vulnerability, max(CASE ind WHEN 4 THEN sc END) AS coping
  FROM (SELECT iso, ind, CAST(round_even(score, 1) AS DOUBLE) AS sc FROM v_indicator) GROUP BY 1"""
CODES = {"1": "inform", "2": "hazard", "3": "vulnerability", "4": "coping"}


def wide(t):
    return op.pivot_indicators(t.indicator.select("iso", F.col("ind").cast("string").alias("ind"), "score"), CODES, key="iso")


@query("k6_indicator_pivot", PIVOT_SQL)
def k6(t):
    return wide(t)


@query("k7_complete_indicators", f"SELECT iso FROM ({PIVOT_SQL}) WHERE inform IS NOT NULL AND hazard IS NOT NULL AND vulnerability IS NOT NULL AND coping IS NOT NULL")
def k7(t):
    return op.complete_rows(wide(t)).select("iso")


@query("k8_index_mismatch", f"SELECT iso, round(abs(pow(hazard * vulnerability * coping, 1/3.0::DOUBLE) - inform), 6) AS gap FROM ({PIVOT_SQL}) WHERE abs(pow(hazard * vulnerability * coping, 1/3.0::DOUBLE) - inform) > 0.3")
def k8(t):
    return op.index_mismatch(wide(t)).select("iso", F.round("gap", 6).alias("gap"))


@query(
    "k9_index_class",
    "SELECT s_suppkey AS iso, CASE WHEN x >= 6.5 THEN 'very high' WHEN x >= 5 THEN 'high' WHEN x >= 3.5 THEN 'medium' WHEN x >= 2 THEN 'low' ELSE 'very low' END AS class FROM (SELECT s_suppkey, (s_acctbal + 1000) / 1100 AS x FROM supplier)",
)
def k9(t):
    return t.supplier.select(F.col("s_suppkey").alias("iso"), op.index_class((F.col("s_acctbal") + 1000) / 1100).alias("class"))


@query("k10_rural_flag", "SELECT id, pop > 0 AND pop < 20000 AS rural FROM v_place")
def k10(t):
    return t.place.select("id", op.is_rural(F.col("pop")).alias("rural"))
