"""Storm-track aggregation."""

from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.operators import tracks as op
from solstice.plans import sqltext as s
from solstice.plans.registry import query

BASINS = ["A", "N", "R"]
WIND = "coalesce(try_cast(trim(wmo_wind) AS DOUBLE), try_cast(trim(usa_wind) AS DOUBLE))"
EY = "CAST(CASE WHEN month(ts) >= 7 THEN year(ts) ELSE year(ts) - 1 END AS INT)"
CELL = s.cell(tie=s.half_even)
STORM_SQL = f"""SELECT sid, basin, {EY} AS event_year, lat AS glat, lon AS glon, mw AS max_wind FROM (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, fix_id) AS rn, coalesce(max({WIND}) OVER (PARTITION BY sid), -1) AS mw FROM v_fix) WHERE rn = 1"""
YEAR_SQL = f"SELECT DISTINCT {EY} AS event_year, CASE {EY} % 4 WHEN 0 THEN 'el_nino' WHEN 1 THEN 'la_nina' WHEN 2 THEN 'neutral' ELSE 'other' END AS cls FROM v_fix"
CLASSED_SQL = f"""SELECT x.*, y.cls, CASE WHEN max_wind >= 64 THEN 1 ELSE 0 END AS hurricane FROM ({STORM_SQL}) x JOIN ({YEAR_SQL}) y ON x.event_year = y.event_year AND y.cls <> 'other' WHERE max_wind >= 34"""
COUNT_SQL = f"SELECT c.cls, count(y.cls) AS years FROM (VALUES ('el_nino'), ('la_nina'), ('neutral')) c(cls) LEFT JOIN ({YEAR_SQL}) y ON y.cls = c.cls GROUP BY 1"


def years(t):
    """Year classes cycle through the four classes."""
    y = cal.event_year(F.year("ts"), F.month("ts"))
    cls = F.element_at(F.array(*[F.lit(c) for c in ("el_nino", "la_nina", "neutral", "other")]), (F.col("event_year") % 4 + 1).cast("int"))
    return t.fix.select(y.alias("event_year")).distinct().withColumn("cls", cls)


def classed(t):
    return op.classed_storms(op.storms(t.fix), years(t), BASINS)


@query("f1_valid_fixes", "SELECT sid, fix_id, ts::DATE AS day, lat, lon FROM v_fix WHERE year(ts) BETWEEN 1996 AND 2000")
def f1(t):
    return op.valid_fixes(t.fix, 1996, 2000).select("sid", "fix_id", F.to_date("ts").alias("day"), "lat", "lon")


@query("f2_first_reported_wind", f"SELECT sid, fix_id, {WIND} AS wind FROM v_fix")
def f2(t):
    return t.fix.select("sid", "fix_id", op.wind("wmo_wind", "usa_wind").alias("wind"))


@query("f3_genesis", f"SELECT sid, basin, event_year, glat, glon FROM ({STORM_SQL})")
def f3(t):
    return op.storms(t.fix).drop("max_wind")


@query("f4_storm_max_wind", f"SELECT sid, coalesce(max({WIND}), -1) AS max_wind FROM v_fix GROUP BY 1")
def f4(t):
    return op.storms(t.fix).select("sid", "max_wind")


@query("f5_storm_cells", f"SELECT DISTINCT sid, {CELL} AS cell_id FROM v_fix")
def f5(t):
    return op.storm_cells(t.fix)


@query("f6_classed_storms", f"SELECT sid, basin, event_year, cls, CAST(hurricane AS INT) AS hurricane FROM ({CLASSED_SQL})")
def f6(t):
    return classed(t).select("sid", "basin", "event_year", "cls", "hurricane")


RATES_SQL = f"""SELECT b.basin, c.cls, c.years, CASE WHEN years > 0 THEN CAST(round_even(coalesce(n, 0)::DOUBLE / years, 1) AS DOUBLE) END AS storms_per_year,
  CASE WHEN years > 0 THEN CAST(round_even(coalesce(h, 0)::DOUBLE / years, 1) AS DOUBLE) END AS hurricane_per_year, lo AS genesis_lon_mean, la AS genesis_lat_mean
  FROM (VALUES ('A'), ('N'), ('R')) b(basin) CROSS JOIN ({COUNT_SQL}) c LEFT JOIN
  (SELECT basin, cls, count(*) AS n, sum(hurricane) AS h, CAST(round_even(avg(glon), 1) AS DOUBLE) AS lo, CAST(round_even(avg(glat), 1) AS DOUBLE) AS la FROM ({CLASSED_SQL}) GROUP BY 1, 2) q ON q.basin = b.basin AND q.cls = c.cls"""


@query("f7_basin_class_rates", RATES_SQL)
def f7(t):
    return op.basin_rates(classed(t), years(t), BASINS)


CELL_RATES_SQL = f"""SELECT u.cell_id, c.cls, CAST(round_even(count(q.sid)::DOUBLE / years, 2) AS DOUBLE) AS storms_per_year, CAST(round_even(coalesce(sum(q.hurricane), 0)::DOUBLE / years, 2) AS DOUBLE) AS hurricane_per_year
  FROM (SELECT DISTINCT x.cell_id FROM (SELECT DISTINCT sid, {CELL} AS cell_id FROM v_fix) x JOIN ({CLASSED_SQL}) y ON x.sid = y.sid) u CROSS JOIN (SELECT * FROM ({COUNT_SQL}) WHERE years > 0) c
  LEFT JOIN (SELECT x.cell_id, y.sid, y.cls, y.hurricane FROM (SELECT DISTINCT sid, {CELL} AS cell_id FROM v_fix) x JOIN ({CLASSED_SQL}) y ON x.sid = y.sid) q ON q.cell_id = u.cell_id AND q.cls = c.cls GROUP BY 1, 2, years"""


@query("f8_cell_class_rates", CELL_RATES_SQL)
def f8(t):
    return op.cell_rates(classed(t), op.storm_cells(t.fix), years(t))


CHECKS = [
    ("genesis further east", "A", "genesis_lon_mean", "el_nino", "neutral", 2.0),
    ("more hurricanes", "N", "hurricane_per_year", "el_nino", "la_nina", 0.0),
    ("fewer hurricanes", "R", "hurricane_per_year", "la_nina", "el_nino", 0.0),
]


@query(
    "f9_class_contrasts",
    f"""WITH r AS ({RATES_SQL}) SELECT 'genesis further east' AS "check", 'A' AS basin, (SELECT genesis_lon_mean FROM r WHERE basin = 'A' AND cls = 'el_nino') > (SELECT genesis_lon_mean FROM r WHERE basin = 'A' AND cls = 'neutral') + 2 AS ok
    UNION ALL SELECT 'more hurricanes', 'N', (SELECT hurricane_per_year FROM r WHERE basin = 'N' AND cls = 'el_nino') > (SELECT hurricane_per_year FROM r WHERE basin = 'N' AND cls = 'la_nina')
    UNION ALL SELECT 'fewer hurricanes', 'R', (SELECT hurricane_per_year FROM r WHERE basin = 'R' AND cls = 'la_nina') > (SELECT hurricane_per_year FROM r WHERE basin = 'R' AND cls = 'el_nino')""",
)
def f9(t):
    return op.contrast(op.basin_rates(classed(t), years(t), BASINS), CHECKS)


@query(
    "f10_display_rates",
    f"""SELECT cell_id, CASE WHEN nr >= 0.33 THEN er END AS en_rate, CASE WHEN nr >= 0.33 THEN nr END AS neutral_rate FROM (
      SELECT cell_id, max(CASE WHEN cls = 'el_nino' THEN storms_per_year END) AS er, max(CASE WHEN cls = 'neutral' THEN storms_per_year END) AS nr FROM ({CELL_RATES_SQL}) GROUP BY 1)""",
)
def f10(t):
    return op.display_rates(op.cell_rates(classed(t), op.storm_cells(t.fix), years(t)))
