"""Cube statistics and regridding (D1-D17, and A10, L14 which share the inputs)."""

from pyspark.sql import functions as F

from solstice.functions import grid as g
from solstice.functions.joins import dim_join
from solstice.operators import cube as op
from solstice.operators import running
from solstice.plans import sqltext as s
from solstice.plans.registry import query
from solstice.sources.scratch import scratch_dir, stored

BASE = (1996, 2000)
# Analysed events per phase (ordinal, phase, July-June anchor year).
EVENTS = [(1, "en", 1996), (2, "en", 1998), (3, "en", 1999), (1, "ln", 1995), (2, "ln", 1997), (3, "ln", 2000)]


def event_rows(t):
    return t.spark.createDataFrame(EVENTS, "ord INT, phase STRING, anchor INT")


CLIM = "SELECT source, cell, month, avg(value) AS clim, count(*) AS n FROM v_cube WHERE year BETWEEN 1996 AND 2000 GROUP BY 1,2,3"
EARLY = "SELECT DISTINCT year, month FROM v_cube WHERE source = 'a' ORDER BY year, month LIMIT 24"
CHOICE = f"""SELECT c.cell, CASE WHEN f.n = 12 AND v.cell IS NOT NULL THEN 'a' ELSE 'b' END AS source FROM (SELECT DISTINCT cell FROM v_cube) c
  LEFT JOIN (SELECT cell, count(*) AS n FROM ({CLIM}) WHERE source = 'a' GROUP BY 1) f ON f.cell = c.cell
  LEFT JOIN (SELECT DISTINCT x.cell FROM v_cube x JOIN ({EARLY}) e ON e.year = x.year AND e.month = x.month WHERE x.source = 'a' AND x.value IS NOT NULL) v ON v.cell = c.cell"""


def totals_sql(shift: int = 0) -> str:
    season = "v_season" if shift == 0 else (
        "(SELECT CAST(k AS INT) AS k, CAST((k+p+10)%12+1 AS INT) AS month, CAST((k+10)%12+1 AS INT) AS first_month,"
        " CASE WHEN (k+p+10)%12+1 < (k+10)%12+1 THEN 1 ELSE 0 END AS yoff FROM range(12) a(k), range(3) b(p))"
    )
    return f"""SELECT source, cell, phase, ord, s.k, sum(value) AS tot, count(*) AS n FROM v_event e CROSS JOIN {season} s
  JOIN v_cube c ON c.month = s.month AND c.year = e.anchor + CASE WHEN s.first_month >= 7 THEN 0 ELSE 1 END + s.yoff GROUP BY 1,2,3,4,5"""


def normals_sql(shift: int = 0) -> str:
    season = "v_season" if shift == 0 else "(SELECT k, (k+p+10)%12+1 AS month FROM range(12) a(k), range(3) b(p))"
    return f"SELECT source, cell, s.k, round(sum(clim), 9) AS normal, count(*) AS n FROM ({CLIM}) c JOIN {season} s ON s.month = c.month GROUP BY 1,2,3 HAVING count(*) = 3"


def anomaly_sql(shift: int = 0) -> str:
    return f"""SELECT t.source, t.cell, t.phase, t.ord, CAST(t.k AS INT) AS k, CASE WHEN t.n = 3 AND m.normal > 5 THEN greatest(-100.0::DOUBLE, least(300.0::DOUBLE, (tot / normal - 1) * 100)) END AS pct
  FROM ({totals_sql(shift)}) t JOIN ({normals_sql(shift)}) m ON m.source = t.source AND m.cell = t.cell AND m.k = t.k"""


def fact_sql(anomaly: str, digits: int = 4) -> str:
    return f"""SELECT a.cell, a.source, phase, k, CASE WHEN count(pct) >= 3 THEN round(avg(pct), {digits}) + 0.0::DOUBLE END AS pct, CASE WHEN count(pct) >= 3 THEN round(100 * avg(CASE WHEN pct > 0 THEN 1.0::DOUBLE WHEN pct IS NOT NULL THEN 0 END), {digits}) END AS wetter_frac,
  CASE WHEN count(pct) >= 3 THEN round(stddev_pop(pct), {digits}) END AS std, count(pct) AS n FROM ({anomaly}) a JOIN ({CHOICE}) c ON c.cell = a.cell AND c.source = a.source GROUP BY 1,2,3,4"""


def dense_sql(anomaly: str) -> str:
    """Every cell with its source, phase and season."""
    return f"""SELECT c.cell, c.source, p.phase, CAST(q.k AS INT) AS k, f.pct, f.wetter_frac, f.std, coalesce(f.n, 0) AS n FROM ({CHOICE}) c CROSS JOIN (SELECT DISTINCT phase FROM v_event) p CROSS JOIN range(12) q(k)
  LEFT JOIN ({fact_sql(anomaly)}) f ON f.cell = c.cell AND f.source = c.source AND f.phase = p.phase AND f.k = q.k"""


def placed(t):
    return op.by_cell(t.cube)


def clim(t):
    return op.climatology(placed(t), *BASE)


def anomalies(t, shift=0):
    cube = placed(t)
    return op.event_anomalies(cube, op.climatology(cube, *BASE), op.event_months(t.spark, event_rows(t), shift), shift)


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "a10_cube_ingest",
    """SELECT source, cell, y AS year, m AS month, max(CASE WHEN v BETWEEN 0 AND 45 THEN v END) AS value FROM (
      SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS source, l_suppkey AS cell, l_quantity - 2 AS v,
        CAST(year(l_shipdate) AS INT) AS y, CAST(month(l_shipdate) AS INT) AS m FROM lineitem) GROUP BY 1,2,3,4""",
)
def a10(t):
    from solstice.sources.readers import decode_cube

    raw = t.lineitem.selectExpr(
        "CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS source", "l_suppkey AS cell", "l_quantity - 2 AS value",
        "(year(l_shipdate) - 1960) * 12 + month(l_shipdate) - 0.5D AS t",
    )
    return op.monthly_cube(decode_cube(raw, 1960, 1), 0.0, 45.0)


@query("d1_range_mask", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS value FROM lineitem")
def d1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", op.mask_range(F.col("l_quantity"), 5.0, 45.0).alias("value"))


COARSE = (-85.0, 10.0, 18, 5.0, 10.0, 36)
COARSE_SQL = """SELECT CAST(floor((lat + 90) / 10) AS INT) AS si, CAST(floor((CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 10) AS INT) AS sj, round(sum(floor(w)) / count(*), 6) AS value FROM v_point GROUP BY 1, 2"""
LON360 = "(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END)"


def coarse(t):
    """Mean of the points per 10-degree source cell."""
    return t.point.groupBy(
        F.floor((F.col("lat") + 90) / 10).cast("int").alias("si"), F.floor(g.lon_360(F.col("lon")) / 10).cast("int").alias("sj")
    ).agg(F.round(F.sum(F.floor("w")) / F.count("*"), 6).alias("value"))


@query(
    "d2_bilinear_regrid",
    f"""WITH src AS ({COARSE_SQL}), b AS (SELECT cell_id, y, x, greatest(0, least(16, ceil(y) - 1)) AS i0, greatest(0, least(35, ceil(x) - 1)) AS j0
      FROM (SELECT cell_id, (lat + 85) / 10 AS y, ({LON360} - 5) / 10 AS x FROM v_grid)),
    f AS (SELECT cell_id, i0, j0, greatest(0, least(1, y - i0)) AS ly, greatest(0, least(1, x - j0)) AS lx FROM b),
    k AS (SELECT cell_id, i0 + di AS si, (j0 + dj) % 36 AS sj, (CASE WHEN di = 1 THEN ly ELSE 1 - ly END) * (CASE WHEN dj = 1 THEN lx ELSE 1 - lx END) AS w FROM f, range(2) a(di), range(2) c(dj))
    SELECT cell_id, CASE WHEN count(value) = 4 THEN round(sum(w * value), 4) END AS value FROM k JOIN src ON src.si = k.si AND src.sj = k.sj GROUP BY 1""",
)
def d2(t):
    weights = op.bilinear_weights(g.target_grid(t.spark), *COARSE)
    return rounded(op.bilinear_regrid(coarse(t), weights), "value")


@query(
    "d3_nearest_regrid",
    f"""WITH src AS ({COARSE_SQL}) SELECT cell_id, value FROM src JOIN (SELECT cell_id, greatest(0, least(17, ceil((lat + 85) / 10 - 0.5))) AS si, greatest(0, least(35, ceil(({LON360} - 5) / 10 - 0.5))) AS sj FROM v_grid) c
    ON src.si = c.si AND src.sj = c.sj""",
)
def d3(t):
    cells = g.target_grid(t.spark).withColumn("lon", g.lon_360(F.col("lon")))
    return op.nearest_regrid(coarse(t), cells, *COARSE)


@query(
    "d4_coverage_flag",
    """WITH m AS (SELECT source, year, month FROM (SELECT DISTINCT source, year, month FROM v_cube) QUALIFY row_number() OVER (PARTITION BY source ORDER BY year * 12 + month) <= 24)
    SELECT c.source, c.cell, bool_or(value IS NOT NULL) AS covered FROM v_cube c JOIN m ON m.source = c.source AND m.year = c.year AND m.month = c.month GROUP BY 1, 2""",
)
def d4(t):
    return op.coverage(t.cube)


@query("d5_climatology", f"SELECT source, cell, month, round(clim, 6) AS clim, n FROM ({CLIM})")
def d5(t):
    return rounded(clim(t), "clim", digits=6)


@query("d6_source_selection", CHOICE)
def d6(t):
    cells = placed(t).select("cell").distinct()
    return op.choose_source(clim(t), "a", "b", cells=cells, covered=op.coverage(t.cube))


@query("d7_season_totals", f"SELECT source, cell, phase, ord, CAST(k AS INT) AS k, CASE WHEN n = 3 THEN tot END AS total, n FROM ({totals_sql()})")
def d7(t):
    return op.season_totals(placed(t), op.event_months(t.spark, event_rows(t)))


@query("d8_percent_anomaly", f"SELECT source, cell, phase, ord, k, round(pct, 4) AS pct FROM ({anomaly_sql()})")
def d8(t):
    return rounded(anomalies(t), "pct")


@query(
    "d9_composite_all_sources",
    fact_sql(anomaly_sql()).replace(f" JOIN ({CHOICE}) c ON c.cell = a.cell AND c.source = a.source", ""),
)
def d9(t):
    return rounded(op.composite(anomalies(t), ("cell", "source", "phase", "k"), digits=None), "pct", "wetter_frac", "std")


@query("d9_running_composite", fact_sql(anomaly_sql()).replace(f" JOIN ({CHOICE}) c ON c.cell = a.cell AND c.source = a.source", ""))
def d9_running(t):
    """The same composites from sums to which the last months were added one after the other."""
    root, months = scratch_dir(t.spark, "running"), op.event_months(t.spark, event_rows(t))
    # the line items are gathered once, for either table of every update
    cube = stored(t.cube, "running-cube")
    at = F.col("year") * 12 + F.col("month") - 2000 * 12
    for i, cut in enumerate((at <= 10, at == 11, at >= 12)):
        running.add_months(cube.where(cut), root, months, *BASE, run_id=f"{i:04d}", n_parts=8)
    found = op.composite(running.anomalies(t.spark, root), ("cell", "source", "phase", "k"), digits=None)
    return rounded(found, "pct", "wetter_frac", "std")


VECTOR = f"""SELECT g.source, g.cell, g.phase, g.k, string_agg(coalesce(CAST(CAST(round_even(a.pct, 0) AS INT) AS VARCHAR), '-'), ',' ORDER BY e.ord) AS events,
  string_agg(coalesce(CAST(CAST(round_even(a.pct, 0) AS INT) AS VARCHAR), '-'), ',' ORDER BY e.ord) FILTER (e.ord > 3 - 3) AS recent
  FROM (SELECT DISTINCT source, cell, phase, k FROM ({anomaly_sql()})) g JOIN v_event e ON e.phase = g.phase
  LEFT JOIN ({anomaly_sql()}) a ON a.source = g.source AND a.cell = g.cell AND a.phase = g.phase AND a.k = g.k AND a.ord = e.ord GROUP BY 1,2,3,4"""


def _vectors(t):
    return op.event_vectors(anomalies(t), event_rows(t), ("source", "cell", "phase", "k"))


def joined(col):
    return F.array_join(F.transform(F.col(col).cast("array<int>"), lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


@query("d10_event_vectors", f"SELECT source, cell, phase, k, events FROM ({VECTOR})")
def d10(t):
    return _vectors(t).select("source", "cell", "phase", "k", joined("events").alias("events"))


@query("d11_recent_events", f"SELECT source, cell, phase, k, recent FROM ({VECTOR})")
def d11(t):
    return _vectors(t).select("source", "cell", "phase", "k", joined("recent").alias("recent"))


@query("d12_composite_fact", dense_sql(anomaly_sql()))
def d12(t):
    fact = op.composite_fact(t.cube, event_rows(t), *BASE, primary="a", fallback="b", digits=None)
    return rounded(fact, "pct", "wetter_frac", "std")


@query("d12_composite_fact_shifted_months", dense_sql(anomaly_sql(-1)))
def d12_shifted(t):
    """Seasons that start one month before their label, as the published figures do."""
    fact = op.composite_fact(t.cube, event_rows(t), *BASE, primary="a", fallback="b", month_shift=-1, digits=None)
    return rounded(fact, "pct", "wetter_frac", "std")


def recent_sql(strict: bool) -> str:
    gate = "AND r.n = 3 AND q.n = 3" if strict else ""
    return f"""SELECT r.source, r.cell, greatest(0.0::DOUBLE, least(500.0::DOUBLE, CAST(round_even(100.0::DOUBLE * total / normal, 0) AS DOUBLE))) AS pct
  FROM (SELECT c.source, c.cell, sum(value) AS total, count(*) AS n FROM v_cube c JOIN m ON m.source = c.source AND m.year = c.year AND m.month = c.month GROUP BY 1, 2) r
  JOIN (SELECT c.source, c.cell, sum(clim) AS normal, count(*) AS n FROM ({CLIM}) c JOIN m ON m.source = c.source AND m.month = c.month GROUP BY 1, 2) q ON q.source = r.source AND q.cell = r.cell
  WHERE normal > 15 {gate}"""


@query(
    "d13_recent_share_of_normal",
    f"""WITH m AS (SELECT source, year, month FROM (SELECT DISTINCT source, year, month FROM v_cube) QUALIFY row_number() OVER (PARTITION BY source ORDER BY year * 12 + month DESC) <= 3)
    SELECT b.source, b.cell, a.pct AS pct_complete, b.pct AS pct_of_normal FROM ({recent_sql(False)}) b LEFT JOIN ({recent_sql(True)}) a ON a.source = b.source AND a.cell = b.cell""",
)
def d13(t):
    cube = placed(t)
    return op.recent_share(cube, op.climatology(cube, *BASE))


FORECAST_ROWS = "SELECT place, ym // 100 AS season_year, ym, anomaly, mean FROM v_forecast WHERE ym % 100 IN (10, 11, 12)"


def seasonal_forecast(t):
    """The October-December forecast of every place and year."""
    rows = t.forecast.withColumn("season_year", F.floor(F.col("ym") / 100).cast("int")).where(F.pmod("ym", F.lit(100)).isin(10, 11, 12))
    return op.forecast_reduction(rows, ["place", "season_year"], 3)


@query(
    "d14_forecast_reduction",
    f"""SELECT place, season_year, CAST(greatest(-100, least(300, raw)) AS INT) AS pct, raw > 300 AS capped, CAST(n_months AS INT) AS n_months, CAST(3 AS INT) AS of_months, CAST(floor(normal + 0.5) AS BIGINT) AS normal_mm, CAST(floor(anom + 0.5) AS BIGINT) AS anomaly_mm
    FROM (SELECT *, floor(100 * anom / normal + 0.5) AS raw FROM (SELECT place, season_year, sum(anomaly) AS anom, sum(mean) - sum(anomaly) AS normal, count(*) AS n_months FROM ({FORECAST_ROWS}) GROUP BY 1, 2) WHERE normal >= 10)""",
)
def d14(t):
    return seasonal_forecast(t).drop("monthly")


@query(
    "d15_monthly_breakdown",
    f"""SELECT place, season_year, string_agg(ym || ':' || coalesce(CAST(p AS VARCHAR), '-'), ',' ORDER BY ym) AS monthly FROM (
      SELECT *, CASE WHEN mean - anomaly >= 5 THEN CAST(greatest(-100, least(300, floor(100 * anomaly / (mean - anomaly) + 0.5))) AS INT) END AS p FROM ({FORECAST_ROWS})) GROUP BY 1, 2 HAVING sum(mean) - sum(anomaly) >= 10""",
)
def d15(t):
    text = F.transform("monthly", lambda m: F.concat(m["ym"].cast("string"), F.lit(":"), F.coalesce(m["pct"].cast("string"), F.lit("-"))))
    return seasonal_forecast(t).select("place", "season_year", F.array_join(text, ",").alias("monthly"))


LEAD_SQL = """SELECT l_linenumber AS lead, CAST(floor(((l_partkey*7919) % 18000) / 1000) AS INT) AS si, CAST(floor(((l_suppkey*104729 + l_orderkey) % 36000) / 1000) AS INT) AS sj,
  CASE WHEN sum(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) > 0 THEN (sum(l_quantity) / count(*) - 25) / 997 END AS value FROM lineitem GROUP BY 1, 2, 3"""


def lead_slices(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy(
        F.col("l_linenumber").alias("lead"),
        F.floor((F.col("l_partkey") * 7919) % 18000 / 1000).cast("int").alias("si"),
        F.floor((F.col("l_suppkey") * 104729 + F.col("l_orderkey")) % 36000 / 1000).cast("int").alias("sj"),
    ).agg(F.when(F.max(q) > 10, (F.sum(q) / F.count("*") - 25) / 997).alias("value"))


@query(
    "d16_lead_grid_reduction",
    f"""WITH src AS ({LEAD_SQL}), ok AS (SELECT lead FROM src GROUP BY 1 HAVING avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AND coalesce(max(abs(value)), 0) < 1.0)
    SELECT src.lead, cell_id, CAST(format('{{:.3e}}', value) AS DOUBLE) AS anomaly FROM src JOIN ok ON ok.lead = src.lead
    JOIN (SELECT cell_id, greatest(0, least(17, ceil((lat + 85) / 10 - 0.5))) AS si, greatest(0, least(35, ceil(({LON360} - 5) / 10 - 0.5))) AS sj FROM v_grid) c ON src.si = c.si AND src.sj = c.sj""",
)
def d16(t):
    from solstice.operators import gates
    from solstice.sources.sinks import significant

    slices = lead_slices(t)
    cells = g.target_grid(t.spark).withColumn("lon", g.lon_360(F.col("lon")))
    passed = dim_join(slices, gates.usable_slices(slices, ["lead"]), "lead", "left_semi")
    return op.nearest_regrid(passed, cells, *COARSE).select("lead", "cell_id", significant(F.col("value"), 3).alias("anomaly"))


@query(
    "d17_climatology_vector",
    f"""SELECT g.source, g.cell, string_agg(coalesce(CAST(CAST(round_even(c.clim, 0) AS INT) AS VARCHAR), '-'), ',' ORDER BY m) AS clim_month
    FROM (SELECT DISTINCT source, cell FROM ({CLIM})) g CROSS JOIN range(1, 13) r(m) LEFT JOIN ({CLIM}) c ON c.source = g.source AND c.cell = g.cell AND c.month = m GROUP BY 1, 2""",
)
def d17(t):
    return op.climatology_vector(clim(t)).select("source", "cell", joined("clim_month").alias("clim_month"))


@query(
    "l14_finite_share_of_slice",
    f"SELECT lead, round(avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS finite_share, coalesce(max(abs(value)), 0) < 1.0 AND avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS ok FROM ({LEAD_SQL}) GROUP BY 1",
)
def l14(t):
    from solstice.operators import gates

    return rounded(gates.slice_quality(lead_slices(t), ["lead"]), "finite_share", digits=6).select("lead", "finite_share", "ok")
