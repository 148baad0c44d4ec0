"""Event detection over index series."""

from pyspark.sql import functions as F

from solstice.operators import series as op
from solstice.plans import sqltext as s
from solstice.plans.registry import query

KEYS = ["key"]
RUN = {"carry": ("year", "month"), "threshold": 0.5, "min_run": 2}

SIGN = "CASE WHEN v >= 0.5 THEN 1 WHEN v <= -0.5 THEN -1 ELSE 0 END"
RUNS_SQL = f"""SELECT key, sign, count(*) AS n, min(pos) AS p0, max(pos) AS p1, arg_min(v, -v * sign * 1000000 + pos / 1000000.0) AS peak, arg_min(pos, -v * sign * 1000000 + pos / 1000000.0) AS pp
  FROM (SELECT *, sum(t) OVER (PARTITION BY key ORDER BY pos) AS isl FROM (SELECT *, CASE WHEN lag(sign) OVER (PARTITION BY key ORDER BY pos) = sign THEN 0 ELSE 1 END AS t
    FROM (SELECT key, pos, v, {SIGN} AS sign FROM v_series))) WHERE sign <> 0 GROUP BY key, sign, isl HAVING count(*) >= 2"""
STRENGTH = "CASE WHEN abs(peak) >= 2 THEN 'very strong' WHEN abs(peak) >= 1.5 THEN 'strong' WHEN abs(peak) >= 1 THEN 'moderate' ELSE 'weak' END"


def _season(p: str) -> str:
    return f"{s.SEASON_LIST}[{p} % 12 + 1] || ' ' || ({p} // 12)"


EVENTS_SQL = f"""SELECT *, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || substr(CAST(b AS VARCHAR), 3) END AS label FROM (
  SELECT key, CASE WHEN sign > 0 THEN 'el_nino' ELSE 'la_nina' END AS type, {_season('p0')} AS start, {_season('p1')} AS "end", p0 // 12 AS a, p1 // 12 AS b,
  peak, {_season('pp')} AS peak_season, CASE WHEN pp % 12 >= 6 THEN pp // 12 ELSE pp // 12 - 1 END AS anchor, {STRENGTH} AS strength, n FROM ({RUNS_SQL}))"""
STRONG_SQL = f"SELECT *, row_number() OVER (PARTITION BY key, type ORDER BY anchor, a, start) AS ord FROM ({EVENTS_SQL}) WHERE strength IN ('strong', 'very strong')"
YEARS_SQL = f"""SELECT k.key, CAST(y AS INT) AS event_year, coalesce(e.type, CASE WHEN q.n = 12 AND q.worst < 4 THEN 'neutral' END, 'other') AS cls
  FROM (SELECT DISTINCT key FROM v_series) k CROSS JOIN range(1994, 2002) r(y)
  LEFT JOIN (SELECT key, CASE WHEN month >= 7 THEN year ELSE year - 1 END AS ey, count(v) AS n, max(abs(v)) AS worst FROM v_series GROUP BY 1, 2) q ON q.key = k.key AND q.ey = y
  LEFT JOIN (SELECT key, anchor, min(type) AS type FROM ({STRONG_SQL}) WHERE abs(peak) >= 5 GROUP BY 1, 2) e ON e.key = k.key AND e.anchor = y"""


def runs(t):
    return op.find_runs(t.series, KEYS, **RUN)


def events(t):
    return op.run_events(runs(t), KEYS)


def strong(t):
    return op.strong_events(events(t), KEYS, first_year=1979)


def years(t):
    # noisy monthly data: only peaks of 5 and more decide a year, and 4 is the neutral limit
    return op.classify_years(t.series, strong(t).where(F.abs("peak_value") >= 5), KEYS, 1994, 2001, threshold=4.0)


@query("c1_sign_classification", f"SELECT key, year, month, CAST({SIGN} AS INT) AS sign FROM v_series")
def c1(t):
    return t.series.select("key", "year", "month", op.sign_of(F.col("v")).alias("sign"))


@query("c2_run_detection", f"SELECT key, CAST(sign AS INT) AS sign, n, p0 AS first_pos, p1 AS last_pos FROM ({RUNS_SQL})")
def c2(t):
    return runs(t).select("key", "sign", "n", F.col("first.pos").alias("first_pos"), F.col("last.pos").alias("last_pos"))


@query("c3_run_peak", f"SELECT key, p0 AS first_pos, pp AS peak_pos, peak FROM ({RUNS_SQL})")
def c3(t):
    return runs(t).select("key", F.col("first.pos").alias("first_pos"), F.col("peak.pos").alias("peak_pos"), F.col("peak.v").alias("peak"))


@query(
    "c4_run_attributes",
    f"""SELECT key, type, start, "end", CAST(a AS INT) AS start_year, CAST(b AS INT) AS end_year, label, peak AS peak_value, peak_season, CAST(anchor AS INT) AS anchor_year,
    anchor || '-' || substr(CAST(anchor + 1 AS VARCHAR), 3) AS analog_label, strength, n AS n_seasons FROM ({EVENTS_SQL})""",
)
def c4(t):
    return events(t)


@query("c5_strength_bins", f"SELECT key, year, month, {STRENGTH.replace('peak', 'v')} AS strength FROM v_series")
def c5(t):
    return t.series.select("key", "year", "month", op.strength(F.col("v")).alias("strength"))


@query("c6_strong_events", f"SELECT key, type, CAST(ord AS INT) AS ord, CAST(anchor AS INT) AS anchor_year, start FROM ({STRONG_SQL})")
def c6(t):
    return strong(t).select("key", "type", "ord", "anchor_year", "start")


@query("c7_year_classes", YEARS_SQL)
def c7(t):
    return years(t)


@query(
    "c8_class_counts",
    f"""SELECT k.key, c.cls, count(y.cls) AS n_years FROM (SELECT DISTINCT key FROM v_series) k CROSS JOIN (VALUES ('el_nino'), ('la_nina'), ('neutral'), ('other')) c(cls)
    LEFT JOIN ({YEARS_SQL}) y ON y.key = k.key AND y.cls = c.cls GROUP BY 1, 2""",
)
def c8(t):
    return op.class_counts(years(t), KEYS)


@query("c9_latest_row", "SELECT key, year, month, v FROM v_series QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1")
def c9(t):
    return op.latest(t.series, KEYS)
