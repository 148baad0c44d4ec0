"""Calendar and season scalars."""

from pyspark.sql import functions as F

from solstice.functions import calendar as c
from solstice.plans import sqltext as s
from solstice.plans.registry import query

# an order's season: starts in the order month and lasts 1 to 12 months, or the whole year
SEASON_TEXT_SQL = f"""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'P' THEN 'All year'
  WHEN o_orderkey % 11 = 10 THEN 'spring' ELSE {s.MONTH_LIST}[month(o_orderdate)] || '-' || {s.MONTH_LIST}[(month(o_orderdate) - 1 + o_orderkey % 11) % 12 + 1] END AS season,
  CAST((o_custkey + o_orderkey) % 12 + 1 AS INT) AS now_month FROM orders"""
MONTHS_SQL = f"""SELECT id, d, season, make_date(year(d), now_month, 15) AS now, CASE WHEN season = 'All year' THEN range(1, 13)
  WHEN season = 'spring' THEN [] ELSE [({s.ring('a', 'i')}) FOR i IN range(0, {s.pmod('b - a', 12)} + 1)] END AS months
  FROM (SELECT *, list_position({s.MONTH_LIST}, season[1:3]) AS a, list_position({s.MONTH_LIST}, season[5:7]) AS b FROM ({SEASON_TEXT_SQL}))"""


def season_rows(t):
    names = c.month_names()
    month = F.month("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "P", "All year")
        .when(F.col("o_orderkey") % 11 == 10, "spring")
        .otherwise(F.concat(F.get(names, month - 1), F.lit("-"), F.get(names, ((month - 1 + F.col("o_orderkey") % 11) % 12).cast("int"))))
    )
    rows = t.spread("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").select(
        F.col("o_orderkey").alias("id"),
        text.alias("season"),
        F.make_date(F.year("o_orderdate"), ((F.col("o_custkey") + F.col("o_orderkey")) % 12 + 1).cast("int"), F.lit(15)).alias("now"),
    )
    return rows.withColumn("months", c.parse_season(F.col("season")))


@query(
    "b6_month_length_rate_to_total",
    """SELECT cell, source, year, month, CAST(day(last_day(make_date(year, month, 1))) AS INT) AS days, value / 1024 * day(last_day(make_date(year, month, 1))) AS month_total FROM v_cube""",
)
def b6(t):
    days = c.days_in_month(F.col("year"), F.col("month"))
    return t.cube.select("cell", "source", "year", "month", days.alias("days"), (F.col("value") / 1024 * days).alias("month_total"))


@query(
    "b7_months_earlier",
    """SELECT o_orderkey AS id, CAST(floor(x / 12) AS INT) AS y, CAST(x % 12 + 1 AS INT) AS m
    FROM (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 - o_orderkey % 30 AS x FROM orders)""",
)
def b7(t):
    idx = c.months_earlier(F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_orderkey") % 30)
    return t.orders.select(F.col("o_orderkey").alias("id"), c.index_year(idx).alias("y"), c.index_month(idx).alias("m"))


@query(
    "b8_months_since_decode",
    """SELECT id, CAST(floor(a / 12) AS INT) AS y_mid, CAST(a % 12 + 1 AS INT) AS m_mid, CAST(floor(b / 12) AS INT) AS y_cut, CAST(b % 12 + 1 AS INT) AS m_cut FROM (
      SELECT o_orderkey AS id, 1960 * 12 + CASE WHEN v % 1 <> 0 THEN CAST(round_even(v - 0.5, 0) AS BIGINT) ELSE CAST(trunc(v) AS BIGINT) END AS a, 1960 * 12 + CAST(trunc(v) AS BIGINT) AS b
      FROM (SELECT o_orderkey, (year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 + (o_orderkey % 4) / 4.0::DOUBLE AS v FROM orders))""",
)
def b8(t):
    v = (F.year("o_orderdate") - 1960) * 12 + F.month("o_orderdate") - 1 + (F.col("o_orderkey") % 4) / F.lit(4.0)
    a, b = c.months_since(F.col("v"), 1960, 1), c.months_since(F.col("v"), 1960, 1, "truncate")
    return t.orders.select(F.col("o_orderkey").alias("id"), v.alias("v")).select(
        "id", c.index_year(a).alias("y_mid"), c.index_month(a).alias("m_mid"), c.index_year(b).alias("y_cut"), c.index_month(b).alias("m_cut")
    )


@query(
    "b9_season_month_totals",
    """SELECT s.k, s.pos, s.month, s.yoff AS year_offset, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem l JOIN v_season s ON month(l_shipdate) = s.month GROUP BY 1,2,3,4""",
)
def b9(t):
    monthly = t.lineitem.groupBy(F.month("l_shipdate").alias("month")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    table = c.season_month_table(t.spark).drop("first_month")
    return monthly.join(F.broadcast(table), "month").select("k", "pos", "month", "year_offset", "n", "qty")


@query("b10_parse_season", f"SELECT id, season, array_to_string(months, ',') AS months FROM ({MONTHS_SQL})")
def b10(t):
    return season_rows(t).select("id", "season", F.concat_ws(",", F.col("months").cast("array<string>")).alias("months"))


@query("b11_season_index", f"SELECT id, CASE WHEN len(months) > 0 THEN CAST((months[(len(months)-1)//2 + 1] + 11) % 12 AS INT) END AS season_index FROM ({MONTHS_SQL})")
def b11(t):
    return season_rows(t).select("id", c.season_index(F.col("months")).cast("int").alias("season_index"))


TIMING_SQL = f"""SELECT id, months, state, sy, CASE WHEN state IN ('now', 'coming', 'passed') THEN CASE WHEN n = 12 THEN sy ELSE (sy * 12 + first - 1 + n - 1) // 12 END END AS ey,
    CASE WHEN state = 'coming' THEN sy * 12 + first - 1 - idx END AS away FROM (
  SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN n = 12 THEN 'now' WHEN hit IS NOT NULL THEN split_part(hit, ':', 2) ELSE 'passed' END AS state,
    CASE WHEN n = 0 THEN NULL WHEN n = 12 THEN y WHEN hit IS NOT NULL THEN CAST(split_part(hit, ':', 1) AS BIGINT) WHEN first > m THEN y ELSE y + 1 END AS sy FROM (
    SELECT *, list_filter([CASE WHEN idx BETWEEN st AND st + n - 1 THEN (st // 12) || ':now' WHEN st > idx AND st - idx <= 6 THEN (st // 12) || ':coming' END
        FOR st IN [(y-1)*12+first-1, y*12+first-1, (y+1)*12+first-1]], lambda x: x IS NOT NULL)[1] AS hit FROM (
      SELECT id, months, len(months) AS n, months[1] AS first, year(now) AS y, month(now) AS m, year(now)*12 + month(now) - 1 AS idx FROM ({MONTHS_SQL}))))"""


@query(
    "b12_season_timing",
    f"SELECT id, state, CAST(sy AS INT) AS start_year, CAST(ey AS INT) AS end_year, CAST(away AS INT) AS months_away FROM ({TIMING_SQL})",
)
def b12(t):
    rows = season_rows(t).withColumn("timing", c.season_timing(F.col("months"), F.col("now")))
    return rows.select("id", "timing.state", "timing.start_year", "timing.end_year", "timing.months_away")


@query(
    "b13_season_year_months",
    f"""SELECT id, CASE WHEN sy IS NULL THEN '' ELSE array_to_string([format('{{}}-{{:02d}}', (sy*12+months[1]-1+i) // 12, (sy*12+months[1]-1+i) % 12 + 1) FOR i IN range(len(months))], ',') END AS yms
    FROM ({TIMING_SQL})""",
)
def b13(t):
    rows = season_rows(t).withColumn("start", c.season_timing(F.col("months"), F.col("now"))["start_year"])
    return rows.select("id", F.concat_ws(",", c.season_year_months(F.col("months"), F.col("start"))).alias("yms"))


@query(
    "b14_event_year",
    """SELECT o_orderkey AS id, CAST(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS anchor,
    CAST(CASE WHEN o_orderkey % 12 + 1 >= 7 THEN 0 ELSE 1 END + CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS season_start FROM orders""",
)
def b14(t):
    anchor = c.event_year(F.year("o_orderdate"), F.month("o_orderdate"))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), anchor.alias("anchor"), c.season_start_year(anchor, F.col("o_orderkey") % 12 + 1).alias("season_start")
    )


@query(
    "b15_circular_month_range",
    f"""SELECT id, CASE WHEN b IS NULL THEN '' ELSE array_to_string([{s.ring('a', 'i')} FOR i IN range(0, {s.pmod('b - a', 12)} + 1)], ',') END AS months
    FROM (SELECT o_orderkey AS id, month(o_orderdate) AS a, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey % 12 + 1 END AS b FROM orders)""",
)
def b15(t):
    b = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 12 + 1)
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat_ws(",", c.month_range(F.month("o_orderdate"), b).cast("array<string>")).alias("months")
    )


# run around the anchor: the months between the nearest missing month before and after it on a three-year line
@query(
    "b16_circular_run",
    """WITH m AS (SELECT o_custkey AS cust, CAST(month(o_orderdate) AS INT) AS mo FROM orders GROUP BY 1, 2),
    c AS (SELECT cust, list(mo) AS months, min(mo) AS anchor FROM m GROUP BY 1),
    g AS (SELECT cust, anchor, len(months) AS n, (SELECT max(x) FROM range(anchor - 11, anchor) r(x) WHERE NOT list_contains(months, CAST((x + 11) % 12 + 1 AS INT))) AS lo,
            (SELECT min(x) FROM range(anchor + 1, anchor + 12) r(x) WHERE NOT list_contains(months, CAST((x - 1) % 12 + 1 AS INT))) AS hi FROM c)
    SELECT cust, CAST(anchor AS INT) AS anchor, array_to_string(CASE WHEN n = 12 THEN [(x - 1) % 12 + 1 FOR x IN range(anchor, anchor + 12)]
      ELSE [(x + 11) % 12 + 1 FOR x IN range(lo + 1, hi)] END, ',') AS run FROM g""",
)
def b16(t):
    months = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(F.collect_set(F.month("o_orderdate")).alias("months"))
    rows = months.withColumn("anchor", F.array_min("months"))
    run = c.circular_run(F.col("months"), F.col("anchor"))
    return rows.select("cust", "anchor", F.concat_ws(",", run.cast("array<string>")).alias("run"))


@query(
    "b17_latest_weekly_map",
    """SELECT o_orderkey AS id, CAST(CAST(d AS DATE) - CAST((dow + 6) % 7 + CASE WHEN dow = 2 THEN 7 ELSE 0 END AS INT) AS DATE) AS map_date
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, (dayofweek(o_orderdate) + 6) % 7 AS dow FROM orders)""",
)
def b17(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), c.latest_weekly_map(F.to_date("o_orderdate")).alias("map_date"))


@query(
    "b18_season_label",
    f"""SELECT id, CASE WHEN len(months) = 0 THEN '' WHEN len(months) = 12 THEN 'all year' ELSE {s.MONTH_LIST}[months[1]] || '–' || {s.MONTH_LIST}[months[-1]] ||
      CASE WHEN sy IS NULL THEN '' WHEN sy = ey THEN ' ' || sy ELSE ' ' || sy || '-' || substr(CAST(ey AS VARCHAR), 3) END END AS label FROM ({TIMING_SQL})""",
)
def b18(t):
    rows = season_rows(t).withColumn("tm", c.season_timing(F.col("months"), F.col("now")))
    return rows.select("id", c.season_label(F.col("months"), F.col("tm.start_year"), F.col("tm.end_year")).alias("label"))


@query(
    "b19_event_label",
    """SELECT o_orderkey AS id, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || substr(CAST(b AS VARCHAR), 3) END AS label
    FROM (SELECT o_orderkey, year(o_orderdate) AS a, year(o_orderdate) + o_orderkey % 3 AS b FROM orders)""",
)
def b19(t):
    y = F.year("o_orderdate")
    return t.orders.select(F.col("o_orderkey").alias("id"), c.event_label(y, y + F.col("o_orderkey") % 3).alias("label"))
