"""Quality gates, freshness and registry."""

from pyspark.sql import functions as F

from solstice.operators import gates as op
from solstice.plans.queries import cube as cube_q
from solstice.plans.queries.text import BULLETIN, PARSED_SQL, bulletins
from solstice.plans.registry import query


@query(
    "l1_range_gates",
    """SELECT 'range of ' || c AS gate, v AS value, v = 0 AS ok FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS c,
    unnest([count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50), count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.08), count(*) FILTER (NOT l_extendedprice BETWEEN 1000 AND 90000)])::DOUBLE AS v FROM lineitem)""",
)
def l1(t):
    bounds = {"l_quantity": (1, 50), "l_discount": (0, 0.08), "l_extendedprice": (1000, 90000)}
    return op.range_gates(t.lineitem, bounds).select("gate", "value", "ok")


@query(
    "l2_size_gates",
    """SELECT 'countries' AS gate, count(*)::DOUBLE AS value, count(*) BETWEEN 20 AND 30 AS ok FROM nation UNION ALL SELECT 'cells', count(DISTINCT l_suppkey), count(DISTINCT l_suppkey) >= 50 FROM lineitem
    UNION ALL SELECT 'total', sum(l_quantity), sum(l_quantity) BETWEEN 1000 AND 2000 FROM lineitem""",
)
def l2(t):
    return op.union_gates(
        op.size_gate(t.nation, "countries", 20, 30), op.size_gate(t.lineitem.select("l_suppkey").distinct(), "cells", 50, 1e12),
        op.size_gate(t.lineitem, "total", 1000, 2000, F.sum("l_quantity")),
    ).select("gate", "value", "ok")


@query("l3_count_drop", "SELECT 'orders' AS gate, count(*)::DOUBLE AS value, count(*) >= 0.9 * (SELECT count(*) FROM lineitem) AS ok FROM orders")
def l3(t):
    return op.count_drop(t.orders, t.lineitem.agg(F.count("*").alias("count")), "orders").select("gate", "value", "ok")


CHECK_SQL = "SELECT s_name AS name, s_suppkey AS cell, 'en' AS phase, CAST(s_nationkey % 12 AS INT) AS k, CASE WHEN s_acctbal > 3000 THEN 'wetter' ELSE 'drier' END AS expect, s_suppkey % 5 <> 0 AS required FROM supplier"


def checks(t):
    return t.supplier.selectExpr(
        "s_name AS name", "s_suppkey AS cell", "'en' AS phase", "s_nationkey % 12 AS k", "CASE WHEN s_acctbal > 3000 THEN 'wetter' ELSE 'drier' END AS expect", "s_suppkey % 5 <> 0 AS required"
    )


@query(
    "l4_direction_checks",
    f"SELECT c.name, c.expect, c.required, f.pct IS NOT NULL AND (f.pct > 0) = (c.expect = 'wetter') AS ok FROM ({CHECK_SQL}) c LEFT JOIN ({cube_q.fact_sql(cube_q.anomaly_sql())}) f ON f.cell = c.cell AND f.phase = c.phase AND f.k = c.k",
)
def l4(t):
    return op.direction_checks(cube_q.d12(t), checks(t), ["cell", "phase", "k"]).select("name", "expect", "required", "ok")


@query(
    "l5_named_event_checks",
    f"""SELECT c.name, s.source, e.label, c.expect, f.pct IS NOT NULL AND (f.pct > 0) = (c.expect = 'wetter') AS ok FROM ({CHECK_SQL}) c CROSS JOIN (VALUES (1, '1996-97'), (2, '1998-99')) e(ord, label)
    CROSS JOIN (VALUES ('a'), ('b')) s(source) LEFT JOIN ({cube_q.anomaly_sql()}) f ON f.source = s.source AND f.cell = c.cell AND f.phase = c.phase AND f.k = c.k AND f.ord = e.ord""",
)
def l5(t):
    label = F.when(F.col("ord") == 1, "1996-97").when(F.col("ord") == 2, "1998-99")
    events = cube_q.anomalies(t).withColumn("label", label).where("label IS NOT NULL")
    named = checks(t).withColumn("label", F.explode(F.array(F.lit("1996-97"), F.lit("1998-99")))).withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return op.direction_checks(events, named, ["source", "cell", "phase", "k", "label"]).select("name", "source", "label", "expect", "ok")


@query("l6_label_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def l6(t):
    return op.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


NOW = "2001-10-01 00:00:00"


@query(
    "l7_freshness_report",
    f"""SELECT m.layer, CAST(floor(date_diff('second', as_of, TIMESTAMP '{NOW}') / 86400 + 0.5) AS BIGINT) AS age_days, CAST(max_days AS INT) AS max_days, CASE WHEN as_of IS NOT NULL THEN floor(date_diff('second', as_of, TIMESTAMP '{NOW}') / 86400 + 0.5) > max_days END AS stale
    FROM (VALUES ('1-URGENT', 45), ('2-HIGH', 60), ('3-MEDIUM', 62), ('absent', 400)) m(layer, max_days) LEFT JOIN (SELECT o_orderpriority AS layer, max(o_orderdate) AS as_of FROM orders GROUP BY 1) l ON l.layer = m.layer""",
)
def l7(t):
    layers = t.orders.groupBy(F.col("o_orderpriority").alias("layer")).agg(F.max("o_orderdate").alias("as_of"), F.lit(False).alias("missing"))
    limits = t.spark.createDataFrame([("1-URGENT", 45), ("2-HIGH", 60), ("3-MEDIUM", 62), ("absent", 400)], "layer STRING, max_days INT")
    return op.freshness(layers, limits, NOW).select("layer", "age_days", "max_days", "stale")


@query(
    "l8_bulletin_problems",
    f"""SELECT id, concat_ws('; ', CASE WHEN issued IS NULL THEN 'issued date missing' END, CASE WHEN status IS NULL THEN 'status line missing' END, CASE WHEN synopsis IS NULL OR length(synopsis) < 20 THEN 'synopsis missing' END,
    CASE WHEN headline_probability_pct > 100 THEN 'probability out of bounds' END) AS problems FROM ({PARSED_SQL})""",
)
def l8(t):
    return op.bulletin_problems(bulletins(t)).select("id", F.array_join("problems", "; ").alias("problems"))


@query("l9_non_finite_values", "SELECT 'l_quantity' AS \"column\", 0::BIGINT AS n, true AS ok UNION ALL SELECT 'ratio', count(*) FILTER (l_discount = 0), count(*) FILTER (l_discount = 0) = 0 FROM lineitem")
def l9(t):
    ratio = F.when(F.col("l_discount") == 0, F.when(F.col("l_linenumber") > 3, float("nan")).otherwise(float("inf"))).otherwise(F.col("l_tax"))
    return op.non_finite(t.lineitem.select("l_quantity", ratio.alias("ratio")))


@query(
    "l10_grid_difference",
    """WITH a AS (SELECT DISTINCT cell, month, year FROM v_cube WHERE source = 'a'), b AS (SELECT DISTINCT cell, month, year FROM v_cube WHERE source = 'b')
    SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def l10(t):
    points = t.cube.select("source", "cell", "month", "year")
    return op.grid_difference(points.where("source = 'a'").drop("source"), points.where("source = 'b'").drop("source"))


@query(
    "l11_period_and_sample_gates",
    f"""SELECT p.source, CAST(date_diff('day', latest, DATE '2002-02-15') AS INT) AS age_days, date_diff('day', latest, DATE '2002-02-15') <= 120 AS fresh, samples, samples >= 4 AS enough
    FROM (SELECT source, max(make_date(year, month, 1)) AS latest FROM v_cube GROUP BY 1) p JOIN (SELECT source, min(n) AS samples FROM ({cube_q.CLIM}) GROUP BY 1) s ON s.source = p.source""",
)
def l11(t):
    period = op.latest_period_gate(t.cube, "2002-02-15").select("source", "age_days", F.col("ok").alias("fresh"))
    return period.join(op.sample_gate(cube_q.clim(t), 4).withColumnRenamed("ok", "enough"), "source")


@query(
    "l12_dataset_registry",
    "SELECT 'nation' AS layer, n_name AS name, CAST(n_regionkey AS VARCHAR) AS version, NULL AS licence FROM nation UNION ALL SELECT 'supplier', s_name, NULL, 'open' FROM supplier UNION ALL SELECT 'region', r_name, NULL, NULL FROM region",
)
def l12(t):
    return op.registry(
        t.nation.selectExpr("'nation' AS layer", "n_name AS name", "CAST(n_regionkey AS STRING) AS version"),
        t.supplier.selectExpr("'supplier' AS layer", "s_name AS name", "'open' AS licence"),
        t.region.selectExpr("'region' AS layer", "r_name AS name"),
    )


@query("l13_stale_after", f"SELECT id, CAST(coalesce(try_strptime(issued, '%d %B %Y'), TIMESTAMP '{NOW}') + INTERVAL 45 DAY AS DATE) AS stale_after FROM ({PARSED_SQL})")
def l13(t):
    return bulletins(t).select("id", F.to_date(op.stale_after(F.col("issued"), NOW)).alias("stale_after"))


@query(
    "l15_partial_failure",
    """WITH m AS (SELECT *, CASE WHEN value < 0.2 THEN 'too small' WHEN value > 60 THEN 'too large' END AS p FROM events), b AS (SELECT user_id, count(*) AS n FROM m WHERE p IS NOT NULL GROUP BY 1)
    SELECT 'good rows' AS kind, count(*) AS n FROM m WHERE p IS NULL AND user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT 'bad units', count(*) FROM b UNION ALL SELECT 'bad rows', coalesce(CAST(sum(n) AS BIGINT), 0) FROM b""",
)
def l15(t):
    good, bad = op.quarantine(t.events, "user_id", F.when(F.col("value") < 0.2, "too small").when(F.col("value") > 60, "too large"))
    kept = good.agg(F.count("*").alias("n")).select(F.lit("good rows").alias("kind"), "n")
    units = bad.agg(F.count("*").alias("n")).select(F.lit("bad units").alias("kind"), "n")
    rows = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("bad rows").alias("kind"), "n")
    return kept.unionByName(units).unionByName(rows)
