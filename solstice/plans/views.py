"""Domain-shaped views over the driver tables, once for Spark and once as SQL text.

The raw climate and place inputs are not shipped, so every operator is exercised on these
derived tables. They scan whole tables and grow with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.functions.joins import spread


class Tables:
    """Driver tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = table  # later uses skip the file listing
        return table

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a driver table, cut for costly per-row work when it is small."""
        return spread(getattr(self, name).select(*columns))

    @cached_property
    def point(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey AS id", "c_name AS name", "c_nationkey AS nk", "c_mktsegment AS seg", "c_acctbal AS w",
            "CAST((c_custkey*7919) % 17900 AS DOUBLE)/100 - 89.5 AS lat",
            "CAST((c_custkey*104729) % 36000 AS DOUBLE)/100 - 180 AS lon",
        )

    @cached_property
    def cube(self) -> DataFrame:
        return (
            self.lineitem.selectExpr(
                "CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS source", "l_suppkey AS cell",
                "year(l_shipdate) AS year", "month(l_shipdate) AS month", "l_quantity",
            )
            .groupBy("source", "cell", "year", "month")
            .agg(F.sum("l_quantity").alias("value"))
        )

    @cached_property
    def series(self) -> DataFrame:
        """Monthly anomaly series per order priority."""
        month = self.orders.groupBy(
            F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
        ).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
        whole = month.groupBy("key").agg((F.sum("s") / F.sum("n")).alias("mean"))
        return (
            month.join(whole, "key")
            .select("key", "year", "month", F.round((F.col("s") / F.col("n") - F.col("mean")) / 10000, 4).alias("v"))
            .withColumn("pos", (F.col("year") * 12 + F.col("month") - 1).cast("bigint"))
        )

    FIX_COLUMNS = (
        "l_orderkey AS sid", "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS fix_id", "l_shipdate AS ts",
        "l_returnflag AS basin", "CASE WHEN l_linenumber = 3 THEN ' ' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS wmo_wind",
        "CASE WHEN l_discount = 0 THEN '' ELSE CAST(CAST(l_quantity * 2 AS INT) AS STRING) END AS usa_wind",
        "CAST((l_partkey*7919 + l_orderkey) % 12000 AS DOUBLE)/100 - 60 AS lat",
        "CAST((l_suppkey*104729 + l_orderkey*37) % 36000 AS DOUBLE)/100 - 180 AS lon",
    )

    @cached_property
    def fix(self) -> DataFrame:
        return self.lineitem.selectExpr(*self.FIX_COLUMNS)

    @cached_property
    def place(self) -> DataFrame:
        return self.part.selectExpr(
            "p_partkey AS id", "p_name AS name", "p_brand AS cc", "p_type AS a1", "CAST(p_size AS STRING) AS a2",
            "CAST(floor(p_retailprice*p_size*10) AS BIGINT) AS pop",
            "CAST((p_partkey*7919) % 17900 AS DOUBLE)/100 - 89.5 AS lat",
            "CAST((p_partkey*104729) % 36000 AS DOUBLE)/100 - 180 AS lon",
        )

    @cached_property
    def box(self) -> DataFrame:
        """Two boxes per region, so that a point can be in both."""
        return self.nation.selectExpr(
            "n_nationkey AS region_id", "n_name AS name", "n_regionkey AS priority",
            "explode(array(struct(-88 + 7*n_nationkey AS lat0, -60 + 7*n_nationkey AS lat1, -180 + 10*n_nationkey AS lon0, -60 + 10*n_nationkey AS lon1),"
            " struct(-80 + 6*n_nationkey AS lat0, -50 + 6*n_nationkey AS lat1, -90 + 5*n_nationkey AS lon0, 10 + 5*n_nationkey AS lon1))) AS b",
        ).selectExpr("region_id", "name", "priority", *(f"CAST(b.{c} AS DOUBLE) AS {c}" for c in ("lat0", "lat1", "lon0", "lon1")))

    @cached_property
    def edge(self) -> DataFrame:
        return self.nation.selectExpr(
            "n_nationkey AS poly_id", "n_regionkey AS category",
            "explode(array(struct(0.0 AS a, 0.0 AS b, 30.0 AS c, 5.0 AS d), struct(30.0 AS a, 5.0 AS b, 25.0 AS c, 30.0 AS d),"
            " struct(25.0 AS a, 30.0 AS b, 12.0 AS c, 12.0 AS d), struct(12.0 AS a, 12.0 AS b, 0.0 AS c, 0.0 AS d))) AS s",
        ).selectExpr(
            "poly_id", "category", "CAST(-170 + 12*poly_id + s.a AS DOUBLE) AS x1", "CAST(-80 + 6*poly_id + s.b AS DOUBLE) AS y1",
            "CAST(-170 + 12*poly_id + s.c AS DOUBLE) AS x2", "CAST(-80 + 6*poly_id + s.d AS DOUBLE) AS y2",
        )

    @cached_property
    def window(self) -> DataFrame:
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "c_nationkey AS iso", "o_orderpriority AS crop", "o_orderstatus AS zone", "month(o_orderdate) AS a",
            "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST((month(o_orderdate) - 1 + o_orderkey % 4) % 12 + 1 AS INT) END AS b",
            "CASE WHEN c_acctbal > 0 THEN c_nationkey % 12 + 1 ELSE NULL END AS h",
        )

    @cached_property
    def indicator(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_suppkey").alias("iso"), F.col("l_linenumber").alias("ind")).agg(
            (F.avg("l_quantity") / 5).alias("score")
        )

    @cached_property
    def forecast(self) -> DataFrame:
        # whole currency units keep the sums exact in any order
        return self.orders.groupBy(
            F.col("o_custkey").alias("place"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")
        ).agg(
            (F.sum(F.floor("o_totalprice")) / 1024 - 250).alias("anomaly"), (F.sum(F.floor("o_totalprice")) / 512).alias("mean")
        )

    @cached_property
    def rule(self) -> DataFrame:
        """Inputs of the decision rules: phrases, percentages, skill scores and probabilities per order."""
        return self.orders.selectExpr(
            "o_orderkey AS id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'wetter than usual' WHEN '2-HIGH' THEN 'Much drier' WHEN '3-MEDIUM' THEN 'Drier, then wetter' ELSE 'mixed' END AS rain",
            "CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS curated",
            "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) - 250 AS DOUBLE) END AS pct",
            "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0D ELSE CAST(o_custkey % 90 AS DOUBLE) END AS std",
            "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 120 - 60 AS INT) END AS fpct",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS corr",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / 97 END AS roc",
            "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END AS prob",
            "CAST(o_custkey % 101 AS DOUBLE) AS wet", "CAST(1 + o_custkey % 8 AS INT) AS n",
        )

    @cached_property
    def target(self) -> DataFrame:
        """A translated catalog: present, changed and stale keys against ``documents``."""
        kept = self.labels.join(self.documents.select("doc_id", "text"), "doc_id").selectExpr(
            "doc_id AS k", "CASE WHEN quality = 1 THEN substr(sha1(text),1,10) ELSE 'changed000' END AS src_hash", "toxic = 1 AS mt"
        )
        stale = self.labels.where("toxic = 1").selectExpr("doc_id + 1000000000 AS k", "'gone' AS src_hash", "quality = 1 AS mt")
        return kept.unionByName(stale)


# The same views for the SQL side.
SQL: dict[str, str] = {
    "v_point": """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nk, c_mktsegment AS seg, c_acctbal AS w,
  CAST((c_custkey*7919) % 17900 AS DOUBLE)/100 - 89.5 AS lat, CAST((c_custkey*104729) % 36000 AS DOUBLE)/100 - 180 AS lon FROM customer""",
    "v_cube": """SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS source, l_suppkey AS cell, CAST(year(l_shipdate) AS INT) AS year,
  CAST(month(l_shipdate) AS INT) AS month, sum(l_quantity) AS value FROM lineitem GROUP BY 1,2,3,4""",
    "v_series": """SELECT m.key, year, month, round((s / n - mean) / 10000, 4) AS v, CAST(year*12+month-1 AS BIGINT) AS pos
  FROM (SELECT o_orderpriority AS key, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1,2,3) m
  JOIN (SELECT o_orderpriority AS key, sum(o_totalprice)/count(*) AS mean FROM orders GROUP BY 1) w ON m.key = w.key""",
    "v_fix": """SELECT l_orderkey AS sid, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS fix_id, l_shipdate AS ts, l_returnflag AS basin,
  CASE WHEN l_linenumber = 3 THEN ' ' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS wmo_wind,
  CASE WHEN l_discount = 0 THEN '' ELSE CAST(CAST(l_quantity * 2 AS INT) AS VARCHAR) END AS usa_wind,
  CAST((l_partkey*7919 + l_orderkey) % 12000 AS DOUBLE)/100 - 60 AS lat, CAST((l_suppkey*104729 + l_orderkey*37) % 36000 AS DOUBLE)/100 - 180 AS lon FROM lineitem""",
    "v_place": """SELECT p_partkey AS id, p_name AS name, p_brand AS cc, p_type AS a1, CAST(p_size AS VARCHAR) AS a2, CAST(floor(p_retailprice*p_size*10) AS BIGINT) AS pop,
  CAST((p_partkey*7919) % 17900 AS DOUBLE)/100 - 89.5 AS lat, CAST((p_partkey*104729) % 36000 AS DOUBLE)/100 - 180 AS lon FROM part""",
    "v_box": """SELECT n_nationkey AS region_id, n_name AS name, n_regionkey AS priority, CAST(-88 + 7*n_nationkey AS DOUBLE) AS lat0, CAST(-60 + 7*n_nationkey AS DOUBLE) AS lat1,
  CAST(-180 + 10*n_nationkey AS DOUBLE) AS lon0, CAST(-60 + 10*n_nationkey AS DOUBLE) AS lon1 FROM nation
  UNION ALL SELECT n_nationkey, n_name, n_regionkey, -80 + 6*n_nationkey, -50 + 6*n_nationkey, -90 + 5*n_nationkey, 10 + 5*n_nationkey FROM nation""",
    "v_edge": """SELECT n_nationkey AS poly_id, n_regionkey AS category, CAST(-170 + 12*n_nationkey + x1 AS DOUBLE) AS x1, CAST(-80 + 6*n_nationkey + y1 AS DOUBLE) AS y1,
  CAST(-170 + 12*n_nationkey + x2 AS DOUBLE) AS x2, CAST(-80 + 6*n_nationkey + y2 AS DOUBLE) AS y2
  FROM nation CROSS JOIN (VALUES (0.0,0.0,30.0,5.0),(30.0,5.0,25.0,30.0),(25.0,30.0,12.0,12.0),(12.0,12.0,0.0,0.0)) AS t(x1,y1,x2,y2)""",
    "v_window": """SELECT c_nationkey AS iso, o_orderpriority AS crop, o_orderstatus AS zone, CAST(month(o_orderdate) AS INT) AS a,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST((month(o_orderdate) - 1 + o_orderkey % 4) % 12 + 1 AS INT) END AS b,
  CASE WHEN c_acctbal > 0 THEN c_nationkey % 12 + 1 ELSE NULL END AS h FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_indicator": """SELECT l_suppkey AS iso, l_linenumber AS ind, avg(l_quantity)/5 AS score FROM lineitem GROUP BY 1,2""",
    "v_forecast": """SELECT o_custkey AS place, CAST(year(o_orderdate)*100 + month(o_orderdate) AS INT) AS ym, sum(floor(o_totalprice))/1024.0::DOUBLE - 250 AS anomaly,
  sum(floor(o_totalprice))/512.0::DOUBLE AS mean FROM orders GROUP BY 1,2""",
    "v_target": """SELECT l.doc_id AS k, CASE WHEN quality = 1 THEN substr(sha1(d.text),1,10) ELSE 'changed000' END AS src_hash, toxic = 1 AS mt
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  UNION ALL SELECT doc_id + 1000000000 AS k, 'gone' AS src_hash, quality = 1 AS mt FROM labels WHERE toxic = 1""",
    # season k, position p, month, year offset, first month of the season
    "v_season": """SELECT CAST(k AS INT) AS k, CAST(p AS INT) AS pos, CAST((k+p+11)%12+1 AS INT) AS month, CASE WHEN k = 0 THEN 12 ELSE CAST(k AS INT) END AS first_month,
  CASE WHEN (k+p+11)%12+1 < (CASE WHEN k = 0 THEN 12 ELSE k END) THEN 1 ELSE 0 END AS yoff FROM range(12) a(k), range(3) b(p)""",
    "v_event": """SELECT * FROM (VALUES (1,'en',1996),(2,'en',1998),(3,'en',1999),(1,'ln',1995),(2,'ln',1997),(3,'ln',2000)) AS t(ord, phase, anchor)""",
    "v_grid": """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, i*2 - 89.0::DOUBLE AS lat, j*2 - 179.0::DOUBLE AS lon,
  format('{:+06.1f}_{:+07.1f}', i*2 - 89.0::DOUBLE, j*2 - 179.0::DOUBLE) AS cell_id FROM range(90) a(i), range(180) b(j)""",
}

SQL["v_rule"] = """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'wetter than usual' WHEN '2-HIGH' THEN 'Much drier' WHEN '3-MEDIUM' THEN 'Drier, then wetter' ELSE 'mixed' END AS rain,
  CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS curated, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE floor(o_totalprice / 1000) - 250 END AS pct,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(o_custkey % 90 AS DOUBLE) END AS std, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 120 - 60 AS INT) END AS fpct,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS corr, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / 97 END AS roc,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END AS prob, CAST(o_custkey % 101 AS DOUBLE) AS wet, CAST(1 + o_custkey % 8 AS INT) AS n FROM orders"""
