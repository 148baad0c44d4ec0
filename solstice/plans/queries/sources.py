"""Readers, writers, publication and streaming.

Each reader gets a landed copy that Spark writes from the driver tables in the published layout.
"""

from pyspark.sql import functions as F

from solstice.functions import calendar as cal
from solstice.operators import gates, tracks
from solstice.plans import sqltext as s
from solstice.plans.queries.tracks import EY, STORM_SQL, WIND
from solstice.plans.registry import query
from solstice.sources import keyed, readers as rd
from solstice.sources import sinks
from solstice.sources.scratch import scratch_dir
from solstice.streaming import refresh


def land(t, lines, purpose: str) -> str:
    """Write a frame of text lines and return its folder."""
    path = scratch_dir(t.spark, purpose)
    lines.select(F.col(lines.columns[0]).alias("value")).write.text(path)
    return path


def tsv(*columns):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


@query("a1_index_text", f"SELECT {s.SEASON_LIST}[month] AS season, year, v AS oni FROM v_series")
def a1(t):
    season = F.get(cal.season_names(), F.col("month") - 1)
    lines = t.series.select(F.format_string("%4s  %4d   %7.2f  %9.4f", season, "year", F.lit(26.5), "v").alias("value"))
    header = t.region.select(F.lit(" SEAS  YR   TOTAL   ANOM").alias("value"))
    short = t.nation.select(F.concat(F.lit("DJF "), F.col("n_nationkey").cast("string")).alias("value"))
    return rd.read_index_series(t.spark, land(t, lines.unionByName(header).unionByName(short), "index"))


@query(
    "a2_place_dump",
    "SELECT p_partkey AS id, '\"' || p_name AS name, CAST((p_partkey*7919) % 17900 AS DOUBLE)/100 - 89.5 AS lat, 'P' AS fclass, p_type AS fc, CASE WHEN p_size < 10 THEN 0 ELSE p_size END AS pop FROM part WHERE p_size % 10 <> 0",
)
def a2(t):
    blank = F.lit("")
    row = tsv(
        "p_partkey", F.concat(F.lit('"'), "p_name"), "p_name", blank, F.expr("CAST((p_partkey*7919) % 17900 AS DOUBLE)/100 - 89.5").cast("string"), F.lit("1.5"), F.lit("P"),
        "p_type", F.lit("KE"), blank, F.lit("01"), F.lit("001"), blank, blank, F.expr("CASE WHEN p_size < 10 THEN '' ELSE CAST(p_size AS STRING) END"), blank, F.lit("9"), F.lit("UTC"), F.lit("2026-01-01"),
    )
    short = tsv("p_partkey", "p_name", "p_name")
    lines = t.part.select(F.when(F.col("p_size") % 10 == 0, short).otherwise(row).alias("value"))
    return rd.read_places(t.spark, land(t, lines, "places")).select("id", "name", "lat", "fclass", "fc", F.col("pop").cast("int").alias("pop"))


@query("a3_country_table", "SELECT 'C' || n_nationkey AS iso2, n_name AS name, 'R' || n_regionkey AS continent, 'en,fr' AS languages FROM nation")
def a3(t):
    blank = F.lit("")
    row = tsv(F.expr("concat('C', n_nationkey)"), blank, blank, blank, "n_name", F.lit("Capital"), blank, blank, F.expr("concat('R', n_regionkey)"), *[blank] * 6, F.lit("en,fr"))
    lines = t.nation.select(row.alias("value")).unionByName(t.region.select(F.concat(F.lit("# "), "r_name").alias("value"))).unionByName(t.region.select(F.lit("").alias("value")))
    return rd.read_countries(t.spark, land(t, lines, "countries")).drop("capital")


@query("a4_code_tables", "SELECT 'KE.' || s_suppkey AS code, s_name AS name FROM supplier")
def a4(t):
    lines = t.supplier.select(tsv(F.expr("concat('KE.', s_suppkey)"), "s_name", "s_name", "s_suppkey").alias("value"))
    return rd.read_code_names(t.spark, land(t, lines, "codes"))


@query("a5_alternate_names", "SELECT l_orderkey * 8 + l_linenumber AS alt_id, l_partkey AS id, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'fr' END AS lang, 'n ' || CAST(l_quantity AS INT) AS name, CASE WHEN l_linenumber = 7 THEN '1' ELSE '' END AS historic FROM lineitem WHERE l_linenumber <> 2")
def a5(t):
    name = F.concat(F.lit("n "), F.col("l_quantity").cast("int").cast("string"))
    full = tsv(F.expr("l_orderkey * 8 + l_linenumber"), "l_partkey", F.expr("CASE WHEN l_returnflag = 'R' THEN '' ELSE 'fr' END"), name, *[F.lit("")] * 3, F.expr("CASE WHEN l_linenumber = 7 THEN '1' ELSE '' END"))
    lines = t.lineitem.select(F.when(F.col("l_linenumber") == 2, tsv("l_orderkey", "l_partkey")).when(F.col("l_linenumber") == 3, tsv(F.expr("l_orderkey * 8 + l_linenumber"), "l_partkey", F.expr("CASE WHEN l_returnflag = 'R' THEN '' ELSE 'fr' END"), name)).otherwise(full).alias("value"))
    return rd.read_alternate_names(t.spark, land(t, lines, "alternates"))


@query("a6_storm_fix_csv", f"SELECT CAST(sid AS VARCHAR) AS sid, strftime(ts, '%Y-%m-%d') AS day, lat, basin, {WIND} AS wind FROM v_fix")
def a6(t):
    fixes = t.fix.selectExpr("sid AS SID", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ISO_TIME", "lat AS LAT", "lon AS LON", "wmo_wind AS WMO_WIND", "basin AS BASIN", "'TS' AS NATURE", "usa_wind AS USA_WIND")
    units = t.spark.range(1).selectExpr("' ' AS SID", "' ' AS ISO_TIME", "'degrees_north' AS LAT", "'degrees_east' AS LON", "'kts' AS WMO_WIND", "' ' AS BASIN", "' ' AS NATURE", "'kts' AS USA_WIND")
    path = scratch_dir(t.spark, "fixes")
    fixes.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    units.write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = rd.read_fixes(t.spark, path)
    return rows.select("sid", F.date_format("ts", "yyyy-MM-dd").alias("day"), "lat", "basin", tracks.wind("wmo_wind", "usa_wind").alias("wind"))


@query("a7_json_documents", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def a7(t):
    path = scratch_dir(t.spark, "json")
    t.nation.selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS other").write.json(path)
    found = rd.read_json(t.spark, path, "id INT, name STRING", multiline=False)
    return found.unionByName(rd.read_json(t.spark, f"{path}-absent", "id INT, name STRING"))


@query("a8_country_overrides", "SELECT 'N' || c_nationkey AS cc, c_mktsegment AS region_id, 'rains ' || count(*) AS local_season FROM customer GROUP BY c_nationkey, c_mktsegment")
def a8(t):
    path = scratch_dir(t.spark, "overrides")
    seasons = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.concat(F.lit("rains "), F.count("*").cast("string")).alias("s"))
    rows = seasons.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso2")).agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "s"))).alias("season_names"))
    rows.repartition("iso2").write.partitionBy("iso2").json(path)
    return rd.override_seasons(rd.read_country_overrides(t.spark, path))


@query("a9_polygon_features", "SELECT poly_id, CAST(category AS INT) AS category, x1, y1, x2, y2 FROM v_edge")
def a9(t):
    corners = t.edge.groupBy("poly_id", "category").agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("e"))
    ring = F.expr(
        "array(array(-170D + 12*poly_id, -80D + 6*poly_id), array(-140D + 12*poly_id, -75D + 6*poly_id), array(-145D + 12*poly_id, -50D + 6*poly_id),"
        " array(-158D + 12*poly_id, -68D + 6*poly_id), array(-170D + 12*poly_id, -80D + 6*poly_id))"
    )
    geometry = F.when(F.col("poly_id") % 2 == 0, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")))
    )
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("poly_id").alias("ID"), F.col("category").alias("DM"))), F.lit(',"geometry":'), geometry, F.lit("}"))
    doc = corners.select(feature.alias("f")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    polygons = rd.read_polygons(t.spark, land(t, doc, "polygons"), "ID INT, DM INT")
    edges = rd.polygon_edges(polygons, "ID")
    return edges.join(polygons.select(F.col("ID").alias("poly_id"), F.col("DM").alias("category")), "poly_id")


@query(
    "a12_calendar_payloads",
    "SELECT CAST(iso AS VARCHAR) AS iso2, crop, zone, a AS early_sowing, b AS later_sowing, h AS early_harvest FROM v_window",
)
def a12(t):
    def month(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("month")))

    session = F.struct(F.lit("no").alias("all_year"), month("a").alias("early_sowing"), month("b").alias("later_sowing"), month("h").alias("early_harvest"))
    record = F.struct(F.struct(F.col("crop").alias("name")).alias("crop"), F.struct(F.col("zone").alias("name")).alias("aez"), F.array(session).alias("sessions"))
    lines = t.window.select(F.to_json(F.struct(F.col("iso").cast("string").alias("country"), F.array(record).alias("records"))).alias("value"))
    broken = t.region.select(F.concat(F.lit('{"country": "'), "r_name", F.lit('", "records": [{')).alias("value"))
    rows, bad = rd.read_crop_sessions(t.spark, land(t, lines.unionByName(broken), "calendar"))
    return rows.select("iso2", "crop", "zone", "early_sowing", "later_sowing", "early_harvest")


@query("a13_parallel_arrays", "SELECT place, CAST(ym // 100 AS VARCHAR) || '-' || lpad(CAST(ym % 100 AS VARCHAR), 2, '0') AS ym, anomaly, mean FROM v_forecast WHERE abs(anomaly) < 300")
def a13(t):
    rows = t.forecast.select("place", F.concat(F.expr("ym div 100"), F.lit("-"), F.lpad(F.expr("ym % 100").cast("string"), 2, "0"), F.lit("-01")).alias("time"), "anomaly", "mean")
    # one payload per place: a handful of months each, one of them not a number
    filler = rows.select("place").distinct().select("place", F.lit("1990-01-01").alias("time"), F.lit(float("nan")).alias("anomaly"), F.lit(1.0).alias("mean"))
    nested = rows.unionByName(filler).groupBy("place").agg(F.collect_list(F.struct("time", "anomaly", "mean")).alias("m"))
    payloads = nested.select("place", "m.time", "m.anomaly", "m.mean")
    return rd.zip_forecast(payloads, max_abs=300.0)


@query("a14_known_scores", "SELECT CAST(iso AS VARCHAR) AS iso3, CAST(ind AS VARCHAR) AS ind, round(score, 6) AS score FROM v_indicator WHERE ind IN (1, 2, 4)")
def a14(t):
    path = scratch_dir(t.spark, "scores")
    t.indicator.selectExpr("CAST(iso AS STRING) AS Iso3", "CAST(ind AS STRING) AS IndicatorId", "CASE WHEN ind = 3 THEN NULL ELSE score END AS IndicatorScore").write.json(path)
    return rd.read_scores(t.spark, path, ["1", "2", "3", "4"]).withColumn("score", F.round("score", 6))


def review_rows(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit('say "'), "source", F.lit('", ')).alias("english"), F.col("text").alias("translation"), F.col("lang").alias("status"))


REVIEW_SQL = "SELECT CAST(doc_id AS VARCHAR) AS key, 'say \"' || source || '\", ' AS english, sha1(text) AS text_hash, lang AS status FROM documents"


@query("a16_review_sheet_import", REVIEW_SQL)
def a16(t):
    path = scratch_dir(t.spark, "review")
    sinks.write_csv(review_rows(t), path)
    return rd.read_review_sheet(t.spark, path).select("key", "english", F.sha1(F.col("translation").cast("binary")).alias("text_hash"), "status")


@query("s6_quoted_csv", "SELECT count(*) AS n, count(*) FILTER (contains(text, chr(10))) AS with_line_breaks FROM documents")
def s6(t):
    path = scratch_dir(t.spark, "csv")
    sinks.write_csv(review_rows(t), path)
    rows = rd.read_review_sheet(t.spark, path)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("translation").contains("\n")).alias("with_line_breaks"))


@query("g14_first_available_source", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def g14(t):
    path = scratch_dir(t.spark, "legacy")
    t.nation.selectExpr("n_nationkey AS id", "n_name AS name").write.json(path)

    def read(spark, where):
        return rd.read_json(spark, where, "id INT, name STRING", multiline=False)

    return rd.read_first_available(t.spark, [(f"{path}-new", read), (path, read)])


@query("s1_documents_by_key", "SELECT p_brand AS brand, p_partkey AS id, p_name AS name FROM part")
def s1(t):
    docs = sinks.documents_by_key(t.part.selectExpr("p_brand AS brand", "p_partkey AS id", "p_name AS name"), ["brand"], ["id"], max_rows=10_000)
    path = scratch_dir(t.spark, "documents")
    sinks.write_documents(docs, ["brand"], path)
    back = t.spark.read.schema("value STRING, brand STRING").text(path)
    return back.select("brand", F.explode(F.from_json("value", "rows ARRAY<STRUCT<id: BIGINT, name: STRING>>")["rows"]).alias("r")).select("brand", "r.id", "r.name")


@query("s2_manifest", "SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS keys, count(*) AS count, '2026-01-01' AS built, 'parts' AS sources FROM part")
def s2(t):
    m = sinks.manifest(t.part, "p_brand", "2026-01-01", ["parts"])
    return m.select(F.array_join("keys", ",").alias("keys"), "count", "built", F.array_join("sources", ",").alias("sources"))


@query(
    "s2_manifest_pages",
    """SELECT CAST((r - 1) // 500 AS BIGINT) AS page, min(key) AS first, max(key) AS last, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS count, string_agg(key, ',' ORDER BY key) AS keys
    FROM (SELECT key, n, row_number() OVER (ORDER BY key) AS r FROM (SELECT c_name AS key, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)) GROUP BY 1""",
)
def s2_pages(t):
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", "c_name"), "c_custkey")
    return sinks.manifest_pages(rows, "c_name", scratch_dir(t.spark, "manifest"), page_size=500).withColumn("keys", F.array_join("keys", ","))


@query("s3_gated_publication", "SELECT p_partkey AS id, p_size AS size FROM part")
def s3(t):
    """A good build, then one that its gate refuses: the good one stays current."""
    root = scratch_dir(t.spark, "published")

    check = [*sinks.range_measures({"size": (1, 50)}), sinks.size_measure("rows", 1, float("inf")), *sinks.finite_measures(["price"])]
    rows = t.part.selectExpr("p_partkey AS id", "p_size AS size", "p_retailprice AS price")
    sinks.publish(rows, root, check)
    try:
        sinks.publish(rows.withColumn("size", F.col("size") + 100), root, check)
        raise AssertionError("the gate let a bad build pass")
    except sinks.GateFailed:
        pass
    return sinks.current(t.spark, root).select("id", "size")


@query("s4_provenance_stamp", "SELECT cell, CAST(sum(value) AS DOUBLE) AS total, 'Cube' AS name, 'through ' || max(year * 100 + month) AS version, 'open' AS licence FROM v_cube GROUP BY 1")
def s4(t):
    version = F.concat(F.lit("through "), F.max(F.col("year") * 100 + F.col("month")).cast("string"))
    rows = t.cube.groupBy("cell").agg(F.sum("value").alias("total"), version.alias("v"))
    stamp = sinks.provenance_struct("Cube", F.col("v"), "2026-01-01", "https://example.org/cube", "open", method="sum")
    return rows.withColumn("p", stamp).select("cell", "total", "p.name", "p.version", "p.licence")


@query(
    "s5_quantised_values",
    "SELECT o_orderkey AS id, CAST(round_even(x, 0) AS DOUBLE) AS whole, round(x, 2) AS two, CAST(format('{:.3e}', x) AS DOUBLE) AS three FROM (SELECT o_orderkey, o_totalprice / 9.7::DOUBLE AS x FROM orders)",
)
def s5(t):
    x = F.col("o_totalprice") / 9.7
    return t.orders.select(F.col("o_orderkey").alias("id"), sinks.whole(x).alias("whole"), sinks.decimals(x, 2).alias("two"), sinks.significant(x, 3).alias("three"))


@query("s7_size_report", "SELECT count(*) AS n, CAST(max(octet_length(encode(text))) AS BIGINT) AS largest, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total FROM documents")
def s7(t):
    return sinks.size_report(t.documents, "text")


@query("m1_incremental_refresh", "SELECT event_id, event_type, value FROM events")
def m1(t):
    root, state = scratch_dir(t.spark, "refreshed"), scratch_dir(t.spark, "refresh-state")
    stream = refresh.file_stream(t.spark, t.folder, "event_id BIGINT, event_type STRING, value DOUBLE", glob="events.parquet")
    refresh.refresh(stream, root, state, gates=sinks.range_measures({"value": (0, 1e6)}))
    return sinks.current(t.spark, root)


@query("m1_keyed_refresh", "SELECT event_id, event_type, CASE WHEN event_id % 10 = 3 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 100 <> 5")
def m1_keyed(t):
    """All events arrive; then every tenth is corrected and every hundredth withdrawn, by key."""
    root, state = scratch_dir(t.spark, "keyed"), scratch_dir(t.spark, "keyed-state")
    stream = refresh.file_stream(t.spark, t.folder, "event_id BIGINT, event_type STRING, value DOUBLE", glob="events.parquet")
    keyed.refresh(stream, root, state, ["event_id"], ["version"], transform=lambda df: df.withColumn("version", F.lit(1)), gates=sinks.range_measures({"value": (0, 1e6)}), n_parts=16)
    events = keyed.read(t.spark, root)
    changes = events.where("event_id % 10 = 3 OR event_id % 100 = 5").selectExpr("event_id", "event_type", "value + 1 AS value", "2 AS version", "event_id % 100 = 5 AS gone")
    keyed.upsert(changes, root, ["event_id"], ["version"], gone="gone")
    return keyed.read(t.spark, root).select("event_id", "event_type", "value")


@query(
    "m2_running_storm_state",
    f"SELECT s.sid, basin, glat, glon, max_wind, n_cells FROM ({STORM_SQL}) s JOIN (SELECT sid, count(DISTINCT {s.cell(tie=s.half_even)}) AS n_cells FROM v_fix GROUP BY 1) c ON c.sid = s.sid",
)
def m2(t):
    out, state = scratch_dir(t.spark, "storms"), scratch_dir(t.spark, "storm-state")
    schema = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP"
    feed = refresh.file_stream(t.spark, t.folder, schema, glob="lineitem.parquet").selectExpr(*t.FIX_COLUMNS)
    refresh.storm_stream(feed, out, state, delay="3000 days")
    cells = refresh.storm_cells(t.spark, out).groupBy("sid").agg(F.count("*").alias("n_cells"))
    return refresh.storm_state(t.spark, out).join(cells, "sid")
