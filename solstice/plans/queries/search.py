"""Batch place search."""

from pyspark.sql import functions as F

from solstice.functions.joins import dim_join
from solstice.functions.text import edit_distance
from solstice.operators import gazetteer, search as op, spatial
from solstice.plans import sqltext as s
from solstice.plans.queries.gazetteer import norm_sql
from solstice.plans.registry import query

# every distinct name asked five ways: as written in capitals, one letter lost, two swapped, a prefix, two errors
RAW_SQL = """SELECT DISTINCT unnest([upper(p_name), p_name[1:3] || p_name[5:], p_name[1:3] || p_name[5:5] || p_name[4:4] || p_name[6:], p_name[1:5], p_name[1:1] || p_name[3:6] || p_name[8:], p_name[1:1]]) AS raw FROM part"""
Q_SQL = f"SELECT DISTINCT {norm_sql('raw')} AS q FROM ({RAW_SQL}) WHERE length({norm_sql('raw')}) >= 2"
KEYS_SQL = f"SELECT {norm_sql('name')} AS k, id, pop >= 100000 AS major FROM v_place"
MATCH_SQL = f"""SELECT q, k, via, min(score) AS score FROM (
  SELECT q, k, 'shard' AS via, CASE WHEN starts_with(k, q) THEN 0 ELSE d END AS score, ok FROM (SELECT *, d <= e AS ok FROM (SELECT *, damerau_levenshtein(q, k[1:length(q)]) AS d FROM p WHERE k[1:2] = q[1:2])) WHERE starts_with(k, q) OR ok
  UNION ALL SELECT q, k, 'major', d, true FROM (SELECT *, damerau_levenshtein(q, k[1:length(q)]) AS d FROM p WHERE major AND k[1:1] = q[1:1]) WHERE d <= e) GROUP BY 1, 2, 3"""
PAIRS_SQL = f"""SELECT q, k, major, CASE WHEN abs(length(k) - length(q)) > m + 3 THEN -1 WHEN m = 0 THEN -1 WHEN length(k) < length(q) THEN least(m, 1) ELSE m END AS e
  FROM (SELECT q, k, bool_or(major) AS major, CASE WHEN length(q) >= 7 THEN 2 WHEN length(q) >= 4 THEN 1 ELSE 0 END AS m FROM ({Q_SQL}) a CROSS JOIN ({KEYS_SQL}) b GROUP BY q, k)"""
WITH_MATCH = f"p AS ({PAIRS_SQL}), m AS ({MATCH_SQL})"
BEST = f"b AS (SELECT q, id, arg_min(score, score * 1000 + length(k)) AS score, arg_min(k, score * 1000 + length(k)) AS k FROM (SELECT m.*, x.id FROM m JOIN ({KEYS_SQL}) x ON x.k = m.k AND (m.via = 'shard' OR x.major)) GROUP BY 1, 2)"
PLACE_KEY = "concat_ws('|', name, cc, lower(a1), format('{:.2f}', floor(lat * 4 + 0.5) / 4), format('{:.2f}', floor(lon * 4 + 0.5) / 4))"
WEIGHT = f"""w AS (SELECT b.q, b.id, cc, {PLACE_KEY} AS pk, round(score * 2.5 - log10(pop + 1) - CASE WHEN a1 <> '' THEN 0 ELSE 0.3 END - CASE WHEN {norm_sql('name')} = q THEN 1.2 ELSE 0 END + least(length(k) - length(q), 8) * 0.02, 9)::DOUBLE AS w FROM b JOIN v_place p ON p.id = b.id)"""
TOP = """t AS (SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY w, id) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q, cc ORDER BY w, id) AS rc FROM (
  SELECT *, row_number() OVER (PARTITION BY q, pk ORDER BY w, id) AS rp FROM w) WHERE rp = 1) WHERE rc <= 3)"""


def raw_queries(t):
    forms = F.expr(
        "explode(array(upper(n), concat(left(n, 3), substr(n, 5)), concat(left(n, 3), substr(n, 5, 1), substr(n, 4, 1), substr(n, 6)), left(n, 5),"
        " concat(left(n, 1), substr(n, 3, 4), substr(n, 8)), left(n, 1)))"
    )
    return t.part.selectExpr("p_name AS n").distinct().select(forms.alias("raw")).distinct()


def queries(t):
    return op.prepare_queries(raw_queries(t)).select("q").distinct()


def keys(t):
    return gazetteer.search_keys(t.place).join(t.place.selectExpr("id", "pop >= 100000 AS major"), "id")


def best(t):
    return op.best_per_place(op.match_keys(queries(t), keys(t)), keys(t))


@query(
    "h1_longest_prefix_shard",
    f"""WITH c AS (SELECT k, id, d, p, count(*) OVER (PARTITION BY d, p) AS n FROM (SELECT k, id, d, regexp_replace(k[1:d], '\\s', '_', 'g') AS p FROM ({KEYS_SQL}), range(2, 10) r(d))),
    sh AS (SELECT DISTINCT arg_min(p, d) AS shard FROM (SELECT * FROM c WHERE n <= 100 OR d = 9) GROUP BY k, id)
    SELECT q, arg_max(sh.shard, d) AS shard FROM (SELECT q, d, regexp_replace(q[1:d], '\\s', '_', 'g') AS p FROM ({Q_SQL}), range(2, 7) r(d) WHERE d = 2 OR length(q) >= d) x LEFT JOIN sh ON sh.shard = x.p GROUP BY 1""".replace(
        "arg_max(sh.shard, d)", "arg_max(sh.shard, CASE WHEN sh.shard IS NOT NULL THEN d END)"
    ),
)
def h1(t):
    shards = gazetteer.assign_shards(gazetteer.search_keys(t.place), max_rows=100)
    return op.pick_shard(queries(t), shards)


@query("h2_expanded_payload_rows", f"SELECT k, id, name, cc, pop FROM (SELECT {norm_sql('name')} AS k, * FROM v_place)")
def h2(t):
    docs = gazetteer.shard_payloads(gazetteer.assign_shards(gazetteer.search_keys(t.place), max_rows=100), t.place, max_rows=100)
    return op.expand_payloads(docs).select("k", "id", "name", "cc", "pop")


# a typed form of every document's source and language against the true one; the limit is the length difference bound
@query(
    "h3_edit_distance",
    """SELECT a, b, CAST(least(damerau_levenshtein(a, b), 3) AS INT) AS d FROM (SELECT DISTINCT c_name[10:] AS a, c_name[10:15] || c_name[17:17] || c_name[16:16] || c_name[18:] AS b FROM customer)
    UNION ALL SELECT a, b, CAST(least(damerau_levenshtein(a, b), 3) AS INT) FROM (SELECT DISTINCT p_name AS a, replace(p_name, 'l', '') AS b FROM part)""",
)
def h3(t):
    swapped = t.customer.selectExpr("substr(c_name, 10) AS a", "concat(substr(c_name, 10, 6), substr(c_name, 17, 1), substr(c_name, 16, 1), substr(c_name, 18)) AS b")
    lost = t.part.selectExpr("p_name AS a", "replace(p_name, 'l', '') AS b")
    pairs = swapped.distinct().unionByName(lost.distinct())
    return pairs.select("a", "b", edit_distance(F.col("a"), F.col("b"), 2).alias("d"))


@query("h4_prefix_and_fuzzy_scores", f"WITH {WITH_MATCH} SELECT q, k, via, CAST(score AS INT) AS score FROM m")
def h4(t):
    return op.match_keys(queries(t), keys(t))


@query("h5_best_score_per_place", f"WITH {WITH_MATCH}, {BEST} SELECT q, id, CAST(score AS INT) AS score, k FROM b")
def h5(t):
    return best(t)


@query("h6_rank_weight", f"WITH {WITH_MATCH}, {BEST}, {WEIGHT} SELECT q, id, round(w, 6) AS w FROM w")
def h6(t):
    return op.weighted(best(t), t.place).select("q", "id", F.round("w", 6).alias("w"))


@query("h7_diversified_top", f"WITH {WITH_MATCH}, {BEST}, {WEIGHT}, {TOP} SELECT q, id, rank FROM t WHERE rank <= 8")
def h7(t):
    return op.search_places(queries(t), t.place).select("q", "id", "rank")


@query(
    "h8_two_source_candidates",
    f"WITH {WITH_MATCH} SELECT q, count(DISTINCT CASE WHEN via = 'shard' THEN x.id END) AS from_shard, count(DISTINCT CASE WHEN via = 'major' THEN x.id END) AS from_major, count(DISTINCT x.id) AS candidates FROM m JOIN ({KEYS_SQL}) x ON x.k = m.k AND (m.via = 'shard' OR x.major) GROUP BY 1",
)
def h8(t):
    rows = keys(t).join(op.match_keys(queries(t), keys(t)), "k").where("via = 'shard' OR major")
    flags = rows.groupBy("q", "id").agg(F.max((F.col("via") == "shard").cast("bigint")).alias("s"), F.max((F.col("via") == "major").cast("bigint")).alias("m"))
    return flags.groupBy("q").agg(F.sum("s").alias("from_shard"), F.sum("m").alias("from_major"), F.count("*").alias("candidates"))


@query(
    "h9_result_labels",
    "SELECT id, CASE WHEN a1 = a2 THEN '' ELSE a2 || ' — ' END || CASE WHEN a1 = '' THEN '' ELSE a1 || ' — ' END || coalesce(n_name, cc) AS label FROM (SELECT id, cc, a1, CASE WHEN a2 > '4' THEN a1 ELSE a2 END AS a2 FROM v_place) LEFT JOIN nation ON 'Brand#' || n_nationkey = cc",
)
def h9(t):
    countries = t.nation.selectExpr("concat('Brand#', n_nationkey) AS cc", "n_name AS country")
    # some districts carry the name of their province and must show it once
    rows = t.place.withColumn("a2", F.expr("CASE WHEN a2 > '4' THEN a1 ELSE a2 END"))
    rows = dim_join(rows, countries, "cc", "left")
    return rows.select("id", op.result_label(F.col("a2"), F.col("a1"), F.coalesce("country", "cc")).alias("label"))


@query(
    "h10_reverse_naming",
    f"""WITH pl AS (SELECT *, {s.cell()} AS cell_id FROM v_place), near AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY pop DESC, id) <= 30),
    pt AS (SELECT id, lat, lon, {s.cell()} AS cell_id FROM v_point)
    SELECT p.id, CASE WHEN n.name IS NOT NULL THEN 'near ' || n.name ELSE format('{{:.2f}}, {{:.2f}}', p.lat, p.lon) END AS name, n.cc FROM pt p LEFT JOIN
      (SELECT a.id AS pid, b.name, b.cc FROM pt a JOIN near b ON a.cell_id = b.cell_id
       QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {s.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.pop DESC, b.id) = 1) n ON n.pid = p.id""",
)
def h10(t):
    found = spatial.nearest_listed(t.point.select("id", "lat", "lon"), gazetteer.places_per_cell(t.place))
    return found.select("id", op.point_name(F.col("lat"), F.col("lon"), F.col("place.name")).alias("name"), F.col("place.cc").alias("cc"))


@query("h11_minimum_query_length", f"SELECT raw, {norm_sql('raw')} AS q FROM ({RAW_SQL}) WHERE length({norm_sql('raw')}) >= 2")
def h11(t):
    return op.prepare_queries(raw_queries(t)).select("raw", "q")
