"""Place index build."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from solstice.functions.text import norm_text
from solstice.operators import gazetteer as op
from solstice.plans import sqltext as s
from solstice.plans.registry import query
from solstice.sources.scratch import scratch_dir, stored

NORM = "trim(regexp_replace(CASE WHEN regexp_matches(lower(trim({0})), '^[a-z0-9]') THEN regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g') ELSE lower({0}) END, '\\s+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return NORM.format(x)


FEATURE_SQL = "SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN 'P' ELSE 'A' END AS fclass, p_type AS fc FROM part"


@query("g1_feature_filter", f"SELECT * FROM ({FEATURE_SQL}) WHERE (fclass = 'P' AND fc IN ('ECONOMY', 'LARGE', 'MEDIUM')) OR (fclass = 'A' AND fc IN ('SMALL', 'PROMO'))")
def g1(t):
    features = t.part.selectExpr("p_partkey AS id", "CASE WHEN p_size > 10 THEN 'P' ELSE 'A' END AS fclass", "p_type AS fc")
    return op.keep_features(features, ["ECONOMY", "LARGE", "MEDIUM"], ["SMALL", "PROMO"])


@query(
    "g2_admin_names",
    """SELECT c_custkey AS id, coalesce(a.n_name, '') AS a1, coalesce(b.s_name, '') AS a2 FROM customer
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) a ON a.n_nationkey = c_nationkey
    LEFT JOIN (SELECT s_nationkey AS nk, s_suppkey % 5 AS r, min(s_name) AS s_name FROM supplier GROUP BY 1, 2) b ON b.nk = c_nationkey AND b.r = c_custkey % 5""",
)
def g2(t):
    places = t.customer.selectExpr("c_custkey AS id", "'C' AS cc", "c_nationkey AS adm1", "c_custkey % 5 AS adm2")
    admin1 = t.nation.where("n_regionkey <> 4").selectExpr("concat('C.', n_nationkey) AS code", "n_name AS name")
    admin2 = t.supplier.groupBy(F.expr("concat('C.', s_nationkey, '.', s_suppkey % 5)").alias("code")).agg(F.min("s_name").alias("name"))
    return op.with_admin_names(places, admin1, admin2).select("id", "a1", "a2")


@query("g3_normalised_names", f"SELECT c_custkey AS id, {norm_sql('c_name')} AS name_norm, {norm_sql('c_mktsegment')} AS seg_norm FROM customer")
def g3(t):
    return t.customer.select(F.col("c_custkey").alias("id"), norm_text(F.col("c_name")).alias("name_norm"), norm_text(F.col("c_mktsegment")).alias("seg_norm"))


@query(
    "g3_normalised_texts",
    """SELECT doc_id, sha1(trim(regexp_replace(CASE WHEN regexp_matches(t, '^[a-z0-9]') THEN regexp_replace(regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g') ELSE t END, '\\s+', ' ', 'g'))) AS norm_hash
    FROM (SELECT doc_id, lower(regexp_replace(nfc_normalize(text), '^\\s+', '')) AS t FROM documents)""",
)
def g3_texts(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", F.sha1(norm_text(F.col("text")).cast("binary")).alias("norm_hash"))


ALT_SQL = """SELECT l_orderkey * 8 + l_linenumber AS alt_id, l_partkey AS id, CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN 'en' ELSE 'xx' END AS lang,
  l_returnflag || ' ' || p_name || ' ' || CAST(l_quantity AS INT) AS name, CASE WHEN l_linenumber = 7 THEN '1' ELSE '' END AS historic FROM lineitem JOIN part ON p_partkey = l_partkey"""
ALT_KEPT_SQL = f"""SELECT a.id, a.name, a.rn FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY alt_id, name) AS rn FROM (
    SELECT id, name, min(alt_id) AS alt_id FROM ({ALT_SQL}) WHERE lang IN ('en', '') AND historic <> '1' GROUP BY 1, 2)) a JOIN v_place p ON p.id = a.id WHERE rn <= CASE WHEN pop >= 50000 THEN 40 ELSE 20 END"""


def alternates(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "l_orderkey * 8 + l_linenumber AS alt_id", "l_partkey AS id", "CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN 'en' ELSE 'xx' END AS lang",
        "concat(l_returnflag, ' ', p_name, ' ', CAST(l_quantity AS INT)) AS name", "CASE WHEN l_linenumber = 7 THEN '1' ELSE '' END AS historic",
    )
    return op.alternate_names(rows, t.place)


@query("g4_alternate_names", f"SELECT id, name, CAST(rn AS INT) AS rn FROM ({ALT_KEPT_SQL})")
def g4(t):
    return alternates(t)


KEY_SQL = f"SELECT DISTINCT {norm_sql('raw')} AS k, id FROM (SELECT id, name AS raw FROM v_place UNION ALL SELECT id, name FROM ({ALT_KEPT_SQL})) WHERE length({norm_sql('raw')}) >= 2"


@query("g5_search_keys", KEY_SQL)
def g5(t):
    return op.search_keys(t.place, alternates(t))


SHARD_SQL = "CASE WHEN regexp_matches(k, '^[a-z0-9]') THEN regexp_replace(k[1:{d}], '\\s', '_', 'g') ELSE 'u' || array_to_string([format('{{:04x}}', unicode(c)) FOR c IN string_split(k[1:(CASE WHEN {d} <= 2 THEN 1 ELSE {d} - 1 END)], '')], '_') END"


def shard_sql(depth) -> str:
    return SHARD_SQL.format(d=depth)


WORD_SQL = "SELECT lower(w) AS k, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1"


def words(t):
    """Distinct lower-case words of all documents: mixed scripts and accents."""
    word = F.explode(F.split("text", r"\s+"))
    return t.spread("documents", "text").select(word.alias("w")).select(F.lower("w").alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n"))


@query("g6_shard_keys", f"SELECT k, {shard_sql(2)} AS shard2, {shard_sql(4)} AS shard4 FROM ({WORD_SQL})")
def g6(t):
    return words(t).select("k", op.shard_key(F.col("k"), 2).alias("shard2"), op.shard_key(F.col("k"), 4).alias("shard4"))


@query(
    "g7_adaptive_prefix_shards",
    f"""WITH k AS (SELECT * FROM ({KEY_SQL})), c AS (SELECT k, id, d, p, count(*) OVER (PARTITION BY d, p) AS n FROM (SELECT k, id, d, regexp_replace(k[1:d], '\\s', '_', 'g') AS p FROM k, range(2, 10) r(d)))
    SELECT k, id, arg_min(p, d) AS shard, CAST(min(d) AS INT) AS depth FROM c WHERE n <= 500 OR d = 9 GROUP BY 1, 2""",
)
def g7(t):
    return sharded(t, alternates(t))


def sharded(t, alternates=None):
    """Search keys under their shards; the keys are normalised once, as counting and assigning both read them."""
    return op.assign_shards(stored(op.search_keys(t.place, alternates), "search-keys"), max_rows=500)


@query("g8_shard_payloads")
def g8(t):
    return op.shard_payloads(stored(sharded(t, alternates(t)), "sharded-keys"), t.place, max_rows=500)


def shards_of(keys: str) -> str:
    return f"""SELECT shard, count(*) AS n FROM (SELECT k, id, arg_min(p, d) AS shard FROM (SELECT k, id, d, p, count(*) OVER (PARTITION BY d, p) AS n
        FROM (SELECT k, id, d, regexp_replace(k[1:d], '\\s', '_', 'g') AS p FROM ({keys}), range(2, 10) r(d))) WHERE n <= 500 OR d = 9 GROUP BY 1, 2) GROUP BY 1"""


NAME_KEY_SQL = f"SELECT DISTINCT {norm_sql('name')} AS k, id FROM v_place WHERE length({norm_sql('name')}) >= 2"


@query(
    "g8_updated_shards",
    f"""SELECT a.shard, a.n, b.n IS NULL OR b.n <> a.n AS rewritten FROM ({shards_of(KEY_SQL)}) a LEFT JOIN ({shards_of(NAME_KEY_SQL)}) b ON b.shard = a.shard""",
)
def g8_updated(t):
    """A build of all names, updated when the alternate names arrive: the shards of the full build, and which were rewritten."""
    root = scratch_dir(t.spark, "shards")
    op.update_shards(sharded(t), t.place, root, max_rows=500)
    changed = op.update_shards(sharded(t, alternates(t)), t.place, root, max_rows=500)
    docs = op.current_documents(t.spark, root).groupBy("shard").agg(F.sum("n").alias("n"))
    return docs.join(changed.where("NOT gone").select("shard", F.lit(True).alias("r")), "shard", "left").select("shard", "n", F.coalesce("r", F.lit(False)).alias("rewritten"))


@query(
    "g8_payload_document_rows",
    f"""WITH k AS (SELECT * FROM ({KEY_SQL})), c AS (SELECT k, id, d, p, count(*) OVER (PARTITION BY d, p) AS n FROM (SELECT k, id, d, regexp_replace(k[1:d], '\\s', '_', 'g') AS p FROM k, range(2, 10) r(d))),
    sh AS (SELECT k, id, arg_min(p, d) AS shard FROM c WHERE n <= 500 OR d = 9 GROUP BY 1, 2)
    SELECT shard, k, sh.id, name, cc, pop, true AS in_order FROM sh JOIN v_place p ON p.id = sh.id""",
)
def g8_rows(t):
    """The written documents read back: every key under its shard, and whether its document lists larger places first."""
    schema = "p MAP<STRING, STRUCT<name: STRING, cc: STRING, pop: BIGINT>>, k ARRAY<STRUCT<k: STRING, id: BIGINT>>"
    docs = g8(t).select("shard", "part", F.from_json("doc", schema).alias("d"))
    entries = F.transform("d.k", lambda e: F.struct(e["k"].alias("k"), e["id"].alias("id"), F.element_at("d.p", e["id"].cast("string")).alias("pl")))
    rows = docs.select("shard", "part", F.posexplode(entries).alias("at", "e")).select("shard", "part", "e.k", "e.id", "e.pl.name", "e.pl.cc", "e.pl.pop", "at")
    larger = F.lag("pop").over(Window.partitionBy("shard", "part").orderBy("at"))
    return rows.withColumn("in_order", F.coalesce(larger >= F.col("pop"), F.lit(True))).drop("at", "part")


@query("g9_major_places", f"SELECT k[1:1] AS top_shard, k, id, pop FROM (SELECT DISTINCT {norm_sql('name')} AS k, id, pop FROM v_place WHERE pop >= 100000)")
def g9(t):
    return op.major_places(t.place).select("top_shard", "k", "id", "pop")


@query("g10_top_places_per_cell", f"SELECT cell_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY pop DESC, id) AS rank FROM (SELECT *, {s.cell()} AS cell_id FROM v_place)) WHERE rank <= 30")
def g10(t):
    return op.top_places_per_cell(t.place).select("cell_id", "id", "rank")


@query("g11_large_cities", "SELECT id, name, cc, round(lat, 4) AS lat, round(lon, 4) AS lon, pop FROM v_place WHERE pop >= 100000 AND starts_with(a1, 'S')")
def g11(t):
    return op.large_cities(t.place.withColumn("fc", F.col("a1")), code_prefix="S")


@query(
    "g12_publish_refusal",
    "SELECT 'place count drop' AS gate, count(*)::DOUBLE AS value, 0.9::DOUBLE * (SELECT count(*) FROM customer) AS lo, count(*) >= 0.9 * (SELECT count(*) FROM customer) AS ok FROM part",
)
def g12(t):
    from solstice.operators import gates

    return gates.count_drop(t.part, t.customer.agg(F.count("*").alias("count")), "place count drop").select("gate", "value", "lo", "ok")


@query(
    "g13_country_index",
    """SELECT p.cc, coalesce(n.n_name, p.cc) AS country, p.name, p.id, p.pop, coalesce(s.s_name, 'World directory') AS service, coalesce('http://' || s.s_name, 'http://world') AS service_url
    FROM (SELECT * FROM v_place WHERE pop >= 100000 QUALIFY row_number() OVER (PARTITION BY cc, name ORDER BY pop DESC, id) = 1) p
    LEFT JOIN nation n ON 'Brand#' || n.n_nationkey = p.cc LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) s ON 'Brand#' || s.s_nationkey = p.cc""",
)
def g13(t):
    countries = t.nation.selectExpr("concat('Brand#', n_nationkey) AS cc", "n_name AS name")
    services = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("name")).selectExpr("concat('Brand#', s_nationkey) AS cc", "name", "concat('http://', name) AS url")
    return op.country_index(t.place.where("pop >= 100000"), countries, services, ("World directory", "http://world"))
