"""Text catalog deltas."""

from pyspark.sql import functions as F

from solstice.operators import catalog as op
from solstice.plans.registry import query
from solstice.sources.scratch import stored

HASH = "substr(sha1({0}), 1, 10)"


def source(t):
    return t.documents.select(F.col("doc_id").alias("k"), F.col("text").alias("value"))


def target(t):
    return t.target.withColumn("value", F.concat(F.lit("T "), F.col("k").cast("string")))


def translations(t):
    """New texts for the documents labelled toxic, and for some keys nobody knows."""
    return t.labels.where("toxic = 1").selectExpr("doc_id AS k", "concat('N ', doc_id) AS value").unionByName(
        t.labels.where("toxic = 1 AND quality = 1").selectExpr("doc_id + 2000000000 AS k", "'unknown' AS value")
    )


TARGET_SQL = "SELECT *, 'T ' || k AS value FROM v_target"

# nested documents: one per part, with lists and private keys
NESTED = "to_json(named_struct('_lang', p_brand, 'names', map(concat('p', p_partkey), p_name), 'meta', named_struct('_hash', 'x', 'size', named_struct('now', CAST(p_size AS STRING), 'type', p_type)), 'list', array('a', 'b', p_brand)))"


def nested(t):
    columns = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return t.spread("part", *columns).select(F.col("p_partkey").cast("string").alias("lang"), F.expr(NESTED).alias("doc"))


FLAT_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS lang, 'names.p' || p_partkey AS k, p_name AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'meta.size.now', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'meta.size.type', p_type FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'list', 'a | b | ' || p_brand FROM part"""


@query("v1_flatten_documents", FLAT_SQL)
def v1(t):
    return op.flatten(nested(t), ["lang"], join_lists=True)


@query("v2_unflatten_documents", f"SELECT * FROM ({FLAT_SQL})")
def v2(t):
    """Flatten, nest again and flatten once more: the rows must come back."""
    rows = stored(op.flatten(nested(t), ["lang"], join_lists=True), "flat")
    docs = stored(op.unflatten(rows, ["lang"]), "nested")
    return op.flatten(docs, ["lang"], join_lists=True)


@query("v3_source_hash", f"SELECT doc_id AS k, {HASH.format('text')} AS src_hash FROM documents")
def v3(t):
    return source(t).select("k", op.source_hash(F.col("value")).alias("src_hash"))


NEEDS_SQL = f"SELECT d.doc_id AS k, text AS value, CASE WHEN t.k IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM documents d LEFT JOIN v_target t ON t.k = d.doc_id WHERE t.k IS NULL OR t.src_hash <> {HASH.format('text')}"


@query("v4_needs_work", f"SELECT k, reason FROM ({NEEDS_SQL})")
def v4(t):
    return op.needs_work(source(t), target(t)).select("k", "reason")


@query("v5_stale_keys", "SELECT k, src_hash FROM v_target WHERE k NOT IN (SELECT doc_id FROM documents)")
def v5(t):
    return op.stale_keys(source(t), target(t)).select("k", "src_hash")


@query(
    "v6_apply_translations",
    f"""SELECT d.doc_id AS k, coalesce(n.value, t.value, CASE WHEN d.lang = 'de' THEN d.text END) AS value, CASE WHEN n.k IS NOT NULL THEN {HASH.format('d.text')} ELSE t.src_hash END AS src_hash, CASE WHEN n.k IS NOT NULL THEN true ELSE t.mt END AS mt
    FROM documents d LEFT JOIN ({TARGET_SQL}) t ON t.k = d.doc_id LEFT JOIN (SELECT doc_id AS k, 'N ' || doc_id AS value FROM labels WHERE toxic = 1) n ON n.k = d.doc_id WHERE coalesce(n.value, t.value, CASE WHEN d.lang = 'de' THEN d.text END) IS NOT NULL""",
)
def v6(t):
    lists = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("k"))
    return op.apply_translations(source(t), target(t), translations(t), lists)


# templates per part and a proposed fix for each, some for unknown parts, some with another slot
TEMPLATE = "concat('{', p_type, '} in {', p_brand, '}')"
FIX = "concat(CASE WHEN p_size % 7 = 0 THEN '{other}' ELSE concat('{', p_type, '}') END, ' near {', p_brand, '}')"
CHECK_SQL = f"""SELECT p_brand AS lang, p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'unknown key' WHEN p_size % 7 = 0 THEN 'slot mismatch' ELSE 'applied' END AS status FROM part"""


def fixes(t):
    templates = t.part.selectExpr("p_partkey AS k", f"replace({TEMPLATE}, '#', '') AS value")
    proposed = t.part.selectExpr("p_brand AS lang", "CASE WHEN p_size % 5 = 0 THEN -1 - p_partkey ELSE p_partkey END AS k", f"replace({FIX}, '#', '') AS fix")
    return op.check_fixes(templates, proposed)


@query("v7_checked_fixes", f"SELECT lang, CASE WHEN status = 'unknown key' THEN -1 - k ELSE k END AS k, status FROM ({CHECK_SQL})")
def v7(t):
    return fixes(t).select("lang", "k", "status")


@query("v7_fix_report", f"SELECT lang, count(*) AS proposed, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status <> 'applied') AS skipped FROM ({CHECK_SQL}) GROUP BY 1")
def v7_report(t):
    return op.fix_report(fixes(t))


LANG_TARGET = "SELECT d.lang, d.doc_id AS k, 'T ' || d.doc_id AS value, substr(sha1(d.text), 1, 10) AS src_hash, toxic = 1 AS mt FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def lang_target(t):
    rows = t.labels.join(t.documents, "doc_id")
    return rows.select("lang", F.col("doc_id").alias("k"), F.concat(F.lit("T "), F.col("doc_id").cast("string")).alias("value"), op.source_hash(F.col("text")).alias("src_hash"), (F.col("toxic") == 1).alias("mt"))


def review(t):
    """Reviewed texts for everything in Spanish and for the good half of the rest; some are blank."""
    rows = t.labels.join(t.documents, "doc_id").where("lang = 'es' OR quality = 1")
    return rows.select("lang", F.col("doc_id").alias("k"), F.when(F.col("source").isNull() | (F.col("n_chars") % 9 == 0) & (F.col("lang") != "es"), "  ").otherwise(F.concat(F.lit(" R "), F.col("doc_id").cast("string"))).alias("translation"))


REVIEWED_SQL = f"""SELECT t.lang, t.k, coalesce(r.tr, t.value) AS value, src_hash, CASE WHEN r.tr IS NOT NULL THEN false ELSE mt END AS mt FROM ({LANG_TARGET}) t
  LEFT JOIN (SELECT d.lang, d.doc_id AS k, 'R ' || d.doc_id AS tr FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE (lang = 'es' OR quality = 1) AND NOT (source IS NULL OR (n_chars % 9 = 0 AND lang <> 'es'))) r ON r.lang = t.lang AND r.k = t.k"""


@query("v8_imported_review", REVIEWED_SQL)
def v8(t):
    return op.import_review(lang_target(t), review(t), source(t))


@query("v8_language_status", f"SELECT lang, CASE WHEN bool_or(mt) THEN 'machine' ELSE 'reviewed' END AS status FROM ({REVIEWED_SQL}) GROUP BY 1")
def v8_status(t):
    return op.language_status(op.import_review(lang_target(t), review(t), source(t)))


SHEET_SQL = f"""SELECT l.lang, d.doc_id AS k, coalesce(t.value, '') AS translation, CASE WHEN t.k IS NULL THEN 'pending' WHEN mt THEN 'machine' ELSE 'reviewed' END AS status
  FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN ({LANG_TARGET}) t ON t.lang = l.lang AND t.k = d.doc_id"""


def sheet(t):
    return op.review_sheet(source(t), lang_target(t), t.documents.select("lang").distinct())


@query("v9_review_sheet", SHEET_SQL)
def v9(t):
    return sheet(t).select("lang", "k", "translation", "status")


@query("v10_language_rollup", f"SELECT lang, count(*) FILTER (status = 'pending') AS pending, count(*) AS keys, count(*) FILTER (status = 'pending') < count(*) * 0.25 AS ships FROM ({SHEET_SQL}) GROUP BY 1")
def v10(t):
    return op.language_rollup(source(t), lang_target(t), t.documents.select("lang").distinct())


@query("v11_overlay", f"SELECT d.doc_id AS k, sha1(coalesce(t.value, d.text)) AS text_hash FROM documents d LEFT JOIN ({TARGET_SQL}) t ON t.k = d.doc_id")
def v11(t):
    return op.overlay(source(t), target(t)).select("k", F.sha1(F.col("value").cast("binary")).alias("text_hash"))


@query(
    "v12_derived_rows",
    """SELECT k, arg_max(value, part * 1000000000000 + ord) AS value FROM (SELECT 'names.' || p_name AS k, p_type AS value, 0 AS part, p_partkey AS ord FROM part
    UNION ALL SELECT 'names.' || p_name, p_brand, 1, p_partkey FROM part WHERE p_size < 5 UNION ALL SELECT 'regions.' || n_nationkey || '.name', n_name, 2, n_nationkey FROM nation) GROUP BY 1""",
)
def v12(t):
    return op.last_write(
        t.part.selectExpr("concat('names.', p_name) AS k", "p_type AS value", "p_partkey AS ord"),
        t.part.where("p_size < 5").selectExpr("concat('names.', p_name) AS k", "p_brand AS value", "p_partkey AS ord"),
        t.nation.selectExpr("concat('regions.', n_nationkey, '.name') AS k", "n_name AS value", "n_nationkey AS ord"),
    )


@query(
    "v13_work_batches",
    f"SELECT CAST(floor((rn - 1) / 60) AS BIGINT) AS batch, count(*) AS keys, CAST(sum(length(value)) AS BIGINT) AS chars, CAST(ceil(sum(length(value)) / 3.5::DOUBLE) AS BIGINT) AS est_tokens FROM (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM ({NEEDS_SQL})) GROUP BY 1",
)
def v13(t):
    return op.work_batches(op.needs_work(source(t), target(t)), "k", F.floor(F.col("k") / 256))
