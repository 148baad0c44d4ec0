"""Versioned text catalogs: flattening, deltas, updates and reviews, all as joins.

A source catalog has ``k, value``; a target has ``k, value, src_hash, mt`` (and ``lang`` where
several languages are handled at once).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions.joins import dim_join
from solstice.functions.text import slot_signature

BATCH_KEYS = 60


def source_hash(value: Column) -> Column:
    return F.substring(F.sha1(value.cast("binary")), 1, 10)


def flatten(docs: DataFrame, keys: Sequence[str], doc: str = "doc", join_lists: bool = False) -> DataFrame:
    """Nested JSON documents to ``keys, k, value`` with dotted paths; keys that start with ``_`` are skipped.

    Lists are leaves: JSON text, or joined with `` | ``. Every level replaces an object by its
    entries and passes leaves through, so the documents are never shuffled. The number of levels is
    that of the deepest document, read off the brackets outside of strings in a first pass.
    """
    brackets = F.regexp_replace(F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*"', ""), r"[^{}\[\]]", "")
    # documents have few shapes, so the brackets are counted per shape
    shapes = docs.select(brackets.alias("_b")).distinct()
    steps = F.transform(F.split("_b", ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    deepest = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))["most"]
    max_depth = shapes.agg(F.max(deepest)).first()[0] or 0
    level = docs.select(*keys, F.lit("").alias("k"), F.parse_json(doc).alias("v"))
    for _ in range(max_depth):
        entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        leaf = F.array(F.struct(F.lit("").alias("key"), F.col("v").alias("value")))
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        level = level.select(*keys, "k", F.explode(F.when(is_object, entries).otherwise(leaf)).alias("e")).where(~F.col("e.key").startswith("_"))
        joint = F.when((F.col("k") != "") & (F.col("e.key") != ""), ".").otherwise("")
        level = level.select(*keys, F.concat("k", joint, "e.key").alias("k"), F.col("e.value").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    listed = F.array_join(F.try_variant_get("v", "$", "array<string>"), " | ") if join_lists else F.to_json("v")
    return level.select(*keys, "k", F.when(is_list, listed).otherwise(F.try_variant_get("v", "$", "string")).alias("value"))


def unflatten(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, doc``: dotted paths back to one nested JSON document per group.

    Every level folds the deepest paths into objects of their parents and passes the rest
    through; a document holds as many entries as its catalog has keys. A first pass finds the
    longest path.
    """
    max_depth = rows.agg(F.max(F.size(F.split("k", r"\.")))).first()[0] or 0
    text = F.variant_get(F.parse_json(F.to_json(F.struct(F.col("value").alias("x")))), "$.x", "variant")
    level = rows.select(*keys, F.split("k", r"\.").alias("p"), text.alias("v"))
    for depth in range(max_depth, 0, -1):
        deep = F.size("p") == depth
        placed = level.select(
            *keys, deep.alias("deep"), F.when(deep, F.slice("p", F.lit(1), F.lit(depth - 1))).otherwise(F.col("p")).alias("p"),
            F.struct(F.element_at("p", -1).alias("key"), F.col("v").alias("value")).alias("entry"),
        )
        grouped = placed.groupBy(*keys, "p", "deep").agg(F.collect_list("entry").alias("e"))
        folded = F.parse_json(F.to_json(F.map_from_entries("e")))
        level = grouped.select(*keys, "p", F.when(F.col("deep"), folded).otherwise(F.get("e", F.lit(0))["value"]).alias("v"))
    return level.select(*keys, F.to_json("v").alias("doc"))


def needs_work(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows whose key is missing in the target, has no hash, or was changed since."""
    known = target.select("k", F.col("src_hash").alias("_hash"))
    reason = F.when(F.col("_hash").isNull(), "missing").when(F.col("_hash") != source_hash(F.col("value")), "changed")
    return source.join(known, "k", "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("_hash")


def stale_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    return target.join(source.select("k"), "k", "left_anti")


def apply_translations(source: DataFrame, target: DataFrame, translations: DataFrame, list_keys: DataFrame | None = None) -> DataFrame:
    """New target: known translated keys replaced and stamped, stale keys gone, untranslated lists from the source.

    A MERGE written as joins: the old target is read, never changed.
    """
    old = target.select("k", F.col("value").alias("_old"), F.col("src_hash").alias("_hash"), F.col("mt").alias("_mt"))
    new = translations.select("k", F.col("value").alias("_new"))
    rows = source.join(old, "k", "left").join(new, "k", "left")
    lists = F.lit(False)
    if list_keys is not None:
        rows = rows.join(list_keys.select("k", F.lit(True).alias("_list")), "k", "left")
        lists = F.coalesce("_list", F.lit(False))
    fresh = F.col("_new").isNotNull()
    value = F.coalesce("_new", "_old", F.when(lists, F.col("value")))
    return rows.select(
        "k", value.alias("value"), F.when(fresh, source_hash(F.col("value"))).otherwise(F.col("_hash")).alias("src_hash"),
        F.when(fresh, True).otherwise(F.col("_mt")).alias("mt"),
    ).where("value IS NOT NULL")


def translation_changes(source: DataFrame, target: DataFrame, translations: DataFrame, list_keys: DataFrame | None = None) -> DataFrame:
    """What ``apply_translations`` changes: rows to put in place, and keys to take away (``gone``), for a keyed table."""
    new = apply_translations(source, target, translations, list_keys)
    old = target.select("k", F.struct(*[F.col(c) for c in ("value", "src_hash", "mt")]).alias("_old"))
    put = new.join(old, "k", "left").where(~F.struct("value", "src_hash", "mt").eqNullSafe(F.col("_old"))).select(*new.columns, F.lit(False).alias("gone"))
    away = target.join(new.select("k"), "k", "left_anti").select(*new.columns, F.lit(True).alias("gone"))
    return put.unionByName(away)


def check_fixes(source: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes with ``status``: unknown key, slot mismatch or applied."""
    known = source.select("k", F.col("value").alias("_src"))
    status = (
        F.when(F.col("_src").isNull(), "unknown key").when(slot_signature(F.col("fix")) != slot_signature(F.col("_src")), "slot mismatch").otherwise("applied")
    )
    return fixes.join(known, "k", "left").withColumn("status", status).drop("_src")


def fix_report(checked: DataFrame, by: str = "lang") -> DataFrame:
    return checked.groupBy(by).agg(F.count("*").alias("proposed"), F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") != "applied").alias("skipped"))


def import_review(target: DataFrame, review: DataFrame, source: DataFrame) -> DataFrame:
    """Non-empty reviewed rows of known keys replace the text and clear the machine flag."""
    done = review.where(F.trim("translation") != "").join(source.select("k"), "k", "left_semi").select("lang", "k", F.trim("translation").alias("_t"))
    rows = target.join(done, ["lang", "k"], "left")
    return rows.select("lang", "k", F.coalesce("_t", "value").alias("value"), "src_hash", F.when(F.col("_t").isNotNull(), False).otherwise(F.col("mt")).alias("mt"))


def language_status(target: DataFrame) -> DataFrame:
    """``reviewed`` once no machine-translated row is left."""
    return target.groupBy("lang").agg(F.when(F.bool_or("mt"), "machine").otherwise("reviewed").alias("status"))


def review_sheet(source: DataFrame, target: DataFrame, languages: DataFrame) -> DataFrame:
    """Every key in every language with its translation and status: the product is what is asked for."""
    grid = source.select("k", F.col("value").alias("english")).crossJoin(languages.select("lang"))
    rows = grid.join(target.select("lang", "k", F.col("value").alias("translation"), "mt"), ["lang", "k"], "left")
    status = F.when(F.col("mt").isNull(), "pending").when(F.col("mt"), "machine").otherwise("reviewed")
    return rows.select("lang", "k", "english", F.coalesce("translation", F.lit("")).alias("translation"), status.alias("status"))


def language_rollup(source: DataFrame, target: DataFrame, languages: DataFrame, source_lang: str = "en", max_pending: float = 0.25) -> DataFrame:
    """Pending keys per language, the source language first, and whether coverage is enough to ship.

    Pending is what is left of all keys after those that a language has, so no row per key and language is made.
    """
    total = source.agg(F.count("*").alias("keys"))
    done = target.where("mt IS NOT NULL").join(source.select("k"), "k", "left_semi").groupBy("lang").agg(F.count("*").alias("_done"))
    counts = languages.select("lang").join(done, "lang", "left").join(F.broadcast(total), how="cross")
    counts = counts.select("lang", (F.col("keys") - F.coalesce("_done", F.lit(0))).alias("pending"), "keys")
    out = counts.withColumn("ships", F.col("pending") < F.col("keys") * max_pending)
    return out.orderBy((F.col("lang") != source_lang).cast("int"), "lang")


def overlay(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target text where there is one, else the source text, key by key."""
    rows = source.select("k", F.col("value").alias("_s")).join(target.select("k", F.col("value").alias("_t")), "k", "left")
    return rows.select("k", F.coalesce("_t", "_s").alias("value"))


def last_write(*parts: DataFrame) -> DataFrame:
    """Union of ``k, value, ord`` rows, the highest ``ord`` of the latest part wins per key."""
    rows = None
    for i, part in enumerate(parts):
        part = part.select("k", "value", F.struct(F.lit(i).alias("part"), F.col("ord").cast("bigint").alias("ord"), F.col("value").alias("v")).alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("k").agg(F.max("_o").alias("_o")).select("k", F.col("_o.v").alias("value"))


def numbered(df: DataFrame, order: str, block: Column, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rn``, the 0-based position in order, without one task sorting a whole group.

    ``block`` must not fall as ``order`` rises. Rows are numbered inside blocks and shifted by the
    sizes of the earlier blocks, a table with one row per block.
    """
    by = list(by)
    blocked = df.withColumn("_b", block)
    sizes = blocked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = blocked.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order)) - 1)
    return dim_join(inside, offsets, [*by, "_b"]).withColumn("rn", F.col("_r") + F.col("_off")).drop("_r", "_off", "_b")


def work_batches(rows: DataFrame, order: str, block: Column, size: int = BATCH_KEYS) -> DataFrame:
    """``batch, keys, chars, est_tokens``: work cut into batches of ``size`` keys with a size estimate."""
    batched = numbered(rows, order, block).withColumn("batch", F.floor(F.col("rn") / size))
    chars = F.sum(F.char_length("value"))
    return batched.groupBy("batch").agg(F.count("*").alias("keys"), chars.alias("chars"), F.ceil(chars / 3.5).alias("est_tokens"))
