"""Place index build: feature filter, display names, search keys, shards and derived lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solstice.functions import grid
from solstice.functions.joins import dim_join
from solstice.functions.text import norm_text
from solstice.sources import keyed, sinks
from solstice.sources.scratch import stored

# Place codes kept, languages of alternate names, index limits.
PLACE_CODES = ["PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLA5", "PPLC", "PPLCH", "PPLF", "PPLG", "PPLL", "PPLR", "PPLS", "STLMT"]
AREA_CODES = ["ADM1", "ADM2"]
LANGUAGES = [
    "en", "es", "fr", "ar", "zh", "ru", "pt", "id", "hi", "bn", "sw", "vi", "tl", "am", "my", "th",
    "ur", "ne", "si", "ta", "km", "lo", "ja", "ko", "fa", "so", "ti", "mg", "ht", "tpi", "ha", "bm",
    "wo", "sm", "to", "fj", "bi", "abbr",
]
MAX_SHARD, MAX_DEPTH = 12_000, 9
ALT_CAP, ALT_CAP_LARGE, LARGE_POP = 20, 40, 50_000
NEAR_CAP = 30
MAJOR_POP = 100_000


def keep_features(places: DataFrame, place_codes: Sequence[str] = PLACE_CODES, area_codes: Sequence[str] = AREA_CODES) -> DataFrame:
    return places.where(
        ((F.col("fclass") == "P") & F.col("fc").isin(list(place_codes))) | ((F.col("fclass") == "A") & F.col("fc").isin(list(area_codes)))
    )


def with_admin_names(places: DataFrame, admin1: DataFrame, admin2: DataFrame) -> DataFrame:
    """Add display names ``a1, a2`` from code tables ``(code, name)``; unknown codes give ''."""
    keyed = places.withColumns({"_k1": F.concat_ws(".", "cc", "adm1"), "_k2": F.concat_ws(".", "cc", "adm1", "adm2")})
    out = dim_join(keyed, admin1.select(F.col("code").alias("_k1"), F.col("name").alias("_n1")), "_k1", "left")
    out = dim_join(out, admin2.select(F.col("code").alias("_k2"), F.col("name").alias("_n2")), "_k2", "left")
    return out.select(*places.columns, F.coalesce("_n1", F.lit("")).alias("a1"), F.coalesce("_n2", F.lit("")).alias("a2"))


def alternate_names(alternates: DataFrame, places: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``id, name`` of the alternate names kept per place.

    Listed languages and untagged names, no historic ones, distinct by text, the first 20 in file
    order (40 for large places). The ranking is cut before the shuffle, so one place with very
    many names does not concentrate in one task.
    """
    kept = alternates.where((F.col("lang").isin(list(languages)) | (F.col("lang") == "")) & (F.coalesce("historic", F.lit("")) != "1"))
    first = kept.groupBy("id", "name").agg(F.min("alt_id").alias("alt_id"))
    order = Window.partitionBy("id").orderBy("alt_id", "name")
    ranked = first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= ALT_CAP_LARGE)
    cap = F.when(F.col("pop") >= LARGE_POP, ALT_CAP_LARGE).otherwise(ALT_CAP)
    return ranked.join(places.select("id", "pop"), "id").where(F.col("rn") <= cap).select("id", "name", "rn")


def search_keys(places: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """Distinct ``k, id`` of the search forms of name, ASCII name and alternate names."""
    names = places.select("id", F.col("name").alias("raw"))
    if "ascii" in places.columns:
        names = names.unionByName(places.select("id", F.col("ascii").alias("raw")))
    if alternates is not None:
        names = names.unionByName(alternates.select("id", F.col("name").alias("raw")))
    return names.distinct().select(norm_text(F.col("raw")).alias("k"), "id").where(F.char_length("k") >= 2).distinct()


def _is_plain(k: Column) -> Column:
    return k.rlike("^[a-z0-9]")


def shard_key(k: Column, depth: int | Column = 2) -> Column:
    """Prefix that names a shard: characters for Latin keys, hex code points for other scripts."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    n = F.when(depth <= 2, 1).otherwise(F.least(depth - 1, F.char_length(k)))
    points = F.transform(F.slice(F.split(k, ""), F.lit(1), n), lambda c: F.format_string("%04x", F.ascii(c)))
    plain = F.regexp_replace(F.substring(k, F.lit(1), depth), r"\s", "_")
    return F.when(F.char_length(k) > 0, F.when(_is_plain(k), plain).otherwise(F.concat(F.lit("u"), F.array_join(points, "_"))))


def top_shard(k: Column) -> Column:
    """First character (Latin) or first code point: the shard of the major-places list."""
    return F.when(_is_plain(k), F.substring(k, 1, 1)).otherwise(shard_key(k, 2))


def assign_shards(keys: DataFrame, max_rows: int = MAX_SHARD, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Add ``shard``: the shortest prefix (2..max_depth) whose group has at most ``max_rows`` keys, else the longest.

    Counting runs on distinct stems, which partial aggregation shrinks before any shuffle.
    """
    stem = F.substring("k", 1, max_depth)
    stems = keys.groupBy(stem.alias("_stem")).agg(F.count("*").alias("_n"))
    prefixes = stems.withColumn("_d", F.explode(F.sequence(F.lit(2), F.lit(max_depth)))).withColumn("_p", shard_key(F.col("_stem"), F.col("_d")))
    sizes = prefixes.groupBy("_d", "_p").agg(F.sum("_n").alias("_size"))
    fits = (F.col("_size") <= max_rows) | (F.col("_d") == max_depth)
    chosen = (
        prefixes.join(sizes, ["_d", "_p"]).groupBy("_stem")
        .agg(F.min(F.when(fits, F.struct(F.col("_d").alias("depth"), F.col("_p").alias("shard")))).alias("_c"))
        .select("_stem", "_c.shard", "_c.depth")
    )
    # the stem table is as costly as this join, so its size is left to the adaptive planner, which
    # broadcasts it when it turns out small and splits the tasks of a hot stem otherwise
    return keys.withColumn("_stem", stem).join(chosen, "_stem").drop("_stem")


def shard_payloads(keys: DataFrame, places: DataFrame, max_rows: int = MAX_SHARD) -> DataFrame:
    """``shard, part, doc``: places once by id and ``[key, id]`` pairs, keys ordered by falling population.

    A shard that could not be split below ``max_rows`` is written in several parts, so no group
    grows past that size.
    """
    sizes = keys.groupBy("shard").agg(F.ceil(F.count("*") / max_rows).alias("_parts"))
    parted = keys.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("k", "id"), F.col("_parts")).cast("int"))
    full = parted.join(places.select("id", "name", "cc", "a1", "a2", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "pop"), "id")
    row = F.struct((-F.col("pop")).alias("o"), "id", "k", F.struct("name", "cc", "a1", "a2", "lat", "lon", "pop").alias("p"))
    docs = full.groupBy("shard", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    p = F.map_from_entries(F.array_distinct(F.transform("rows", lambda r: F.struct(r["id"], r["p"]))))
    k = F.transform("rows", lambda r: F.struct(r["k"].alias("k"), r["id"].alias("id")))
    return docs.select("shard", "part", F.size("rows").alias("n"), F.to_json(F.struct(p.alias("p"), k.alias("k"))).alias("doc"))


PAYLOAD = ("name", "cc", "a1", "a2", "lat", "lon", "pop")


def shard_digests(keys: DataFrame, places: DataFrame) -> DataFrame:
    """``shard, n, d1, d2``: number and digest of everything a shard's documents hold, whatever the order of rows.

    Sums of two hashes of every row, added up before the shuffle.
    """
    full = keys.select("shard", "k", "id").join(places.select("id", "name", "cc", "a1", "a2", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "pop"), "id")
    # a null and the empty text have hashes of their own
    told = [c for name in ("k", "id", *PAYLOAD) for c in (F.col(name).isNull(), F.col(name))]
    added = [F.sum(F.xxhash64(F.lit(seed), *told).cast("decimal(38,0)")).alias(f"d{seed}") for seed in (1, 2)]
    return full.groupBy("shard").agg(F.count("*").alias("n"), *added)


def changed_shards(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """``shard, gone``: shards whose digest differs from the one before, new ones, and (gone) those that no key names any more."""
    if before is None:
        return now.select("shard", F.lit(False).alias("gone"))
    left, right = now.alias("a"), before.alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.d1").eqNullSafe(F.col("b.d1")) & F.col("a.d2").eqNullSafe(F.col("b.d2"))
    joined = left.join(right, F.col("a.shard") == F.col("b.shard"), "full").where(~same)
    return joined.select(F.coalesce("a.shard", "b.shard").alias("shard"), F.col("a.shard").isNull().alias("gone"))


def update_shards(keys: DataFrame, places: DataFrame, root: str, max_rows: int = MAX_SHARD, n_parts: int = 64, gates: Sequence[sinks.Measure] = ()) -> DataFrame:
    """Bring the shard documents under ``root`` up to date; returns the shards that were rewritten (``shard, gone``).

    ``keys`` has ``k, id, shard`` of the whole build. Documents are made for changed shards only and put into a keyed table
    (``shard, part``); the others keep their files but for those that share one of its ``n_parts`` folders with a changed shard. The
    digests follow the documents, so an update that stopped in between is done again. Documents that ``gates`` refuse change nothing.
    """
    spark = keys.sparkSession
    digests, documents = f"{root}/digests", f"{root}/documents"
    # digests and documents both read the keys, which may be a whole job
    keys = stored(keys.select("k", "id", "shard"), "sharded-keys")
    now = stored(shard_digests(keys, places), "shard-digests")
    changed = stored(changed_shards(now, keyed.read(spark, digests)), "changed-shards")
    wanted = keys.join(changed.where("NOT gone").select("shard"), "shard", "left_semi")
    fresh = stored(shard_payloads(wanted, places, max_rows).withColumn("gone", F.lit(False)), "shard-documents")
    standing = keyed.read(spark, documents)
    rows = fresh
    if standing is not None:
        # parts of changed shards that the new documents no longer have
        old = standing.join(changed.select("shard"), "shard", "left_semi").join(fresh.select("shard", "part"), ["shard", "part"], "left_anti")
        rows = fresh.unionByName(old.withColumn("gone", F.lit(True)))
    keyed.upsert(rows, documents, ["shard", "part"], gone="gone", n_parts=n_parts, gates=gates)
    lost = changed.where("gone").select("shard", F.lit(True).alias("gone"))
    keyed.upsert(now.join(changed.where("NOT gone"), "shard").unionByName(lost, allowMissingColumns=True), digests, ["shard"], gone="gone", n_parts=min(n_parts, 8))
    return changed


def current_documents(spark: SparkSession, root: str) -> DataFrame | None:
    """``shard, part, n, doc`` as the last update left them."""
    return keyed.read(spark, f"{root}/documents")


def major_places(places: DataFrame, min_pop: int = MAJOR_POP) -> DataFrame:
    """Key rows of the large places with their list, ``top_shard``."""
    big = places.where(F.col("pop") >= min_pop)
    return search_keys(big).join(big, "id").withColumn("top_shard", top_shard(F.col("k")))


def top_places_per_cell(places: DataFrame, keep: int = NEAR_CAP) -> DataFrame:
    order = Window.partitionBy("cell_id").orderBy(F.col("pop").desc(), "id")
    placed = places.withColumn("cell_id", grid.cell_id(F.col("lat"), F.col("lon")))
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def places_per_cell(places: DataFrame, keep: int = NEAR_CAP) -> DataFrame:
    """``cell_id, places``: at most ``keep`` places per cell as an array."""
    top = top_places_per_cell(places, keep)
    item = F.struct("rank", "id", "name", "cc", "a1", "lat", "lon", "pop")
    return top.groupBy("cell_id").agg(F.array_sort(F.collect_list(item)).alias("places"))


def large_cities(places: DataFrame, min_pop: int = MAJOR_POP, code_prefix: str = "PPL") -> DataFrame:
    kept = places.where((F.col("pop") >= min_pop) & F.col("fc").startswith(code_prefix))
    return kept.select("id", "name", "cc", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "pop").orderBy(F.col("pop").desc(), "id")


def country_index(cities: DataFrame, countries: DataFrame, services: DataFrame, fallback: tuple[str, str]) -> DataFrame:
    """One row per country and city name (largest kept) with country name and weather service."""
    best = cities.groupBy("cc", "name").agg(F.max(F.struct("pop", (-F.col("id")).alias("nid"))).alias("_b"))
    named = dim_join(best, countries.select(F.col("cc"), F.col("name").alias("country")), "cc", "left")
    served = dim_join(named, services.select("cc", F.col("name").alias("_service"), F.col("url").alias("_url")), "cc", "left")
    return served.select(
        "cc", F.coalesce("country", "cc").alias("country"), "name", (-F.col("_b.nid")).alias("id"), F.col("_b.pop").alias("pop"),
        F.coalesce("_service", F.lit(fallback[0])).alias("service"), F.coalesce("_url", F.lit(fallback[1])).alias("service_url"),
    ).orderBy("country", F.col("pop").desc(), "name")


def with_place_key(places: DataFrame) -> DataFrame:
    """Add ``place_key``: one real-world place, whichever row describes it (quarter-degree position)."""

    def quarter(x: Column) -> Column:
        return F.format_string("%.2f", F.floor(x * 4 + 0.5) / 4)

    key = F.concat_ws(
        "|", norm_text(F.col("name")), F.coalesce("cc", F.lit("")), norm_text(F.coalesce("a1", F.lit(""))), quarter(F.col("lat")), quarter(F.col("lon"))
    )
    return places.withColumn("place_key", key)
