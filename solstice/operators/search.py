"""Typo-tolerant place search for a whole table of queries at once.

Names and queries are reduced to distinct strings first. A query meets a key through an equal prefix or,
inside the same block, through a shared form: a deletion variant where the strings are short, an equal
segment where they are long. The forms of a string are bounded in number, their characters linear in its
length, and no block ever pairs every query with every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solstice.functions.joins import dim_join
from solstice.functions.text import deletions, edit_distance, norm_text
from solstice.operators.gazetteer import MAJOR_POP, search_keys, shard_key, top_shard, with_place_key

# Fixed values of the ranking.
MIN_QUERY = 2
PER_COUNTRY, LIMIT = 3, 8
#: Up to this length behind a block's shared start, deletion variants are few; beyond it, segments are selective.
SHORT = 8


def prepare_queries(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Add the search form ``q``; queries shorter than two characters are dropped."""
    return raw.withColumn("q", norm_text(F.col(text))).where(F.char_length("q") >= MIN_QUERY)


def pick_shard(queries: DataFrame, shards: DataFrame, max_depth: int = 6) -> DataFrame:
    """Longest existing shard prefix per query, from ``max_depth`` down to 2; null when there is none."""
    tries = queries.select("q").distinct().withColumn("depth", F.explode(F.sequence(F.lit(2), F.lit(max_depth))))
    tries = tries.where((F.col("depth") == 2) | (F.char_length("q") >= F.col("depth"))).withColumn("shard", shard_key(F.col("q"), F.col("depth")))
    found = dim_join(tries, shards.select("shard").distinct(), "shard", "left_semi")
    best = found.groupBy("q").agg(F.max_by("shard", "depth").alias("shard"))
    return queries.join(best, "q", "left")


def expand_payloads(payloads: DataFrame) -> DataFrame:
    """Flat rows of shard documents; ids without a place are dropped."""
    schema = (
        "p MAP<STRING, STRUCT<name: STRING, cc: STRING, a1: STRING, a2: STRING, lat: DOUBLE, lon: DOUBLE, pop: BIGINT>>,"
        " k ARRAY<STRUCT<k: STRING, id: BIGINT>>"
    )
    docs = payloads.withColumn("d", F.from_json("doc", schema)).select("shard", "d.p", F.explode("d.k").alias("e"))
    rows = docs.select("shard", F.col("e.k").alias("k"), F.col("e.id").alias("id"), F.element_at("p", F.col("e.id").cast("string")).alias("pl"))
    return rows.where("pl IS NOT NULL").select("shard", "k", "id", "pl.*")


def allowed_edits(length: Column) -> Column:
    return F.when(length >= 7, 2).when(length >= 4, 1).otherwise(0)


def _blocks(text: Column, major: Column) -> Column:
    """Blocks of a string: ``via``, name and the number of leading characters all members share."""
    shard = F.struct(F.lit("shard").alias("via"), F.concat(F.lit("s:"), shard_key(text, 2)).alias("block"), F.when(text.rlike("^[a-z0-9]"), 2).otherwise(1).alias("shared"))
    top = F.struct(F.lit("major").alias("via"), F.concat(F.lit("m:"), top_shard(text)).alias("block"), F.lit(1).alias("shared"))
    return F.when(major, F.array(shard, top)).otherwise(F.array(shard))


def _swapped(text: Column, at: Column) -> Column:
    """``text`` with the two characters around position ``at`` in each other's place."""
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)), F.substring(text, at + 2, F.char_length(text)))


def _segments(rest: Column, whole: Column) -> Column:
    """Tagged forms of a key's text of which every query within the allowed distance has one, see ``_asked_segments``.

    As long as the query (``whole``), two edits may part them: cut in three, one segment is intact, unless a swap lies
    over an edge. Then both edges are swapped, or one is and the edit beside it leaves the two segments around
    that edge as they are after the swap. One shorter, the query has one more character, and one half is intact.
    """
    n = F.char_length(rest)
    b1, b2, half = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), F.floor(n / 2).cast("int")

    def piece(tag: str, start, length) -> Column:
        return F.concat(F.lit(tag), F.substring(rest, start, length))

    thirds = F.array(
        piece("a", F.lit(1), b1), piece("b", b1 + 1, b2 - b1), piece("c", b2 + 1, n), F.concat(F.lit("x"), _swapped(_swapped(rest, b1), b2)),
        F.concat(F.lit("y"), F.substring(_swapped(rest, b1), F.lit(1), b2)), F.concat(F.lit("z"), F.substring(_swapped(rest, b2), b1 + 1, n)),
    )
    return F.when(whole, thirds).otherwise(F.array(piece("d", F.lit(1), half), piece("e", half + 1, n)))


def _asked_segments(rest: Column) -> Column:
    """The same forms from a query's side, where the segments of a key in reach may stand in it.

    Equal lengths mean that edits before the first and up to the last segment add up to no shift; the middle one moves by at most one.
    """
    n = F.char_length(rest)
    b1, b2, half = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), F.floor((n - 1) / 2).cast("int")

    def piece(tag: str, start, length) -> Column:
        return F.concat(F.lit(tag), F.substring(rest, start, length))

    return F.array(
        piece("a", F.lit(1), b1), piece("b", b1, b2 - b1), piece("b", b1 + 1, b2 - b1), piece("b", b1 + 2, b2 - b1), piece("c", b2 + 1, n),
        piece("x", F.lit(1), n), piece("y", F.lit(1), b2), piece("z", b1 + 1, n), piece("d", F.lit(1), half), piece("e", half + 2, n),
    )


def _variants(df: DataFrame, text: str, asked: bool) -> DataFrame:
    """One row per block and form of the part of ``text`` behind the block's shared start.

    ``df`` has ``_l`` (length of the query), ``_e`` (edits) and ``major``. Which kind of forms a block takes follows from
    ``_l`` and the shared start, which both sides know.
    """
    blocked = df.withColumn("_b", F.explode(_blocks(F.col(text), F.col("major"))))
    rest = F.substring(F.col(text), F.col("_b.shared") + 1, F.char_length(text))
    few = F.when(F.col("_e") == 2, deletions(rest, 2)).otherwise(deletions(rest, 1))
    many = _asked_segments(rest) if asked else _segments(rest, F.char_length(text) == F.col("_l"))
    forms = F.when(F.col("_l") - F.col("_b.shared") <= SHORT, few).otherwise(many)
    return blocked.select(*df.columns, F.col("_b.via").alias("via"), F.col("_b.block").alias("_block"), F.explode(F.array_distinct(forms)).alias("_form"))


def match_keys(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """``q, k, score, via``: keys that start with the query (score 0) or are within its edit allowance.

    ``keys`` has ``k, major``; ``via`` is ``shard`` (same two-character shard) or ``major`` (same first
    character, large places only).
    """
    q = queries.select("q").distinct()
    k = keys.groupBy("k").agg(F.bool_or("major").alias("major"))

    starts = k.withColumn("q", F.explode(F.transform(F.sequence(F.lit(MIN_QUERY), F.char_length("k")), lambda n: F.substring("k", F.lit(1), n))))
    prefix = dim_join(starts, q, ["q"]).select("q", "k", F.lit(0).alias("score"), F.lit("shard").alias("via"))

    # key side: every query length this key can answer; a key one shorter than the query is compared whole
    klen = F.char_length("k")
    lengths = F.sequence(F.greatest(F.lit(4), klen - 5), F.greatest(F.lit(4), klen + 1))
    sides = (
        k.withColumn("_l", F.explode(lengths))
        .withColumn("_e", F.when(klen < F.col("_l"), F.least(allowed_edits(F.col("_l")), F.lit(1))).otherwise(allowed_edits(F.col("_l"))))
        .where((F.abs(klen - F.col("_l")) <= allowed_edits(F.col("_l")) + 3) & (F.col("_l") - klen <= 1))
        .withColumn("_kp", F.substring("k", F.lit(1), F.col("_l")))
    )
    asked = q.withColumns({"_l": F.char_length("q"), "major": F.lit(True)}).where("_l >= 4").withColumn("_e", allowed_edits(F.col("_l")))
    key_forms = _variants(sides, "_kp", asked=False).select("k", "_kp", "_e", "via", "_block", "_l", "_form")
    query_forms = _variants(asked, "q", asked=True).select("q", "_block", "_l", "_form")
    pairs = dim_join(key_forms, query_forms, ["_block", "_l", "_form"]).select("q", "k", "_kp", "_e", "via").distinct()
    return prefix.unionByName(score_pairs(pairs)).groupBy("q", "k", "via").agg(F.min("score").alias("score"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Distance of ``q`` and ``_kp``, swaps of neighbours counting once, where it is at most ``_e`` (0..2).

    Plain edit distance decides all pairs but those where a swap could save an edit.
    """
    plain = F.levenshtein("q", "_kp")
    pairs = pairs.withColumn("_plain", plain).where(F.col("_plain") <= 2 * F.col("_e"))
    score = F.when(F.col("_plain") >= 2, edit_distance(F.col("q"), F.col("_kp"))).otherwise(F.col("_plain"))
    return pairs.withColumn("score", score).where(F.col("score") <= F.col("_e")).select("q", "k", "score", "via")


def best_per_place(matches: DataFrame, keys: DataFrame) -> DataFrame:
    """``q, id, score, k``: lowest score per query and place, then the shorter key.

    ``keys`` has ``k, id, major``; a match through the large-places list only counts for large places.
    """
    rows = keys.join(matches, "k").where((F.col("via") == "shard") | F.col("major"))
    best = rows.groupBy("q", "id").agg(F.min(F.struct("score", F.char_length("k").alias("n"), "k")).alias("_b"))
    return best.select("q", "id", "_b.score", "_b.k")


def rank_weight(score: Column, pop: Column, a1: Column, name_norm: Column, key: Column, q: Column) -> Column:
    """Lower is better. A missing province lowers the weight, as the published ranking does."""
    longer = F.least(F.char_length(key) - F.char_length(q), F.lit(8)) * 0.02
    return (
        score * 2.5 - F.log10(F.coalesce(pop, F.lit(0)) + 1) - F.when(F.coalesce(a1, F.lit("")) != "", 0.0).otherwise(0.3)
        - F.when(name_norm == q, 1.2).otherwise(0.0) + longer
    )


def weighted(best: DataFrame, places: DataFrame) -> DataFrame:
    named = with_place_key(places).withColumn("name_norm", norm_text(F.col("name")))
    rows = dim_join(best, named, "id")
    return rows.withColumn("w", F.round(rank_weight(*[F.col(c) for c in ("score", "pop", "a1", "name_norm", "k", "q")]), 9))


def diversified(rows: DataFrame, limit: int = LIMIT, per_country: int = PER_COUNTRY) -> DataFrame:
    """Best row per real place, at most three per country, best eight per query.

    Each step is a row-number limit, which Spark applies before the shuffle as well as after it.
    """
    def order(*by: str):
        return Window.partitionBy(*by).orderBy("w", "id")

    once = rows.withColumn("_r", F.row_number().over(order("q", "place_key"))).where("_r <= 1")
    spread = once.withColumn("_r", F.row_number().over(order("q", "cc"))).where(F.col("_r") <= per_country)
    return spread.withColumn("rank", F.row_number().over(order("q"))).where(F.col("rank") <= limit).drop("_r")


def search_places(queries: DataFrame, places: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ranked results ``q, rank, id, …`` for all queries."""
    keys = search_keys(places) if keys is None else keys
    with_size = keys.join(places.select("id", (F.col("pop") >= MAJOR_POP).alias("major")), "id")
    matches = match_keys(queries, with_size)
    return diversified(weighted(best_per_place(matches, with_size), places))


def result_label(a2: Column, a1: Column, country: Column) -> Column:
    parts = F.filter(F.array(a2, a1, country), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(parts), " — ")


def point_name(lat: Column, lon: Column, near_name: Column) -> Column:
    """``near X``, or the coordinates when no place is known in the cell."""
    return F.when(near_name.isNotNull(), F.concat(F.lit("near "), near_name)).otherwise(F.format_string("%.2f, %.2f", lat, lon))
