"""Association-rule URL filter (operator 6).

Fixed rules on (host, path) come first; the longest that fits decides. Other URLs go to rules mined by FP-growth: the
host labels, path segments, extension and query keys of labelled URLs are items, and a rule says that a set of them goes
with a bad label. Rules are kept at a minimum of support and confidence, and dropped where a rule on a subset has at
least the same confidence. An inverted index from each rule's rarest token finds the rules that may fit a URL; a set
test decides. URLs with the same tokens are judged once.

Null URLs and those without "://" have empty host and path, no tokens, and are allowed. Repeated rows each get their row.
Without labels, or with too few, nothing is mined and all URLs outside the fixed rules are allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and a path prefix.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]] = HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, prefix = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens; runs of digits inside a token become #."""
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "#")))
    last = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    segments = F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")
    return F.array_sort(F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", segments), named("x:", F.array(last)), named("q:", keys))))


def mine(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float) -> DataFrame:
    """Rules (tokens, confidence, support) for the bad label from (tokens, bad)."""
    spark = labelled.sparkSession
    n = labelled.count()
    if n < min_count:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def indexed(rules: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One index entry (key, tokens, confidence) per rule, under its rarest token."""
    by_token = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(frequencies, "token", "left")
    return by_token.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("key"))


def matches(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens, rule, confidence) for every rule whose tokens all stand in a set."""
    found = sets.select("tokens", F.explode("tokens").alias("key")).join(index.select("key", F.col("tokens").alias("rule"), "confidence"), "key")
    return found.filter(F.size(F.array_except("rule", "tokens")) == 0).select("tokens", "rule", "confidence")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", min_support: float = 0.0005, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_tokens (the mined rule that fits best) for every row.

    `labels` is (id, bad). Ties between mined rules go to the higher confidence, then the longer and the greater rule.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    marks = labels.select(F.col("id").alias("page_id"), "bad").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rules = mine(rows.join(marks, "page_id").select("tokens", "bad"), min_support, min_count, min_confidence)
    sets = rows.filter("fixed is null and size(tokens) > 0").groupBy("tokens").agg(F.count("*").alias("n"))
    frequencies = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    index = indexed(rules, frequencies)
    covered = matches(index.select("tokens"), index).join(index.select("tokens", F.col("confidence").alias("own")), "tokens").filter((F.size("rule") < F.size("tokens")) & (F.col("confidence") >= F.col("own")))
    pruned = index.join(covered.select("tokens"), "tokens", "left_anti")
    best = matches(sets.select("tokens"), pruned).groupBy("tokens").agg(F.max_by("rule", F.struct("confidence", F.size("rule"), "rule")).alias("bad_tokens"))
    judged = rows.join(best, "tokens", "left")
    by_method = F.when(F.col("bad_tokens").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", by_method).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("bad_tokens")).alias("bad_tokens"))
