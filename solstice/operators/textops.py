"""Operators over text columns: bulletins, lint findings, URL inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solstice.functions import text as tx

# Markers and patterns of the bulletin page.
STATUS_MARK = "(?i)ENSO Alert System Status"
SYNOPSIS_MARK = "(?i)^Synopsis:?$"
ISSUED_LINE = r"^\d{1,2} [A-Z][a-z]+ \d{4}$"
STRENGTH_WORDS = "(?i)(very strong|strong|moderate|weak)"


def parse_bulletin(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the bulletin's fields and the enums derived from them."""
    lines = F.col("_lines")
    chance = F.get(F.filter(lines, lambda x: x.rlike("(?i)chance") & x.contains("%")), F.lit(0))
    out = pages.withColumn("_lines", tx.html_lines(F.col(html))).withColumns(
        {
            "issued": tx.first_line(lines, ISSUED_LINE), "status": tx.line_after(lines, STATUS_MARK), "synopsis": tx.line_after(lines, SYNOPSIS_MARK),
            "headline_probability_pct": F.regexp_extract(chance, r"(\d{2,3})\s?%", 1).try_cast("int"),
        }
    )
    status = F.coalesce("status", F.lit(""))
    strength = F.lower(F.regexp_extract(F.coalesce("synopsis", F.lit("")), STRENGTH_WORDS, 1))
    return out.withColumns(
        {
            "phase": phase(status),
            "level": F.when(status.rlike("(?i)Advisory"), "advisory").when(status.rlike("(?i)Watch"), "watch").otherwise("none"),
            "expected_strength": F.when(strength != "", strength),
        }
    ).drop("_lines")


def phase(status: Column) -> Column:
    """A line that names both phases counts as the warm one."""
    return F.when(status.rlike("(?iu)El Niño"), "el_nino").when(status.rlike("(?iu)La Niña"), "la_nina").otherwise("neutral")


BANNED_FIRST = "".join(sorted({w.lstrip("(?:")[0] for w in tx.BANNED.split("|")}))


def lint(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Findings ``key, severity, rule, match`` of the editorial rules; one row per finding."""
    prepared = texts.select(F.col(key).alias("key"), F.col(text).alias("t"), tx.strip_slots_and_emoji(F.col(text)).alias("c"))
    # the look-ahead for a first letter lets most positions of the text fail at once
    banned = F.regexp_extract("c", f"(?i)(?=[{BANNED_FIRST}]){tx.EDGE_L}({tx.BANNED}){tx.EDGE_R}", 1)
    capitals = F.regexp_extract_all("c", F.lit(f"(?=[A-Z]{{3}}){tx.EDGE_L}([A-Z]{{3,}}){tx.EDGE_R}"), F.lit(1))
    countdown = F.regexp_extract("c", rf"(?i)(?=\d){tx.EDGE_L}(\d+\s*(?:seconds|minutes|hours|days) (?:left|remaining)){tx.EDGE_R}", 1)
    long_ones = F.filter(F.transform(tx.sentences(F.col("c")), tx.word_count), lambda n: n > tx.MAX_SENTENCE_WORDS)
    allowed = F.array(*[F.lit(w) for w in tx.ALLOWED_CAPITALS])

    def found(severity: str, rule: str, match: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), match.alias("match"))

    def one(severity: str, rule: str, match: Column) -> Column:
        return F.when(match != "", F.array(found(severity, rule, match))).otherwise(F.array().cast(FINDINGS))

    findings = F.concat(
        F.when(F.col("t").contains("!"), F.array(found("fail", "exclamation", F.lit("!")))).otherwise(F.array().cast(FINDINGS)),
        one("fail", "banned word", banned),
        F.transform(F.filter(capitals, lambda w: ~F.array_contains(allowed, w)), lambda w: found("fail", "capitals", w)),
        one("fail", "countdown", countdown),
        F.transform(long_ones, lambda n: found("warn", "long sentence", n.cast("string"))),
    )
    return prepared.select("key", F.explode(findings).alias("f")).select("key", "f.*")


FINDINGS = "array<struct<severity:string,rule:string,match:string>>"


def url_inventory(texts: DataFrame, where: str, order: str, text: str = "text") -> DataFrame:
    """Distinct URLs with the last place each was seen; a final point or comma is not part of a URL."""
    urls = F.explode(F.regexp_extract_all(text, F.lit(r"(https?://[^\s|)`]+)"), F.lit(1)))
    rows = texts.select(F.col(where).alias("where"), F.col(order).alias("_o"), urls.alias("url"))
    rows = rows.withColumn("url", F.regexp_replace("url", "[.,]$", ""))
    return rows.groupBy("url").agg(F.max(F.struct("_o", "where")).alias("_w")).select("url", "_w.where")


# Fixed value: the tags and attributes that count as loading a resource.
RESOURCE = r'<(script|link|img|iframe|video|audio)[^>]+(?:src|href)="(?:https?:)?//([^/"]+)[^"]*"'


def external_resources(pages: DataFrame, html: str = "html", own_hosts: Sequence[str] = ()) -> DataFrame:
    """``tag, host`` of every resource a page loads from another host; adds to the page's columns."""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(RESOURCE), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(RESOURCE), F.lit(2)).alias("host")
    )
    rows = pages.withColumn("_r", F.explode(found)).select(*[c for c in pages.columns if c != html], "_r.tag", "_r.host")
    return rows.where(~F.col("host").isin(list(own_hosts))) if own_hosts else rows


def disallowed_urls(urls: DataFrame, allowed_prefixes: DataFrame, url: str = "url") -> DataFrame:
    """URLs that start with none of the listed prefixes.

    Every distinct URL is cut to each length that occurs among the prefixes (as many as the longest has
    characters, at most) and meets them by equality.
    """
    allowed = allowed_prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    lengths = allowed.agg(F.array_sort(F.collect_set(F.char_length("prefix"))).alias("_n"))
    starts = urls.select(F.col(url).alias("_url")).distinct().join(F.broadcast(lengths), how="cross").select("_url", F.explode("_n").alias("_n"))
    listed = starts.where(F.char_length("_url") >= F.col("_n")).withColumn("prefix", F.substring(F.col("_url"), F.lit(1), F.col("_n"))).join(allowed, "prefix", "left_semi")
    return urls.join(listed.select("_url").distinct(), F.col(url) == F.col("_url"), "left_anti")
