"""Text operators and the briefing."""

from pyspark.sql import functions as F

from solstice.functions import text as tx
from solstice.operators import textops as op
from solstice.plans import briefing
from solstice.plans.queries import rules as rules_q
from solstice.plans.registry import query

BLANK = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(160) || chr(65279)"


def lines_sql(html: str) -> str:
    x = f"regexp_replace(regexp_replace({html}, '<!--[\\s\\S]*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"
    for entity, char in tx.ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return f"list_filter([trim(x, {BLANK}) FOR x IN string_split({x}, chr(10))], lambda y: y <> '')"


@query("j1_html_lines", f"SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS line FROM (SELECT page_id, {lines_sql('html')} AS l FROM pages)")
def j1(t):
    return t.spread("pages", "page_id", "html").select("page_id", F.posexplode(tx.html_lines(F.col("html"))).alias("pos", "line"))


@query("a15_html_pages", "SELECT page_id, url, length(html) AS n_chars, sha1(html) AS html_hash FROM pages")
def a15(t):
    from solstice.sources.readers import read_pages

    return read_pages(t.spark, f"{t.folder}/pages.parquet").select(
        "page_id", "url", F.char_length("html").cast("bigint").alias("n_chars"), F.sha1(F.col("html").cast("binary")).alias("html_hash")
    )


# a bulletin per order: some lack the marker, name both phases or give no chance
BULLETIN = """concat('<!-- x ', o_orderkey, ' --><html><b>', CASE WHEN o_orderkey % 13 = 0 THEN 'Status' ELSE 'ENSO Alert System Status:' END, '</b><p>',
  CASE o_orderpriority WHEN '1-URGENT' THEN 'El Ni&ntilde;o Advisory' WHEN '2-HIGH' THEN 'La Ni&ntilde;a Watch' WHEN '3-MEDIUM' THEN 'Final La Ni&ntilde;a Advisory / El Ni&ntilde;o Watch' ELSE 'Not Active' END,
  '</p><i>Synopsis:</i><p>', CASE o_orderstatus WHEN 'F' THEN 'A strong-to-very strong event is likely' WHEN 'O' THEN 'A Moderate event &amp; more may follow' ELSE 'Soon' END,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat(' (', o_custkey % 120, '&#37; chance)') END, '.</p><br>', CASE WHEN o_orderkey % 17 = 0 THEN 'undated' ELSE concat(1 + o_orderkey % 28, ' November ', 1990 + o_custkey % 30) END, '</html>')"""
PARSED_SQL = f"""SELECT id, list_filter(l, lambda x: regexp_matches(x, '^\\d{{1,2}} [A-Z][a-z]+ \\d{{4}}$'))[1] AS issued, CASE WHEN sp > 0 THEN l[sp + 1] END AS status, CASE WHEN yp > 0 THEN l[yp + 1] END AS synopsis,
  TRY_CAST(nullif(regexp_extract(list_filter(l, lambda x: contains(lower(x), 'chance') AND contains(x, '%'))[1], '(\\d{{2,3}})\\s?%', 1), '') AS INT) AS headline_probability_pct
  FROM (SELECT *, list_position([regexp_matches(x, '(?i)ENSO Alert System Status') FOR x IN l], true) AS sp, list_position([regexp_matches(x, '(?i)^Synopsis:?$') FOR x IN l], true) AS yp
    FROM (SELECT o_orderkey AS id, {lines_sql('h')} AS l FROM (SELECT o_orderkey, {BULLETIN} AS h FROM orders)))"""
ENUM_SQL = f"""SELECT id, CASE WHEN regexp_matches(st, '(?i)El Niño') THEN 'el_nino' WHEN regexp_matches(st, '(?i)La Niña') THEN 'la_nina' ELSE 'neutral' END AS phase,
  CASE WHEN regexp_matches(st, '(?i)Advisory') THEN 'advisory' WHEN regexp_matches(st, '(?i)Watch') THEN 'watch' ELSE 'none' END AS level,
  nullif(lower(regexp_extract(coalesce(synopsis, ''), '(?i)(very strong|strong|moderate|weak)', 1)), '') AS expected_strength FROM (SELECT *, coalesce(status, '') AS st FROM ({PARSED_SQL}))"""


def bulletins(t):
    return op.parse_bulletin(t.spread("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select(F.col("o_orderkey").alias("id"), F.expr(BULLETIN).alias("html")))


@query("j2_bulletin_fields", PARSED_SQL)
def j2(t):
    return bulletins(t).select("id", "issued", "status", "synopsis", "headline_probability_pct")


@query("j3_bulletin_enums", ENUM_SQL)
def j3(t):
    return bulletins(t).select("id", "phase", "level", "expected_strength")


@query("j4_template_fill", "SELECT id, 'In ' || coalesce(a1, '') || ', ' || name || ' has ' || pop || ' people.' || '' AS text FROM (SELECT id, name, pop, CASE WHEN a2 > '4' THEN NULL ELSE a1 END AS a1 FROM v_place)")
def j4(t):
    values = {"a1": F.when(F.col("a2") <= "4", F.col("a1")), "name": F.col("name"), "n": F.col("pop")}
    return t.place.select("id", tx.fill(F.lit("In {a1}, {name} has {n} people.{missing}"), values).alias("text"))


PHRASE = "CASE WHEN {0} IS NULL THEN 'no data' WHEN abs(floor({0} + 0.5)) < 5 THEN 'near normal' WHEN {0} > 0 THEN CAST(abs(floor({0} + 0.5)) AS BIGINT) || '% more' ELSE CAST(abs(floor({0} + 0.5)) AS BIGINT) || '% less' END"


@query("j5_percent_phrase", f"SELECT id, {PHRASE.format('(pct / 10 + 0.25)')} AS phrase FROM v_rule")
def j5(t):
    return t.rule.select("id", tx.percent_phrase(F.col("pct") / 10 + 0.25, "no data", "near normal", "{n}% more", "{n}% less").alias("phrase"))


@query(
    "j6_list_text",
    "SELECT id, CASE WHEN n = 1 THEN l[1] ELSE array_to_string(l[1:n-1], ', ') || ' and ' || l[n] END AS names FROM (SELECT l_orderkey AS id, list_sort(list(DISTINCT 'S' || l_suppkey)) AS l, len(list(DISTINCT l_suppkey)) AS n FROM lineitem GROUP BY 1)",
)
def j6(t):
    names = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).alias("l"))
    return names.select("id", tx.list_text(F.col("l")).alias("names"))


def rendered(t):
    facts = rules_q.facts(t).join(t.point.select(F.col("id").alias("place_id"), "name"), "place_id")
    return briefing.render(facts, briefing.english_catalog(t.spark))


@query("j7_briefing_blocks")
def j7(t):
    return rendered(t).select("place_id", "lang", F.posexplode("blocks").alias("pos", "b")).select("place_id", "lang", "pos", "b.type", "b.key", "b.text")


STEP_TEXTS = "CASE WHEN a2 > '4' THEN [] WHEN a2 > '2' THEN ['Clear drains.'] ELSE ['Clear drains.', 'Store water.', 'Move seed.'] END"


def step_texts():
    texts = F.expr("array('Clear drains.', 'Store water.', 'Move seed.')")
    return F.when(F.col("a2") > "4", F.slice(texts, 1, 0)).when(F.col("a2") > "2", F.slice(texts, 1, 1)).otherwise(texts)


@query("j8_radio_script", f"SELECT id, array_to_string(list_filter([name || ' gets more rain.', CASE WHEN pop > 100000 THEN 'Floods.' ELSE '' END, NULL, array_to_string(({STEP_TEXTS})[1:2], ' '), 'Ask ' || cc || '.'], lambda x: x IS NOT NULL AND x <> ''), ' ') AS radio FROM v_place")
def j8(t):
    script = briefing.radio_script(
        F.concat("name", F.lit(" gets more rain.")), F.when(F.col("pop") > 100000, "Floods.").otherwise(""), F.lit(None).cast("string"), step_texts(),
        F.concat(F.lit("Ask "), "cc", F.lit(".")),
    )
    return t.place.select("id", script.alias("radio"))


@query("j9_short_message", "SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE s[1:157] || '...' END AS sms FROM (SELECT doc_id, trim(text || ' ' || source) AS s FROM documents)")
def j9(t):
    return t.documents.select("doc_id", briefing.short_message(F.col("text"), F.array("source")).alias("sms"))


SENTENCES_SQL = "list_filter(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, {1})) > {2})"


@query("j10_sentences", f"SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {SENTENCES_SQL.format('text', BLANK, 0)} AS l FROM documents)")
def j10(t):
    return t.spread("documents", "doc_id", "text").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


STRIP = "regexp_replace(regexp_replace(text, '\\{\\w+\\}', 'X', 'g'), '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]', '', 'g')"
COUNTS_SQL = f"""SELECT doc_id, any_value(ns) AS ns, count(w) AS nw, sum(CASE WHEN w IS NULL OR letters = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(letters, 'e$', ''), '[aeiouy]+'))) END) AS ny FROM (
  SELECT doc_id, ns, w, regexp_replace(lower(w), '[^a-z]', '', 'g') AS letters FROM (SELECT doc_id, len(l) AS ns, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE list_filter(flatten([string_split_regex(x, '\\s+') FOR x IN l]), lambda z: z <> '') END) AS w
    FROM (SELECT doc_id, {SENTENCES_SQL.format('text', BLANK, 2)} AS l FROM documents))) GROUP BY 1"""


@query("j11_reading_grade_per_text", f"SELECT doc_id, CAST(ns AS INT) AS sentences, CAST(nw AS INT) AS words, CAST(ny AS INT) AS syllables, round(0.39::DOUBLE * (nw::DOUBLE / greatest(1, ns)) + 11.8::DOUBLE * (ny::DOUBLE / greatest(1, nw)) - 15.59, 6) AS grade FROM ({COUNTS_SQL})")
def j11(t):
    rows = t.spread("documents", "doc_id", "text").select("doc_id", tx.reading_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    return rows.withColumn("grade", F.round(tx.reading_grade(F.col("sentences"), F.col("words"), F.col("syllables")), 6))


@query("j11_reading_grade_of_corpus", f"SELECT CAST(sum(ns) AS BIGINT) AS sentences, CAST(sum(nw) AS BIGINT) AS words, CAST(sum(ny) AS BIGINT) AS syllables, round(0.39::DOUBLE * (sum(nw)::DOUBLE / sum(ns)) + 11.8::DOUBLE * (sum(ny)::DOUBLE / sum(nw)) - 15.59, 6) AS grade FROM ({COUNTS_SQL})")
def j11_corpus(t):
    rows = t.spread("documents", "text").select(tx.reading_counts(F.col("text")).alias("c")).select("c.*")
    total = rows.agg(*[F.sum(c).alias(c) for c in ("sentences", "words", "syllables")])
    return total.withColumn("grade", F.round(tx.reading_grade(F.col("sentences"), F.col("words"), F.col("syllables")), 6))


ALLOWED = "[" + ", ".join(f"'{w}'" for w in tx.ALLOWED_CAPITALS) + "]"
BANNED = tx.BANNED.replace("(?:", "(?:")
LINT_SQL = f"""WITH c AS (SELECT doc_id AS key, text, {STRIP} AS c FROM documents)
  SELECT key, 'fail' AS severity, 'exclamation' AS rule, '!' AS match FROM c WHERE contains(text, '!')
  UNION ALL SELECT key, 'fail', 'banned word', m FROM (SELECT key, regexp_extract(c, '(?i)\\b({BANNED})\\b', 1) AS m FROM c) WHERE m <> ''
  UNION ALL SELECT key, 'fail', 'capitals', w FROM (SELECT key, unnest(regexp_extract_all(c, '\\b([A-Z]{{3,}})\\b', 1)) AS w FROM c) WHERE NOT list_contains({ALLOWED}, w)
  UNION ALL SELECT key, 'fail', 'countdown', m FROM (SELECT key, regexp_extract(c, '(?i)\\b(\\d+\\s*(?:seconds|minutes|hours|days) (?:left|remaining))\\b', 1) AS m FROM c) WHERE m <> ''
  UNION ALL SELECT key, 'warn', 'long sentence', CAST(n AS VARCHAR) FROM (SELECT key, len(list_filter(string_split_regex(unnest({SENTENCES_SQL.format('c', BLANK, 0)}), '\\s+'), lambda z: z <> '')) AS n FROM c) WHERE n > 22"""


@query("j12_editorial_lint", LINT_SQL)
def j12(t):
    return op.lint(t.spread("documents", "doc_id", "text"), key="doc_id")


@query("j13_strip_slots_and_emoji", f"SELECT id, {STRIP} AS clean FROM (SELECT p_partkey AS id, '🌧️ {{' || replace(p_name, ' ', '_') || '}} in ☀' || p_type || ' {{a b}}' AS text FROM part)")
def j13(t):
    text = F.concat(F.lit("🌧️ {"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("} in ☀"), "p_type", F.lit(" {a b}"))
    return t.part.select(F.col("p_partkey").alias("id"), tx.strip_slots_and_emoji(text).alias("clean"))


# a translation of each place template; some lose or repeat a slot
SLOT_TEXT = ("concat('{', replace(p_name, ' ', '_'), '} of {', p_type, '}')", "concat('{', p_type, '} / {', CASE WHEN p_size % 3 = 0 THEN p_type ELSE replace(p_name, ' ', '_') END, '}')")
SLOTS = "array_to_string(list_sort(regexp_extract_all({0}, '(\\{{\\w+\\}})')), ',')"


@query("j14_slot_signature", f"SELECT p_partkey AS id, {SLOTS.format(SLOT_TEXT[0])} AS source_slots, {SLOTS.format(SLOT_TEXT[0])} = {SLOTS.format(SLOT_TEXT[1])} AS same FROM part")
def j14(t):
    a, b = (tx.slot_signature(F.expr(x)) for x in SLOT_TEXT)
    return t.part.select(F.col("p_partkey").alias("id"), a.alias("source_slots"), (a == b).alias("same"))


URL_TEXT = "concat('See ', split_part(url, '?', 1), ', or (', url, ') and | ', substr(url, 1, 20), '.')"


@query("j15_url_inventory", f"SELECT u AS url, max(page_id) AS \"where\" FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all({URL_TEXT}, 'https?://[^\\s|)`]+')), '[.,]$', '') AS u FROM pages) GROUP BY 1")
def j15(t):
    return op.url_inventory(t.pages.select("page_id", F.expr(URL_TEXT).alias("text")), "page_id", "page_id")


HTML = "replace(replace(html, '<article>', concat('<img alt=\"x\" src=\"//img', page_id % 7, '.example.net/a.png\"><article>')), '<nav>', '<script src=\"https://static.example.org/t.js\" defer></script><nav>')"
RESOURCE = '<(script|link|img|iframe|video|audio)[^>]+(?:src|href)="(?:https?:)?//([^/"]+)[^"]*"'


@query(
    "j16_external_resources",
    f"SELECT page_id, tag, host FROM (SELECT page_id, unnest(regexp_extract_all(h, '{RESOURCE}', 1)) AS tag, unnest(regexp_extract_all(h, '{RESOURCE}', 2)) AS host FROM (SELECT page_id, {HTML} AS h FROM pages)) WHERE host <> 'img0.example.net'",
)
def j16(t):
    return op.external_resources(t.pages.select("page_id", F.expr(HTML).alias("html")), own_hosts=["img0.example.net"])


@query("j16_disallowed_urls", "SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT substr(url, 1, 9) AS prefix FROM pages WHERE url LIKE '%/fr/%') a WHERE starts_with(p.url, a.prefix))")
def j16_urls(t):
    prefixes = t.pages.where("url LIKE '%/fr/%'").select(F.substring("url", 1, 9).alias("prefix")).distinct()
    return op.disallowed_urls(t.pages.select("page_id", "url"), prefixes)


@query("j17_html_escape", "SELECT page_id, sha1(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_hash FROM pages")
def j17(t):
    return t.pages.select("page_id", F.sha1(tx.html_escape(F.col("html")).cast("binary")).alias("escaped_hash"))


@query("j18_headline_class", "SELECT id, CASE WHEN contains(h, 'more rain') THEN 'wet' WHEN contains(h, 'less rain') THEN 'dry' ELSE '' END AS cls FROM (SELECT id, CASE WHEN pct > 20 THEN 'much more rain' WHEN pct < -20 THEN 'less rain than usual' ELSE rain END AS h FROM v_rule)")
def j18(t):
    head = F.when(F.col("pct") > 20, "much more rain").when(F.col("pct") < -20, "less rain than usual").otherwise(F.col("rain"))
    return t.rule.select("id", tx.headline_class(head).alias("cls"))
