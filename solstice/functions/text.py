"""Text functions: search normalisation, edit distance, templates, HTML lines, readability."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors receive the UDF by value and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Strings that are folded at a time: every step makes copies, and a batch may hold thousands of long texts.
_AT_A_TIME = 128


@F.pandas_udf(T.StringType())
def _norm_unicode(values: pd.Series) -> pd.Series:
    """Normalise the strings that need Unicode tables; nulls (plain ASCII rows) pass through."""
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    known = values.notna().to_numpy().nonzero()[0]
    for i in range(0, len(known), _AT_A_TIME):
        at = known[i : i + _AT_A_TIME]
        out.iloc[at] = _folded(values.iloc[at]).to_numpy()
    return out


def _folded(values: pd.Series) -> pd.Series:
    low = values.str.normalize("NFKC").str.strip().str.lower()
    latin = low.str.match("[a-z0-9]", na=False)
    folded = low.where(latin).str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.replace("[^a-z0-9 ]+", " ", regex=True)
    unmarked = low.mask(latin).str.replace("[\u0300-\u036f]", "", regex=True)
    return folded.fillna(unmarked).str.replace(r"\s+", " ", regex=True).str.strip()


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def norm_ascii(text: Column) -> Column:
    """``norm_text`` for strings known to be ASCII; stays in the JVM."""
    low = F.btrim(F.lower(text), F.lit(" \t\r\n\f\x0b\x1c\x1d\x1e\x1f"))
    first = F.substring(low, 1, 1)
    plain = first.between("a", "z") | first.between("0", "9")
    return F.trim(F.when(plain, F.regexp_replace(low, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(low, r"\s+", " ")))


def norm_text(text: Column) -> Column:
    """Search form of a name: case, accents and punctuation folded for Latin script, marks stripped otherwise.

    ASCII strings are folded natively; only the others cross to Python.
    """
    return F.when(is_ascii(text), norm_ascii(text)).otherwise(_norm_unicode(F.when(~is_ascii(text), text)))


def swap_distance(a: Column, b: Column) -> Column:
    """Least number of edits that turn ``a`` into ``b`` with one or two of them swaps of neighbours; large when that takes more than two.

    A swap at one place leaves the parts before and after it, whose plain edit distances add up. Two
    swaps and nothing else show as two pairs of neighbours that stand crosswise.
    """

    def letter(text: Column, at: Column) -> Column:
        return F.substring(text, at, F.lit(1))

    def around(i: Column, j: Column) -> Column:
        before = F.levenshtein(F.substring(a, F.lit(1), i - 1), F.substring(b, F.lit(1), j - 1))
        after = F.levenshtein(F.substring(a, i + 2, F.char_length(a)), F.substring(b, j + 2, F.char_length(b)))
        crossed = (letter(a, i) == letter(b, j + 1)) & (letter(a, i + 1) == letter(b, j)) & (letter(a, i) != letter(a, i + 1))
        return F.when((j >= 1) & (j < F.char_length(b)) & crossed, before + after + 1).otherwise(99)

    places = F.when(F.char_length(a) > 1, F.sequence(F.lit(1), F.char_length(a) - 1)).otherwise(F.array().cast("array<int>"))
    one = F.array_min(F.transform(places, lambda i: F.least(*[around(i, i + d) for d in (-1, 0, 1)])))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1))), lambda i: letter(a, i) != letter(b, i))

    def crosswise(n: int) -> Column:
        x, y = F.get(differ, F.lit(n)), F.get(differ, F.lit(n + 1))
        return (y == x + 1) & (letter(a, x) == letter(b, y)) & (letter(a, y) == letter(b, x))

    two = (F.char_length(a) == F.char_length(b)) & (F.size(differ) == 4) & crosswise(0) & crosswise(2)
    return F.least(F.coalesce(one, F.lit(99)), F.when(two, 2).otherwise(99))


def edit_distance(a: Column, b: Column, limit: int = 2) -> Column:
    """Edit distance up to ``limit`` (at most 2), swaps of neighbours counting once; ``limit + 1`` when larger."""
    return F.least(F.levenshtein(a, b), swap_distance(a, b), F.lit(limit + 1))


def deletions(text: Column, depth: int) -> Column:
    """All strings made by deleting up to ``depth`` (0..2) characters, without repeats."""

    def one_less(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.char_length(s))))
        return F.when(F.char_length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    out = F.array(text)
    if depth >= 1:
        out = F.concat(out, one_less(text))
    if depth >= 2:
        out = F.concat(out, F.flatten(F.transform(one_less(text), one_less)))
    return F.array_distinct(out)


# --- markup ------------------------------------------------------------------------------------
# The entities decoded in bulletins, in order, and the characters trimmed from lines.
ENTITIES = [("&ntilde;", "ñ"), ("&Ntilde;", "Ñ"), ("&#37;", "%"), ("&deg;", "°"), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')]
BLANKS = " \t\r\n\f\x0b\u00a0\ufeff"


def html_lines(html: Column) -> Column:
    """Text lines of a page: comments dropped, tags are line breaks, entities decoded, empty lines dropped."""
    text = F.regexp_replace(F.regexp_replace(html, r"<!--[\s\S]*?-->", ""), "<[^>]+>", "\n")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(lines, lambda x: x != "")


def first_line(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))


def line_after(lines: Column, pattern: str) -> Column:
    """Line behind the first one that matches; null without a match."""
    place = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")
    return F.when(place > 0, F.get(lines, place))


def html_escape(text: Column) -> Column:
    # the ampersand first, or it would escape the other replacements
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.coalesce(text, F.lit(""))


# --- templates ---------------------------------------------------------------------------------
SLOT = r"\{(\w+)\}"


def fill(template: Column, values: dict[str, Column | str]) -> Column:
    """Fill the ``{name}`` slots; unknown and null values become empty. Inserted text is not filled again."""
    pairs = [x for name, v in values.items() for x in (F.lit(name), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return fill_map(template, F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit("")))


def fill_map(template: Column, values: Column) -> Column:
    pieces = F.split(template, r"\{\w+\}")
    names = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))
    inserted = F.transform(names, lambda n: F.coalesce(F.element_at(values, n), F.lit("")))
    return F.array_join(F.zip_with(pieces, inserted, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def slot_signature(text: Column) -> Column:
    """Sorted slots of a template, repeats kept."""
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(r"(\{\w+\})"), F.lit(1))), ",")


def list_text(items: Column, separator: Column | str = ", ", last: Column | str = " and ") -> Column:
    separator = F.lit(separator) if isinstance(separator, str) else separator
    last = F.lit(last) if isinstance(last, str) else last
    n = F.size(items)
    joined = F.aggregate(F.slice(items, F.lit(2), F.greatest(n - 2, F.lit(0))), F.get(items, F.lit(0)), lambda acc, x: F.concat(acc, separator, x))
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(joined, last, F.get(items, n - 1)))


def percent_phrase(pct: Column, no_data: Column | str, near_normal: Column | str, more: Column | str, less: Column | str) -> Column:
    """A percentage in words: no data, near normal (below 5), more or less."""
    no_data, near_normal, more, less = (F.lit(x) if isinstance(x, str) else x for x in (no_data, near_normal, more, less))
    size = F.abs(F.floor(pct + 0.5)).cast("bigint")
    return F.when(pct.isNull(), no_data).when(size < 5, near_normal).otherwise(fill(F.when(pct > 0, more).otherwise(less), {"n": size}))


# --- prose -------------------------------------------------------------------------------------
# Words that hurry the reader, and capital words that are names of sources.
BANNED = (
    r"urgent(?:ly)?|immediately|act now|right away|deadly|catastroph\w*|devastat\w*|doom\w*|horrif\w*|terrif\w*|panic|alarming|apocalyp\w*"
    r"|unprecedented|nightmare|brace yourself|time is running out|last chance"
)
ALLOWED_CAPITALS = (
    "ENSO NOAA CPC WMO IRI USDM GPCP CHIRPS SMS GPS ECMWF SEAS5 CC BY UCSB CHC NCEI US UK ID OK PDF FAO GIEWS IBTrACS INFORM GDACS CAP CAMS FIRMS"
    " GloFAS DJF JFM FMA MAM AMJ MJJ JJA JAS ASO SON OND NDJ RTL JSON API ONI USA UN ICPAC SADC ASEAN ADM1 ADM2 C3S PNG GHACOF SARCOF EN LN"
).split()
MAX_SENTENCE_WORDS = 22
# word edges for ASCII letters only, also next to accented letters
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def strip_slots_and_emoji(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\{\w+\}", "X"), r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")


def sentences(text: Column, marks: str = ".!?") -> Column:
    parts = F.split(text, rf"(?<=[{marks}])[\s]+")
    return F.filter(parts, lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) > 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def syllables(text: Column) -> Column:
    """Vowel groups of all words, a final e not counted; at least one per word that has letters.

    Counted over the whole text at once instead of word by word.
    """
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]+", "")
    spoken = F.regexp_replace(letters, r"e(?=\s|$)", "")
    groups = F.regexp_count(spoken, F.lit("[aeiouy]+"))
    silent = F.regexp_count(letters, F.lit(r"\S+")) - F.regexp_count(spoken, F.lit(r"[^\saeiouy]*[aeiouy]\S*"))
    return groups + silent


def reading_counts(text: Column) -> Column:
    """Struct ``sentences, words, syllables`` over the sentences longer than two characters."""
    kept = F.filter(sentences(text), lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) > 2)
    joined = F.array_join(kept, "\n")
    return F.struct(F.size(kept).alias("sentences"), word_count(joined).alias("words"), syllables(joined).alias("syllables"))


def reading_grade(n_sentences: Column, n_words: Column, n_syllables: Column) -> Column:
    return 0.39 * (n_words / F.greatest(F.lit(1), n_sentences)) + 11.8 * (n_syllables / F.greatest(F.lit(1), n_words)) - 15.59


def headline_class(text: Column, wetter: str = "more rain", drier: str = "less rain") -> Column:
    return F.when(text.rlike(wetter), "wet").when(text.rlike(drier), "dry").otherwise("")
