"""Text normalisers, tokenisers, profiles and name rules, as native column expressions.

Java's ``\\w`` and ``\\s`` are ASCII, so classes are spelt out: a word character is a letter, a
number or an underscore; white space is Unicode's, with the separators U+001C to U+001F. NFKC and
HTML entities have no built-in; one Arrow function does both, and only for rows that need it.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arabic vowel signs that are stripped; blocks of Arabic script.
VOWEL_SIGNS = "[\\u064b-\\u065f\\u0670\\u06d6-\\u06ed]"
ARABIC = "[\\u0600-\\u06ff\\u0750-\\u077f\\u08a0-\\u08ff\\ufb50-\\ufdff\\ufe70-\\ufeff]"
LATIN = "\\p{IsLatin}"
WORD = "[\\p{L}\\p{N}_]"
SPACE = "(?U)[\\s\\x1c-\\x1f]"

#: Words of titles that stay in lower case; some more when converting.
TITLE_STOPS = ("and", "the", "of", "in", "to", "for", "a", "an", "or", "by", "is", "on", "its")
CONVERT_STOPS = (*TITLE_STOPS, "wa", "fi", "bi", "li")

SOURCE_TYPES = {".txt": "txt", ".htm": "html", ".html": "html", ".docx": "docx", ".doc": "doc", ".pdf": "pdf", ".epub": "epub", ".ibooks": "ibooks"}


@F.pandas_udf(T.StringType())
def _nfkc_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column, unescape: bool = False) -> Column:
    """NFKC, with HTML entities resolved before if asked; plain ASCII rows never go to Python."""
    guard = text.rlike("[^\\x00-\\x7F]|&") if unescape else text.rlike("[^\\x00-\\x7F]")
    return F.coalesce((_nfkc_unescape if unescape else _nfkc)(F.when(guard, text)), text)


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def _plain_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "[\\f\\u00a0]", " ")


def filled(text: Column) -> Column:
    """The value, or null where it is empty or blank."""
    return F.nullif(strip(text), F.lit(""))


def normalize_import(text: Column, language: Column | None = None, compat: bool = True) -> Column:
    """For signatures and quality: vowel signs go where the language or the text is Arabic; lower case; words only."""
    base = _plain_breaks(nfkc(text, unescape=True) if compat else text)
    arabic = base.rlike("[\\u0600-\\u06ff]")
    if language is not None:
        arabic = arabic | F.coalesce(language == "ar", F.lit(False))
    bare = F.when(arabic, F.regexp_replace(base, VOWEL_SIGNS, "")).otherwise(base)
    return collapse(F.regexp_replace(F.lower(bare), "(?U)[^\\p{L}\\p{N}_\\s\\u0600-\\u06ff]+", " "))


def normalize_search(text: Column, compat: bool = True) -> Column:
    """For retrieval: no entities; vowel signs always go; lower case; words only."""
    base = F.regexp_replace(_plain_breaks(nfkc(text) if compat else text), VOWEL_SIGNS, "")
    return collapse(F.regexp_replace(F.lower(base), "(?U)[^\\p{L}\\p{N}_\\s\\u0600-\\u06ff]+", " "))


def normalize_edit(text: Column, compat: bool = True) -> Column:
    """For signatures of edited books: punctuation and vowel signs stay."""
    return collapse(F.lower(_plain_breaks(nfkc(text) if compat else text)))


def normalize_reference(text: Column, compat: bool = True) -> Column:
    """For reference search: lower case, no tatweel, a narrower set of vowel signs."""
    low = F.lower(nfkc(text) if compat else text)
    return collapse(F.regexp_replace(low, "[\\u0640\\u064b-\\u065f\\u0670]", ""))


def normalize_eval(text: Column) -> Column:
    """For the evaluation of answers: lower case and single spaces."""
    return collapse(F.lower(text))


def quality_tokens(normalized: Column) -> Column:
    """Runs of ASCII letters, digits and Arabic characters."""
    return F.regexp_extract_all(normalized, F.lit("([A-Za-z0-9\\u0600-\\u06ff]+)"), 1)


def search_tokens(normalized: Column) -> Column:
    """Search terms: as above with apostrophes, of two characters at least."""
    return F.filter(F.regexp_extract_all(normalized, F.lit("([A-Za-z0-9\\u0600-\\u06ff']+)"), 1), lambda t: F.length(t) >= 2)


def reference_tokens(normalized: Column) -> Column:
    """Words of a reference query, of two characters at least."""
    return F.filter(F.regexp_extract_all(normalized, F.lit("([\\p{L}\\p{N}_\\u0600-\\u06ff]+)"), 1), lambda t: F.length(t) >= 2)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def char_profile(text: Column) -> Column:
    """Numbers of characters by kind; arabic and latin count letters only."""
    t = F.coalesce(text, F.lit(""))
    kinds = {
        "total": F.length(t), "nonspace": F.length(t) - count(t, SPACE), "letters": count(t, "\\p{L}"),
        "arabic": count(t, "[\\p{L}&&[\\u0600-\\u06ff\\u0750-\\u077f\\u08a0-\\u08ff\\ufb50-\\ufdff\\ufe70-\\ufeff]]"),
        "latin": count(t, "[\\p{IsLatin}&&[\\p{L}]&&[^\\u00aa\\u00ba\\u02b0-\\u02b8\\u02e0-\\u02e4]]"),
        "digits": count(t, "\\p{N}"), "punct": count(t, "\\p{P}"), "symbols": count(t, "\\p{S}"), "replacement": count(t, "\\ufffd"),
    }
    other = kinds["nonspace"] - kinds["letters"] - kinds["digits"] - kinds["punct"] - kinds["symbols"]
    return F.struct(*[v.cast("int").alias(k) for k, v in kinds.items()], other.cast("int").alias("other"))


def detect_script(text: Column) -> Column:
    """arabic, latin, mixed or unknown, by counts over all characters."""
    arabic, latin = count(F.coalesce(text, F.lit("")), ARABIC), count(F.coalesce(text, F.lit("")), LATIN)
    return (
        F.when((arabic == 0) & (latin == 0), "unknown")
        .when(arabic >= F.greatest(F.lit(20), latin * 2), "arabic")
        .when(latin >= F.greatest(F.lit(20), arabic * 2), "latin")
        .otherwise("mixed")
    )


def arabic_ratio(text: Column) -> Column:
    """Share of Arabic characters among letters and Arabic characters; 0 without any."""
    arabic = count(text, "[\\u0600-\\u06ff]")
    base = count(text, "[\\p{L}\\u0600-\\u06ff]")
    return F.when(base > 0, arabic / base).otherwise(F.lit(0.0))


def split_pages(text: Column) -> Column:
    """Pages between form feeds, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, "\\f+"), strip), lambda p: p != "")


def language_from_path(path: Column, known_only: bool = False) -> Column:
    """A two-letter prefix of the file name, else the nearest folder that is a known language, else unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    prefix = F.lower(F.regexp_extract(name, "(?i)^([a-z]{2})(?:[_-]|$)", 1))
    known = ("ar", "en", "id", "ru")
    prefix = F.when(prefix.isin(*known) if known_only else prefix != "", prefix)
    folders = F.filter(F.reverse(F.split(F.lower(path), "/")), lambda x: x.isin(*known))
    return F.coalesce(prefix, F.try_element_at(folders, F.lit(1)), F.lit("unknown"))


def language_of_converted(name: Column) -> Column:
    """Language of a file to convert: only the prefixes en, id and ru, in lower case."""
    prefix = F.regexp_extract(name, "^(en|id|ru)[_-]", 1)
    return F.coalesce(F.nullif(prefix, F.lit("")), F.lit("unknown"))


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def clean_title(stem: Column, convert: bool = False) -> Column:
    """A title from a file's stem: no language prefix, words capitalised but for stop words."""
    bare = F.regexp_replace(stem, "^(en|id|ru)[_-]+" if convert else "^(?i)[a-z]{2}[_-]+", "")
    words = F.filter(F.split(collapse(F.regexp_replace(bare, "[_-]", " ")), " "), lambda w: w != "")
    shout = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)

    def style(w: Column, i: Column) -> Column:
        stop = F.lower(w).isin(*(CONVERT_STOPS if convert else TITLE_STOPS)) & (i > 0)
        return F.when(shout(w), w).when(stop, F.lower(w)).otherwise(capitalize(w))

    title = F.array_join(F.transform(words, style), " ")
    return title if convert else F.when(title == "", stem).otherwise(title)


def book_id(label: Column, path: Column) -> Column:
    """A name without separators: ``label__path`` with runs of other characters as underscores."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[/\\\\]", "__"), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.concat(label, F.lit("__"), F.btrim(flat, F.lit("_")))


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def source_type(ext: Column) -> Column:
    kind = F.lit("unknown")
    for suffix, name in SOURCE_TYPES.items():
        kind = F.when(ext == suffix, name).otherwise(kind)
    return kind


def stem_key(stem: Column) -> Column:
    """A stem for grouping: ASCII letters and digits with single spaces (other scripts give nothing)."""
    low = F.lower(F.regexp_replace(stem, "[_.-]", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", " "), " +", " "))


def highlight(text: Column, query: Column) -> Column:
    """The query's words of three characters or more in <mark>, longest first."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([\\p{L}\\p{N}_\\u0600-\\u06ff]{3,})"), 1))
    ordered = F.array_sort(terms, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, F.concat(F.lit("(?iu)("), F.array_join(ordered, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def snippet(text: Column, most: int = 360) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("..."))).otherwise(flat)


def page_window(page: Column, total: Column) -> Column:
    """Pages to link: the first and last three and four around the current one."""
    all_ = F.concat(F.sequence(F.lit(1), F.lit(3)), F.sequence(page - 4, page + 4), F.sequence(total - 2, total))
    return F.array_sort(F.array_distinct(F.filter(all_, lambda p: (p >= 1) & (p <= total))))


def round4(x: Column) -> Column:
    """Half up to four places, the same in every engine."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)
