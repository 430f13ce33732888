"""Pieces of DuckDB SQL that several equivalents share."""

from __future__ import annotations

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BOOKS = "(SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC) = 1)"
PAGES = "(SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY updated_at DESC) = 1)"
FAMILIES = "(SELECT * FROM book_families QUALIFY row_number() OVER (PARTITION BY family_key ORDER BY updated_at DESC) = 1)"
ARABIC = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
VOWELS = r"[\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]"


def low(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i̇'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def filled(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def normalize_search(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '[\\f\\x{{a0}}]', ' ', 'g'), '{VOWELS}', '', 'g')"
    return collapse(f"regexp_replace({low(bare)}, '[^\\p{{L}}\\p{{N}}_{SPACE}\\x{{600}}-\\x{{6ff}}]+', ' ', 'g')")


def normalize_import(x: str, language: str | None = None) -> str:
    base = f"regexp_replace({x}, '[\\f\\x{{a0}}]', ' ', 'g')"
    arabic = f"regexp_matches({base}, '[\\x{{600}}-\\x{{6ff}}]')" + (f" OR coalesce({language} = 'ar', false)" if language else "")
    bare = f"(CASE WHEN {arabic} THEN regexp_replace({base}, '{VOWELS}', '', 'g') ELSE {base} END)"
    return collapse(f"regexp_replace({low(bare)}, '[^\\p{{L}}\\p{{N}}_{SPACE}\\x{{600}}-\\x{{6ff}}]+', ' ', 'g')")


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def round4(x: str) -> str:
    return f"floor(({x}) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE"
