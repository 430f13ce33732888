"""The quality gate of pages and books, as column expressions and aggregates.

Book figures are sums over pages plus two distinct counts (words, characters), so a book of any
length is aggregated on the map side and never put together as one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx


@dataclass(frozen=True)
class PageLimits:
    nonspace: int = 25
    tokens: int = 5
    diversity: float = 0.05
    diversity_from: int = 80
    replacement: float = 0.01
    no_arabic_latin: int = 10
    no_arabic_nonspace: int = 30
    few_arabic: int = 8
    few_arabic_nonspace: int = 50
    vocabulary: float = 0.2
    vocabulary_from: int = 60
    symbols: float = 0.45
    symbols_from: int = 80
    mixed: int = 20
    mixed_from: int = 150


@dataclass(frozen=True)
class BookLimits:
    nonspace: int = 40
    tokens: int = 8
    diversity: float = 0.04
    diversity_from: int = 120
    replacement: float = 0.01
    repeated: float = 0.67
    repeated_from: int = 3
    vocabulary: float = 0.18
    vocabulary_from: int = 120
    short_page: int = 40
    short_share: float = 0.6
    symbols: float = 0.45
    symbols_from: int = 120
    mixed: int = 20
    mixed_from: int = 300
    loss_size: int = 1 << 20
    loss_nonspace: int = 400


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def expected_arabic(language: Column, path: Column) -> Column:
    """Whether Arabic is expected: by the label, the file name's prefix, or a folder named ar."""
    folder = F.exists(F.split(F.lower(path), "/"), lambda x: x == "ar")
    return F.coalesce(language == "ar", F.lit(False)) | F.coalesce(tx.language_from_path(path) == "ar", F.lit(False)) | F.coalesce(folder, F.lit(False))


def _clean(content: Column, compat: bool) -> Column:
    base = F.coalesce(content, F.lit(""))
    return F.regexp_replace(tx.nfkc(base, unescape=True) if compat else base, "[\\f\\u00a0]", " ")


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def page_measures(pages: DataFrame, compat: bool = True) -> DataFrame:
    """``pages`` (content, language, path, ...) with profile, script, tokens and ratios of each page."""
    df = pages.withColumn("clean", _clean(F.col("content"), compat))
    df = df.withColumn("profile", tx.char_profile(F.col("clean"))).withColumn("script", tx.detect_script(F.col("clean")))
    df = df.withColumn("normal", tx.normalize_import(F.coalesce("content", F.lit("")), F.col("language"), compat=compat))
    df = df.withColumn("tokens", tx.quality_tokens(F.col("normal"))).withColumn("chars", F.array_distinct(F.split("clean", "")))
    chars = F.size(F.filter("chars", lambda c: c != ""))
    return df.withColumns({"token_count": F.size("tokens"), "unique_chars": chars, "arabic_expected": expected_arabic(F.col("language"), F.col("path"))})


def page_quality(pages: DataFrame, limits: PageLimits = PageLimits(), compat: bool = True) -> DataFrame:
    """Status, score, reasons and warnings of each page."""
    m, p, lim = page_measures(pages, compat), "profile", limits
    ns, tokens = F.col(f"{p}.nonspace"), F.col("token_count")
    unique = F.when(tokens > 0, F.size(F.array_distinct("tokens")) / tokens).otherwise(F.lit(0.0))
    diversity, replaced = ratio(F.col("unique_chars"), ns), ratio(F.col(f"{p}.replacement"), F.col(f"{p}.total"))
    symbols = ratio(F.col(f"{p}.punct") + F.col(f"{p}.symbols"), F.col(f"{p}.letters") + F.col(f"{p}.digits") + F.col(f"{p}.punct") + F.col(f"{p}.symbols"))
    arabic, latin = F.col(f"{p}.arabic"), F.col(f"{p}.latin")
    cid = (F.col("extractor") == "pdftotext") & F.lower("clean").contains("cid:")
    none = (arabic == 0) & (latin >= lim.no_arabic_latin) & (ns >= lim.no_arabic_nonspace)
    few = (arabic < lim.few_arabic) & (ns >= lim.few_arabic_nonspace)
    other = (F.col("script") == "latin") & (ns >= lim.no_arabic_nonspace)
    low = (ns >= lim.diversity_from) & (diversity < lim.diversity)
    expected = F.col("arabic_expected")
    reasons = flags(
        ((ns < lim.nonspace) | (tokens < lim.tokens), "too_short_or_empty"), (low, "low_character_diversity"), (replaced >= lim.replacement, "encoding_replacement_chars"), (cid, "cid_tokens_detected"),
        (expected & none, "arabic_script_mismatch"), (expected & ~none & few, "arabic_missing"), (expected & ~none & ~few & other, "arabic_script_mismatch"),
    )
    warnings = flags(
        ((tokens >= lim.vocabulary_from) & (unique < lim.vocabulary), "low_vocab_diversity"), ((symbols >= lim.symbols) & (ns >= lim.symbols_from), "high_symbol_density"),
        ((arabic >= lim.mixed) & (latin >= lim.mixed) & (ns >= lim.mixed_from), "mixed_script_content"),
    )
    df = m.withColumns({"reasons": reasons, "warnings": warnings})
    status = F.when(F.size("reasons") > 0, "ocr_needed").when(F.size("warnings") > 0, "warn").otherwise("ok")
    fine = F.lit(1.0) - F.when(ns < 25, F.least(F.lit(0.35), (25 - ns) / 100.0)).otherwise(0.0) - F.when(diversity < 0.05, F.least(F.lit(0.2), (0.05 - diversity) * 2.0)).otherwise(0.0)
    fine = fine - F.least(F.lit(0.2), replaced * 8.0) - F.when(F.array_contains("reasons", "cid_tokens_detected"), 0.18).otherwise(0.0) - F.least(F.lit(0.2), F.size("warnings") * 0.05)
    return df.select("book_id", "page_num", status.alias("status"), F.greatest(F.lit(0.0), tx.round4(fine)).alias("score"), "reasons", "warnings", (F.size("reasons") + F.size("warnings") > 0).alias("ocr_needed"), "script", "token_count", tx.round4(unique).alias("unique_word_ratio"), tx.round4(symbols).alias("symbol_ratio"), tx.round4(diversity).alias("unique_char_ratio"))


def book_quality(pages: DataFrame, books: DataFrame, limits: BookLimits = BookLimits(), compat: bool = True) -> DataFrame:
    """Status, reasons, warnings and figures of each book from its pages.

    ``pages``: book_id, page_num, content, language, path; ``books``: book_id, language, path,
    extractor, size_bytes. Books without pages count as empty.
    """
    lim, m = limits, page_measures(pages.withColumn("extractor", F.lit("")), compat)
    raw = tx.strip(F.coalesce("content", F.lit("")))
    kinds = ("total", "nonspace", "letters", "arabic", "latin", "digits", "punct", "symbols", "replacement")
    text_hash = F.when(F.col("normal") != "", F.xxhash64("normal"))
    sums = m.withColumns({"raw": raw, "print": text_hash, "all_arabic": tx.count(F.col("clean"), tx.ARABIC), "all_latin": tx.count(F.col("clean"), tx.LATIN)}).groupBy("book_id").agg(
        *[F.sum(f"profile.{k}").alias(k) for k in kinds], F.count("*").alias("page_count"), F.sum("token_count").alias("token_count"), F.sum(F.length("raw")).alias("raw_chars"),
        F.count_if(F.length("raw") < lim.short_page).alias("short_pages"), F.count("print").alias("hashes"), F.sum("all_arabic").alias("all_arabic"), F.sum("all_latin").alias("all_latin"),
        F.bool_or(F.contains("clean", F.lit("\n"))).alias("has_feed"),
    )
    # Distinct words, characters and page texts: one exploded column of hashes, aggregated before the shuffle.
    items = m.select("book_id", F.explode(F.array_distinct(F.concat(
        F.transform(F.array_distinct("tokens"), lambda t: F.concat(F.lit("w"), t)), F.transform(F.filter("chars", lambda c: c != ""), lambda c: F.concat(F.lit("c"), c)), F.array_compact(F.array(F.concat(F.lit("p"), text_hash.cast("string"))))
    ))).alias("item")).distinct()
    kind = F.left("item", F.lit(1))
    distinct = items.groupBy("book_id").agg(*[F.count_if(kind == k).alias(n) for k, n in (("w", "unique_words"), ("c", "unique_chars"), ("p", "unique_pages"))])
    b = books.join(sums, "book_id", "left").join(distinct, "book_id", "left").na.fill(0)
    c = F.col
    # Line feeds between pages are characters of the joined text too.
    chars = c("unique_chars") + F.when((c("page_count") > 1) & ~F.coalesce(c("has_feed"), F.lit(False)), 1).otherwise(0)
    b = b.withColumns({
        "unique_word_ratio": F.when(c("token_count") > 0, c("unique_words") / c("token_count")).otherwise(0.0), "short_page_ratio": ratio(c("short_pages"), c("page_count")), "duplicate_page_ratio": ratio(c("hashes") - c("unique_pages"), c("hashes")),
        "symbol_ratio": ratio(c("punct") + c("symbols"), c("letters") + c("digits") + c("punct") + c("symbols")), "replacement_ratio": ratio(c("replacement"), c("total")), "arabic_ratio": ratio(c("arabic"), c("letters")), "latin_ratio": ratio(c("latin"), c("letters")),
        "unique_char_ratio": ratio(chars, c("nonspace")), "arabic_expected": expected_arabic(c("language"), c("path")), "avg_page_chars": ratio(c("raw_chars"), c("page_count")),
        "script": F.when((c("all_arabic") == 0) & (c("all_latin") == 0), "unknown").when(c("all_arabic") >= F.greatest(F.lit(20), c("all_latin") * 2), "arabic").when(c("all_latin") >= F.greatest(F.lit(20), c("all_arabic") * 2), "latin").otherwise("mixed"),
    })
    ns, expected = c("nonspace"), c("arabic_expected")
    none = (c("arabic") == 0) & (c("latin") >= 20) & (ns >= 40)
    few = (c("arabic") < 10) & (ns >= 60)
    thin = (c("arabic_ratio") < 0.12) & (ns >= 200)
    lossy = (F.coalesce(c("extractor"), F.lit("")).startswith("pdf") | F.coalesce(c("extractor") == "libreoffice-html", F.lit(False))) & (c("size_bytes") >= lim.loss_size) & (ns < lim.loss_nonspace)
    reasons = flags(
        ((ns < lim.nonspace) | (c("token_count") < lim.tokens), "too_short_or_empty"), ((ns >= lim.diversity_from) & (c("unique_char_ratio") < lim.diversity), "low_character_diversity"), (c("replacement_ratio") >= lim.replacement, "encoding_replacement_chars"),
        ((c("duplicate_page_ratio") >= lim.repeated) & (c("hashes") >= lim.repeated_from), "repeated_pages"), (expected & none, "arabic_script_mismatch"), (expected & ~none & few, "arabic_missing"), (expected & ~none & ~few & thin, "arabic_low_density"),
        (expected & ~none & ~few & ~thin & (c("script") == "latin") & (ns >= 40), "arabic_script_mismatch"), (lossy, "conversion_loss_suspected"),
    )
    warnings = flags(
        ((c("token_count") >= lim.vocabulary_from) & (c("unique_word_ratio") < lim.vocabulary), "low_vocab_diversity"), ((c("short_page_ratio") >= lim.short_share) & (c("page_count") >= 2), "many_short_pages"), ((c("symbol_ratio") >= lim.symbols) & (ns >= lim.symbols_from), "high_symbol_density"),
        (~expected & (c("arabic") >= lim.mixed) & (c("latin") >= lim.mixed) & (ns >= lim.mixed_from), "mixed_script_content"),
    )
    b = b.withColumns({"reasons": reasons, "warnings": warnings})
    status = F.when(F.size("reasons") > 0, "quarantine").when(F.size("warnings") > 0, "warn").otherwise("ok")
    ratios = ("unique_word_ratio", "short_page_ratio", "duplicate_page_ratio", "symbol_ratio", "replacement_ratio", "arabic_ratio", "latin_ratio", "unique_char_ratio")
    return b.select("book_id", status.alias("status"), "reasons", "warnings", "script", "arabic_expected", "page_count", "token_count", *kinds, (F.floor(c("avg_page_chars") * 100.0 + 0.5) / 100.0).alias("avg_page_chars"), *[tx.round4(c(r)).alias(r) for r in ratios])


def conversion_status(quality: Column) -> Column:
    return F.when(quality == "quarantine", "failed").when(quality == "warn", "degraded").when(quality == "ok", "good").otherwise("unknown")


def routing(quality: DataFrame) -> DataFrame:
    """How each book goes on: quarantined ones wait for review, others are approved."""
    held = F.col("status") == "quarantine"
    return quality.select("book_id", "status", conversion_status(F.col("status")).alias("conversion_status"), F.when(held, "pending_review").otherwise("approved_auto").alias("review_status"), held.alias("review_required"), (~held).alias("intake_ready"))


def page_summary(quality: DataFrame) -> DataFrame:
    """Per book: pages by status, and the pages that need OCR in order."""
    pages = quality.groupBy("book_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "ocr_needed")], F.sort_array(F.collect_list(F.when(F.col("ocr_needed"), F.col("page_num")))).alias("ocr_candidates"))
    return pages.withColumn("ocr_candidates", F.array_join(F.transform("ocr_candidates", lambda x: x.cast("string")), ","))


def suspicious_text_layer(profile: Column, has_cid: Column, pages: Column, size: Column, extractor: Column) -> Column:
    """Whether a PDF's text layer looks lost: no text, too little for its size, or broken characters.

    ``has_cid``: whether the text names characters by number (``cid:``).
    """
    ns, letters, small = profile["nonspace"], profile["letters"], F.coalesce(size, F.lit(0))
    return (
        (ns == 0) | ((small >= 200_000) & (ns < 120)) | ((small >= 1_000_000) & (ns < 350)) | ((pages <= 1) & (small >= 100_000) & (ns < 200))
        | (profile["replacement"] > profile["total"] * 0.01) | ((F.coalesce(extractor, F.lit("")) == "pdftotext") & F.coalesce(has_cid, F.lit(False)))
        | ((letters > 0) & (ratio(letters, ns) < 0.18) & (small >= 100_000))
    )
