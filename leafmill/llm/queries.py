"""The queries of the training-data operators, by name: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import duplicates, languages, leakage, reading, representatives, scans, splitting, tokenizing
from leafmill.llm.oracle import ORACLES
from leafmill.tables import load

__all__ = ["ORACLES", "QUERIES"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that had to be cut, and whether a cut fell inside a word."""
    return splitting.oversized_pages(load(spark, d, "pages")).select("book_id", "page_num", "cut")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all pages, with text."""
    return splitting.page_pieces(load(spark, d, "pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every noisy line: headers, page numbers, cut words, misread characters."""
    return scans.noisy_lines(load(spark, d, "pages"), load(spark, d, "books"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page as continuous paragraphs, with its length."""
    return scans.repaired_pages(load(spark, d, "pages"), load(spark, d, "books"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of books that share at least half of their runs of four words."""
    return duplicates.similar_books(load(spark, d, "pages"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every book with its class of equal texts, its group of similar books, and its links."""
    return duplicates.groups(load(spark, d, "pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving member of each family, and the members that fill its blank columns."""
    return representatives.survivors(load(spark, d, "book_families"), load(spark, d, "books"))


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    """The record of each family built from whole bundles of its members."""
    return representatives.golden_records(load(spark, d, "book_families"), load(spark, d, "books"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a long stretch in a language that isn't the book's label."""
    return languages.mislabelled(load(spark, d, "pages"), load(spark, d, "books"))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every page with its language and confidence."""
    return languages.passages(load(spark, d, "pages"), load(spark, d, "books"))


def p5_books(spark: SparkSession, d: str) -> DataFrame:
    """Every book's language and confidence."""
    return languages.book_languages(load(spark, d, "pages"), load(spark, d, "books"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizing.encode_corpus(load(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded from its token ids again, and whether that is its text."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    back = tokenizing.decode_corpus(tokenizing.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").selectExpr("doc_id", "decoded", "decoded = coalesce(text, '') AS same")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document and test item that share a run of twelve words."""
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of each leak and where it begins in the document."""
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that no test item leaks into."""
    return leakage.cleaned(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of each document of some length."""
    return reading.reading_levels(load(spark, d, "documents"), load(spark, d, "reading_labels")).select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of each source by reading level."""
    return reading.profile(load(spark, d, "documents"), load(spark, d, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_golden": p4_golden, "p5_found": p5_found, "p5_passages": p5_passages, "p5_books": p5_books, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_matches": p7_matches, "p7_cleaned": p7_cleaned, "p8_found": p8_found, "p8_profile": p8_profile}
