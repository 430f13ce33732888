"""Leafmill: a PySpark engine for preparing, deduplicating and searching document corpora."""
