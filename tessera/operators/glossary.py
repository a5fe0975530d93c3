"""Glossary views: filter, categories, sorting, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.reuse import in_place


def filter_entries(entries: DataFrame, needle: str | None = None, category: str | None = None) -> DataFrame:
    """Entries whose search text holds the trimmed needle in any case, and which have the category; each if given."""
    needle = (needle or "").strip().lower()
    if needle:
        entries = entries.where(F.contains("search_blob", F.lit(needle)))
    return entries.where(F.array_contains("categories_list", category)) if category else entries


def categories(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("categories_list").alias("category")).distinct().orderBy("category")


def sort_entries(entries: DataFrame, key: str = "term", descending: bool | None = None) -> DataFrame:
    """Entries with row_no in the view's order: counts by value (largest first unless told), other columns in natural order; ties by term, in the same direction."""
    down = key == "count_int" if descending is None else descending
    columns = [F.col(key) if key == "count_int" else text.natural_key(F.col(key)), text.natural_key(F.col("term")), F.col("term")]
    order = [c.desc() if down else c.asc() for c in columns]
    return numbered(entries, order).orderBy("row_no")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with row_no from 1 in a view's order; sorted by ranges, so no task holds more than a range. Equal rows are numbered in any order."""
    return in_place(rows.sort(*order), "row_no")


def counts(entries: DataFrame, needle: str | None = None, category: str | None = None) -> DataFrame:
    """n_shown, n_total of a filter."""
    return entries.agg(F.count("*").alias("n_total")).join(filter_entries(entries, needle, category).agg(F.count("*").alias("n_shown"))).select("n_shown", "n_total")
