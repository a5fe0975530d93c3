"""Page keyword index, concordance, running headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import matching

LINK_BASE = "https://texts.example"


def count_keywords(matches: DataFrame, page: str, order: list[str]) -> DataFrame:
    """n and first place of each keyword on a page; both are summed before the shuffle."""
    return matches.groupBy(page, "keyword").agg(F.count("*").alias("n"), F.min(F.struct(*order, "place")).alias("first"))


def keyword_lines(counts: DataFrame, page: str, link_base: str = LINK_BASE) -> DataFrame:
    """location, keywords (most frequent first, ties by first place), link, number of keywords and of occurrences."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "keyword"))), lambda x: x["keyword"])
    done = counts.groupBy(page).agg(F.array_join(ranked, ", ").alias("keywords"), F.count("*").alias("n_keywords"), F.sum("n").alias("n_total"))
    return done.select(F.col(page).alias("location"), "keywords", text.page_link(F.col(page), link_base).alias("link"), "n_keywords", "n_total")


def keyword_index(rows: DataFrame, terms: list[str], page: str, order: list[str], column: str, link_base: str = LINK_BASE) -> DataFrame:
    """The keyword line of each page that has any; substrings count."""
    return keyword_lines(count_keywords(matching.substring_matches(rows, [page, *order], column, terms), page, order), page, link_base)


def page_index(rows: DataFrame, terms: list[str], first: int | None = 1000, link_base: str = LINK_BASE) -> DataFrame:
    """The index of rich-HTML rows (row_idx, location, html) by page; tags go before entities are decoded. first: rows read, as a feature."""
    rows = rows.where(F.col("row_idx") <= first) if first else rows
    plain = rows.select("row_idx", text.page_of(F.col("location")).alias("page"), text.html_unescape(text.strip_tags(F.col("html"))).alias("text"))
    return keyword_index(plain, terms, "page", ["row_idx"], "text", link_base).orderBy(text.page_sort_key(F.col("location")))


def concordance_hits(rows: DataFrame, names: DataFrame, row: str, column: str) -> DataFrame:
    """row and name of each row whose text holds the name as an n-gram of name tokens; spellings that differ in case go by the first."""
    keys = names.select(F.col("term").alias("name"), F.lower("term").alias("gram")).groupBy("gram").agg(F.min("name").alias("name"))
    sizes = matching.dictionary_sizes(keys, "gram")
    return matching.name_ngrams(rows, [row], column, max(sizes, default=1), sizes).join(keys, "gram").select(row, "name")


def concordance_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("name").agg(F.count("*").alias("total"))


def first_hits(hits: DataFrame, row: str, most: int = 5) -> DataFrame:
    """The first rows of each name in corpus order, with their rank; Spark keeps ``most`` a group before it shuffles."""
    rank = F.row_number().over(W.partitionBy("name").orderBy(row))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most)


def concordance(rows: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """name, total, rank, location, html of the first rows of each name; bold text is searched, diacritics repaired first."""
    rows = rows.withColumn("html", text.repair_diacritics(F.col("html"))).withColumn("bold", text.bold_text(F.col("html"))).where("bold != ''")
    hits = concordance_hits(rows, names, "row_idx", "bold")
    kept = first_hits(hits, "row_idx", most).join(concordance_totals(hits), "name")
    return kept.join(rows.select("row_idx", "location", "html"), "row_idx").select("name", "total", "rank", "location", "html")


def concordance_summary(totals: DataFrame, names: DataFrame) -> DataFrame:
    """Names searched, names found, entries in all."""
    found = totals.agg(F.count("*").alias("n_found"), F.coalesce(F.sum("total"), F.lit(0)).alias("n_entries"))
    return names.agg(F.count("*").alias("n_names")).join(found)


def letter_groups(names: DataFrame, column: str = "term") -> DataFrame:
    """Names and their number under each first letter."""
    return names.groupBy(text.letter_bucket(F.col(column)).alias("letter")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(column)).alias("names"))


def earliest_name(pages: DataFrame, names: list[str], keys: list[str], column: str = "text") -> DataFrame:
    """The name that stands first on each page (case counts, parts of words too); at one place the longest, then the list's first."""
    ranked = sorted(names, key=len, reverse=True)
    options = F.array(*(F.struct(F.instr(column, n).alias("at"), F.lit(k).alias("rank"), F.lit(n).alias("name")) for k, n in enumerate(ranked)))
    first = F.array_min(F.filter(options, lambda o: o["at"] > 0))
    return pages.select(*keys, first["name"].alias("found"))


def running_headers(pages: DataFrame, names: list[str], book: str | None = None) -> DataFrame:
    """page_no and entry: the page's earliest name, or the last one before it. Books are filled side by side."""
    found = earliest_name(pages, names, [*([book] if book else []), "page_no"])
    order = (W.partitionBy(book) if book else W.partitionBy()).orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("entry", F.last("found", ignorenulls=True).over(order)).drop("found")
