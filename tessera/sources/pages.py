"""Pages of parallel text: fetching, ranges of pages, sections."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField("ref", T.StringType()), T.StructField("text", T.ArrayType(T.StringType())), T.StructField("he", T.ArrayType(T.StringType()))])


def http_fetch(base: str, timeout: float = 30) -> Callable[[str], str]:
    """A fetch function for fetch_pages; an answer other than 200 raises."""

    def fetch(ref: str) -> str:
        with urllib.request.urlopen(f"{base}/{ref}", timeout=timeout) as answer:
            if answer.status != 200:
                raise RuntimeError(f"{ref}: status {answer.status}")
            return answer.read().decode()

    return fetch


def page_ref(work: Column, page: Column) -> Column:
    return F.concat_ws(".", work, page)


def page_range(spark: SparkSession, work: str, start: str, end: str) -> DataFrame:
    """work, page, ref of all pages from start to end ("2a" to "5b"), both included; none if start lies after end."""
    first, last = (int(x[:-1]) for x in (start, end))
    numbers = spark.range(first, last + 1) if first <= last else spark.range(0)
    sides = numbers.select(F.col("id").alias("number"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    kept = sides.where(~((F.col("number") == first) & (F.col("side") < start[-1])) & ~((F.col("number") == last) & (F.col("side") > end[-1])))
    page = F.concat(F.col("number").cast("string"), "side")
    return kept.select(F.lit(work).alias("work"), page.alias("page"), page_ref(F.lit(work), page).alias("ref"), "number", "side")


def fetch_pages(refs: DataFrame, fetch: Callable[[str], str], parallel: int | None = None) -> DataFrame:
    """ref, payload (parsed) and error of each ref; pages that can't be fetched keep their error and stop nothing."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for ref in b["ref"]:
                try:
                    rows.append((ref, json.dumps(json.loads(fetch(ref))), None))
                except Exception as e:  # noqa: BLE001  whatever a page's server does
                    rows.append((ref, None, str(e)))
            yield pd.DataFrame(rows, columns=["requested", "json", "error"])

    spread = refs.select("ref").repartition(parallel) if parallel else refs.select("ref")
    return spread.mapInPandas(run, "requested string, json string, error string").select("requested", F.from_json("json", PAGE).alias("payload"), "error")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page payloads from JSON files, one object a line or a file; broken ones are null."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def split_sections(pages: DataFrame) -> DataFrame:
    """One row per section: both texts by place, the shorter list padded with empty texts."""
    none = F.array().cast("array<string>")
    text, other = F.coalesce("text", none), F.coalesce("he", none)
    zipped = pages.select(F.coalesce("ref", F.lit("")).alias("page_ref"), F.posexplode(F.arrays_zip(text.alias("en"), other.alias("he"))).alias("section_id", "pair"), F.greatest(F.size(text), F.size(other)).alias("total_sections"))
    return zipped.select(
        "section_id",
        F.concat_ws(":", "page_ref", (F.col("section_id") + 1).cast("string")).alias("ref"),
        "page_ref",
        F.coalesce("pair.en", F.lit("")).alias("en_text"),
        F.coalesce("pair.he", F.lit("")).alias("he_text"),
        (F.col("section_id") + 1).alias("section_number"),
        "total_sections",
    )


def with_text(sections: DataFrame) -> DataFrame:
    """Sections of which at least one text isn't blank."""
    return sections.where(F.col("en_text").rlike(r"(?U)\S") | F.col("he_text").rlike(r"(?U)\S"))
