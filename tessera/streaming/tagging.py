"""An addition to the batch work: pages that arrive as JSON files are split and matched as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching
from ..sources import pages


def page_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(pages.PAGE).option("maxFilesPerTrigger", files).json(folder)


def section_stream(stream: DataFrame) -> DataFrame:
    """Sections of a page stream with their cleaned text; stateless."""
    return pages.with_text(pages.split_sections(stream)).withColumn("text", text.clean_english(text.rewrite_terms(F.col("en_text"))))


def write_matches(stream: DataFrame, terms: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each batch's dictionary matches; with the checkpoint, batches are written once."""

    def each(batch: DataFrame, number: int) -> None:
        found = matching.term_matches(batch, ["ref"], "text", terms)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
