"""Term lists and CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions import text
from ..functions.reuse import in_place

ENCODINGS = ("utf-8", "latin-1", "cp1252", "iso-8859-1")
JAVA_NAMES = {"latin-1": "ISO-8859-1", "cp1252": "windows-1252", "utf-8": "UTF-8", "iso-8859-1": "ISO-8859-1"}
GLOSSARY_COLUMNS = (
    "term categories variant_names corpus_count wikipedia_en wikipedia_he selected_anchor_text hebrew_term search_url wiki_match_source "
    "wikidata_id father student_of affiliation student date_of_birth place_of_birth date_of_death place_of_death"
).split()


def read_terms(spark: SparkSession, path: str, source: str, prefix: str = "") -> DataFrame:
    """source, prefix, term: lines of a term list, stripped, none blank, each once. A missing file is an empty list."""
    try:
        lines = spark.read.text(path)
        lines.schema  # noqa: B018  a missing file shows here
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    stripped = lines.select(text.strip_space(F.col("value")).alias("term")).where("term != ''").distinct()
    return stripped.select(F.lit(source).alias("source"), F.lit(prefix).alias("prefix"), "term")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list with their rank in an order without regard to case."""
    return read_terms(spark, path, "names").select("term").orderBy(F.lower("term"), "term")


def read_term_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a short list in their order, repeats included: a search pattern's alternatives."""
    return [t for r in spark.read.text(path, wholetext=True).collect() for line in r.value.splitlines() if (t := line.strip())]


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that reads the file's start."""
    start = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("c")).first().c
    for name in ENCODINGS:
        try:
            bytes(start).decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.start >= len(start) - 3:
                return name  # a character cut off at the end
    return ENCODINGS[-1]


#: What the bytes 0x80 to 0x9F stand for in cp1252; five of them for nothing.
CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def read_rich_rows(spark: SparkSession, path: str, encoding: str = "cp1252", first: int | None = None, columns: tuple[str, str] | None = None) -> DataFrame:
    """row_idx, location, html of a CSV with header and quoted line breaks, in file order.

    The two columns are named, or else the first two; rows without the second go. ``first`` keeps that many rows by
    their place. Java's name for cp1252 is refused by default: its bytes are read as Latin-1, and the 32 that differ are
    replaced.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("encoding", "ISO-8859-1" if encoding == "cp1252" else JAVA_NAMES.get(encoding, encoding))
    raw = reader.csv(path)
    names = list(columns or raw.columns[:2])
    plain = lambda x: F.translate(x, "".join(map(chr, range(0x80, 0xA0))), CP1252) if encoding == "cp1252" else x
    rows = raw.select(*(plain(F.col(f"`{c}`")).alias(t) for c, t in zip(names, ("location", "html"), strict=True))).where("html is not null")
    numbers = in_place(rows, "row_idx").select("row_idx", "location", "html")
    return numbers.where(F.col("row_idx") <= first) if first else numbers


def read_rich_file(spark: SparkSession, path: str, columns: tuple[str, str] | None = None, first: int | None = None) -> DataFrame:
    """The same, by the first encoding that reads the file's start."""
    return read_rich_rows(spark, path, probe_encoding(spark, path), first, columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, doubled quotes and quoted line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary entries: no blank rows, missing cells empty (the count "0"), lists, count and search text added."""
    raw = read_csv(spark, path)
    names = {next((c for c in GLOSSARY_COLUMNS if x == c or x.endswith(f"_{c}")), x): x for x in reversed(raw.columns)}  # a corpus's or site's name may stand before
    cells = [F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in GLOSSARY_COLUMNS]
    return glossary_entries(raw.select(*cells))


def glossary_entries(rows: DataFrame) -> DataFrame:
    full = rows.where(F.length(text.strip_space(F.concat_ws("", *rows.columns))) > 0)
    count = F.when(F.col("corpus_count") == "", "0").otherwise(F.col("corpus_count"))
    blob = F.lower(F.concat_ws(" ", *(c for c in rows.columns if c != "selected_anchor_text")))
    return full.withColumn("corpus_count", count).withColumns(
        {"categories_list": text.parts_of(F.col("categories")), "variants_list": text.parts_of(F.col("variant_names")), "count_int": F.coalesce(F.regexp_extract("corpus_count", r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)), "search_blob": blob}
    )


def heading_names_of(pages: DataFrame, column: str = "html") -> DataFrame:
    """Entry names of concordance pages: place, name."""
    found = F.regexp_extract_all(column, F.lit(r'(?s)<h3>(.*?)<span class="match-count">'), F.lit(1))
    return pages.select("*", F.posexplode(found).alias("place", "raw")).withColumn("name", text.html_unescape("raw")).drop("raw", column)

