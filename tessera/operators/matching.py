"""Dictionary matching: n-gram equi-joins for whole words, one alternation for substrings.

A pattern join of texts and terms compares every pair. Here texts become word n-grams of just the lengths that the
dictionary has, so that terms are met by an equi-join. The dictionary is a DataFrame and the join is left to Spark: it
broadcasts one that its statistics show to be small and shuffles a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values

TOKEN = r"[\p{L}\p{N}_]+"


def spread(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a small input, which would be scanned and split into runs in one task or a few, dealt over all cores by their keys.

    Small is what Spark's own statistics put under one scan split a core; a larger or unknown input stays as it is
    scanned and isn't shuffled.
    """
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return texts.repartition(cores, *keys) if size < cores * split else texts


def tokens(x: Column, pattern: str = TOKEN) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.lower)


def ngrams(words: Column, sizes: list[int]) -> Column:
    """All runs of the given lengths, joined by blanks, with repeats. Single elements are fetched: slice() would copy the whole array for each run."""
    grams = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.concat_ws(" ", *(F.get(words, k + (i - 1)) for i in range(n))))).otherwise(F.expr(text.NO_STRINGS))
    return F.concat(*(grams(n) for n in sizes)) if sizes else F.expr(text.NO_STRINGS)


def dictionary_sizes(dictionary: DataFrame, column: str = "key") -> list[int]:
    """The token counts that occur; a handful of numbers."""
    return sorted(r.n for r in dictionary.select(F.size(F.split(column, " ")).alias("n")).distinct().collect() if r.n > 0)


def name_ngrams(texts: DataFrame, keys: list[str], column: str, most: int, sizes: list[int] | None = None) -> DataFrame:
    """Distinct name n-grams (column gram) of each text: tokens are letters, apostrophes and hyphens."""
    words = tokens(F.col(column), values.NAME_TOKEN)
    grams = ngrams(F.col("__w"), sizes or list(range(1, most + 1)))
    return spread(texts.select(*dict.fromkeys([*keys, column])), keys).withColumn("__w", words).select(*keys, F.explode(F.array_distinct(grams)).alias("gram"))


def spelled(x: Column) -> Column:
    """Words and what stands between them, in lower case, in turn."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN + r"|[^\p{L}\p{N}_]+"), F.lit(0))


def spelled_ngrams(pieces: Column, sizes: list[int]) -> Column:
    """Distinct runs of n words, for each n, with what stands between; pieces: a column that holds spelled(), not the call, which each run would repeat."""

    def runs(n: int) -> Column:
        first = F.when(F.element_at(pieces, 1).rlike(f"^{TOKEN}"), F.lit(1)).otherwise(F.lit(2))
        last = F.size(pieces) - (2 * n - 2)
        return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(2)), lambda k: F.concat(*(F.get(pieces, k + (i - 1)) for i in range(2 * n - 1))))).otherwise(F.expr(text.NO_STRINGS))

    return F.when(F.size(pieces) > 0, F.array_distinct(F.concat(*map(runs, sizes)))).otherwise(F.expr(text.NO_STRINGS))


def term_matches(texts: DataFrame, keys: list[str], column: str, dictionary: DataFrame) -> DataFrame:
    """keys and the dictionary's columns for each term that a text holds as whole words, in any case.

    dictionary: term and other columns; a term begins and ends with a word character. Runs of as many words as terms
    have are spelled out with all that stands between, so equality is a match and the text itself is never carried.
    """
    keyed = dictionary.withColumn("__key", F.lower("term"))
    counted = keyed.select(F.size(F.regexp_extract_all("__key", F.lit(TOKEN), F.lit(0))).alias("n")).distinct()
    sizes = sorted(r.n for r in counted.collect() if r.n > 0)
    if not sizes:
        return texts.select(*keys).join(dictionary.where("false"))
    grams = spread(texts.select(*dict.fromkeys([*keys, column])), keys).select(*keys, spelled(F.col(column)).alias("__pieces")).select(*keys, F.explode(spelled_ngrams(F.col("__pieces"), sizes)).alias("__key"))
    return grams.join(keyed, "__key").select(*keys, *dictionary.columns)


def phrase_matches(texts: DataFrame, key: str, column: str, phrases: DataFrame, name: str, phrase: str, size: int = 6, most_bytes: int = 1 << 20) -> DataFrame:
    """key and name of each text that holds a phrase as it stands.

    A phrase's first and last tokens may be parts of longer ones in the text, those within are whole. So phrases with
    ``size`` inner tokens are met by an equi-join of runs of so many, shorter ones with inner tokens by those, and each
    meeting is checked on the text. Phrases without inner tokens are searched for in every text, a bounded number of
    bytes of them at a time. The empty phrase stands in every text; null ones in none.
    """
    words = F.transform(F.regexp_extract_all(phrase, F.lit(TOKEN), F.lit(0)), lambda x: x)
    known = phrases.where(F.col(phrase).isNotNull()).select(name, phrase, words.alias("__words")).withColumn("__n", F.least(F.lit(size), F.greatest(F.size("__words") - 2, F.lit(0))))
    sizes = sorted(r[0] for r in known.where("__n > 0").select("__n").distinct().collect())  # size numbers at most
    found = texts.select(key).join(phrases.select(name).where("false"))
    if sizes:
        keyed = known.where("__n > 0").select(name, F.array_join(F.slice("__words", F.lit(2), F.col("__n")), " ").alias("gram"))
        cased = spread(texts.select(key, column), [key]).withColumn("__w", F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0)))
        grams = cased.select(key, F.explode(F.array_distinct(ngrams(F.col("__w"), sizes))).alias("gram"))
        met = grams.join(keyed, "gram").select(key, name).distinct()
        found = found.unionByName(met.join(texts.select(key, column), key).join(known.select(name, phrase), name).where(F.contains(column, F.col(phrase))).select(key, name))
    short = known.where("__n = 0").select(name, phrase)
    total = short.agg(F.sum(F.octet_length(phrase) + 16)).first()[0] or 0
    blocks = -(-total // most_bytes)
    for k in range(blocks):
        held = short.where(F.pmod(F.xxhash64(phrase), F.lit(blocks)) == k).agg(F.collect_list(F.struct(name, phrase)).alias("__held"))
        inside = F.filter("__held", lambda p: F.contains(F.col(column), p[phrase]))
        found = found.unionByName(texts.select(key, column).join(F.broadcast(held)).select(key, F.explode(inside).alias("p")).select(key, F.col(f"p.{name}").alias(name)))  # one row, of a block's bytes
    return found.distinct()


def alternation(terms: list[str]) -> str:
    """One pattern for a short term list; longer terms first, the list's order among equals."""
    return "|".join(text.quoted(t) for t in sorted(terms, key=len, reverse=True))


def substring_matches(texts: DataFrame, keys: list[str], column: str, terms: list[str]) -> DataFrame:
    """keys, place (from 0) and keyword of each leftmost, longest-first, non-overlapping match, anywhere in a word."""
    found = F.regexp_extract_all(column, F.lit(f"(?iu)({alternation(terms)})"), F.lit(0))
    return spread(texts.select(*dict.fromkeys([*keys, column])), keys).select(*keys, F.posexplode(found).alias("place", "hit")).withColumn("keyword", F.lower("hit")).drop("hit")
