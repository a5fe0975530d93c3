"""Tags of texts from entities, dictionaries, noun phrases and topics, as set algebra over (key, tag) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from . import matching

#: Dictionary sources by name; what each one's tags start with.
PREFIXES = {"bible_names": "person:bible", "bible_places": "place:bible", "bible_nations": "place:bible", "names": "person", "toponyms": "place", "concepts": "concept"}
PLACES = ("toponyms", "bible_places", "bible_nations")


def dictionary(lists: dict[str, DataFrame]) -> DataFrame:
    """source, term of several term lists, each once."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("source"), "term") for s, df in lists.items()]).distinct()


def entity_rows(docs: DataFrame, key: str) -> DataFrame:
    """key, entity, label, value of named entities (array of struct text, label)."""
    rows = docs.select(key, F.explode("entities").alias("e")).select(key, F.col("e.text").alias("entity"), F.col("e.label").alias("label"))
    return rows.withColumn("value", text.tag_value(F.col("entity"))).where("value != ''").distinct()


def entity_hits(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """entity and hits (source, value of dictionary terms within it), one row for each distinct entity text that has any."""
    found = matching.term_matches(entities.select("entity").distinct(), ["entity"], "entity", terms)
    return found.groupBy("entity").agg(F.collect_set(F.struct("source", text.tag_value(F.col("term")).alias("value"))).alias("hits"))


def values_of(pairs: Column, *sources: str) -> Column:
    """Values of the given sources among (source, value) pairs."""
    return F.transform(F.filter(pairs, lambda p: p["source"].isin(*sources)), lambda p: p["value"])


def prefixed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda v: F.concat(F.lit(f"{kind}:"), v))


def entity_tags(entities: DataFrame, hits: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Tags that entities give: divine names, persons that are no place, places that are no person."""
    persons = terms.where(F.col("source").isin("names", "bible_names")).select(text.tag_value(F.col("term")).alias("value")).distinct().withColumn("named", F.lit(True))
    rows = entities.join(hits, "entity", "left").join(persons, "value", "left").withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<source: string, value: string>>)")))
    none, value = F.expr(text.NO_STRINGS), F.col("value")
    known_or_own = lambda kind, *sources: F.when(F.size(values_of(F.col("hits"), *sources)) > 0, prefixed(f"{kind}:bible", values_of(F.col("hits"), *sources))).otherwise(F.array(F.concat(F.lit(f"{kind}:"), value)))
    person = F.when(value.isin(values.DIVINE_NAMES), F.array(F.concat(F.lit("concept:divine_name_"), value)))
    person = person.when(value.isin(values.NON_PERSONS) | (F.size(values_of(F.col("hits"), *PLACES)) > 0), none).otherwise(known_or_own("person", "bible_names"))
    edged = F.col("entity").rlike(f"^{text.WORD}") & F.col("entity").rlike(f"{text.WORD}$")
    place = F.when(edged & F.col("named").isNotNull(), none).otherwise(known_or_own("place", "bible_places", "bible_nations"))
    tags = F.when(F.col("label") == "PERSON", person).when(F.col("label").isin("GPE", "LOC"), place).otherwise(none)
    return rows.select(key, F.explode(tags).alias("tag"))


def unless_named(found: Column, tags: Column, kind: str) -> Column:
    """Tags kind:value, unless a tag of that kind already ends in the value."""
    taken = F.transform(F.filter(tags, lambda t: t.startswith(f"{kind}:")), lambda t: F.regexp_extract(t, "([^:]*)$", 1))
    return prefixed(kind, F.array_except(found, taken))


def topic_words_tags(phrases: Column) -> Column:
    """Tags of words within noun phrases."""
    has = lambda w: F.exists(phrases, lambda p: F.contains(F.lower(p), F.lit(w)))
    return F.array_distinct(F.array_compact(F.array(*(F.when(has(w), F.lit(f"topic:{t}")) for w, t in values.TOPIC_WORDS))))


def generate_tags(docs: DataFrame, terms: DataFrame, key: str = "key", topics: DataFrame | None = None) -> DataFrame:
    """key and tags (sorted) of each document.

    docs: key, text, entities (array of struct text, label), noun_phrases. terms: source, term (see dictionary()).
    topics: key, words (most weighty first). Documents without tags get an empty list. Documents
    without a key are one.

    What entities, the text, noun phrases and topics give is gathered once by key, so each is computed once; unions and
    differences are array functions on that one row, which holds distinct terms and tags alone.
    """
    entities = entity_rows(docs, key)
    matches = matching.term_matches(docs.select(key, "text"), [key], "text", terms).select(key, "source", text.tag_value(F.col("term")).alias("value"))
    phrases = docs.select(key, F.explode(topic_words_tags(F.coalesce("noun_phrases", F.expr(text.NO_STRINGS)))).alias("value"))
    parts = [matches, entity_tags(entities, entity_hits(entities, terms), terms, key).select(key, F.lit("entity tag").alias("source"), F.col("tag").alias("value")), phrases.select(key, F.lit("phrase tag").alias("source"), "value")]
    if topics is not None:
        parts.append(topics.where(F.size("words") > 0).select(key, F.lit("topic tag").alias("source"), F.concat(F.lit("topic:"), F.element_at("words", 1)).alias("value")))
    rows = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.collect_set(F.struct("source", "value")).alias("found"))
    of = lambda *sources: values_of(F.col("found"), *sources)
    rows = rows.withColumn("base", F.array_distinct(F.concat(of("entity tag"), prefixed("person:bible", of("bible_names")), prefixed("place:bible", of("bible_places", "bible_nations")))))
    rows = rows.withColumn("concepts", prefixed("concept", of("concepts")))
    drop = F.concat(prefixed("person", of("bible_names")), prefixed("place", of("bible_places", "bible_nations")))
    named = F.concat("base", unless_named(of("names"), F.col("base"), "person"), unless_named(of("toponyms"), F.col("base"), "place"), "concepts")
    keeping = F.array_contains("concepts", "concept:shabbat") | F.array_contains("base", "concept:shabbat")
    by_phrase = F.filter(of("phrase tag"), lambda t: ~(keeping & (t == "topic:shabbat")))
    tags = F.array_sort(F.array_distinct(F.concat(F.array_except(named, drop), by_phrase, of("topic tag"))))
    tagged = rows.select(F.col(key).alias("__key"), tags.alias("tags"))
    return docs.select(key).join(tagged, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce("tags", F.expr(text.NO_STRINGS)).alias("tags"))


def page_lookup(tags: DataFrame, page: str) -> DataFrame:
    """page, lookup, label: what an annotation calls a text; by priority of the tag's type, then by the tag."""
    kind, rest = F.substring_index("tag", ":", 1), F.regexp_extract("tag", "^[^:]*:(.*)$", 1)
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values.PAGE_PRIORITY)), kind), F.lit(0)), F.lit(len(values.PAGE_PRIORITY) + 1))
    rows = tags.select(page, F.explode("tags").alias("tag")).where(F.contains(F.col("tag"), F.lit(":")))
    rows = rows.select(page, kind.alias("label"), order.alias("order"), F.lower(F.replace(rest, F.lit("_"), F.lit(" "))).alias("lookup"), "tag")
    rows = rows.unionByName(rows.where("lookup = 'master'").withColumn("lookup", F.lit("the master")))
    return rows.groupBy(page, "lookup").agg(F.min_by("label", F.struct("order", "tag")).alias("label"))


def section_lookup(terms: DataFrame) -> DataFrame:
    """lookup, label, term: the dictionary that names a term, by the sources' priority."""
    prefix = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))[F.col("source")]
    order = F.array_position(F.array(*map(F.lit, values.SECTION_PRIORITY)), prefix)
    return terms.select(F.lower("term").alias("lookup"), prefix.alias("label"), order.alias("order"), "term").groupBy("lookup").agg(F.min_by(F.struct("label", "term"), F.struct("order", "term")).alias("x")).select("lookup", "x.*")


def union_by_page(rows: DataFrame, page: str, column: str) -> DataFrame:
    """All values of an array column over a page's sections, sorted, each once."""
    return rows.select(page, F.explode(column).alias("x")).groupBy(page).agg(F.array_sort(F.collect_set("x")).alias(column))


def joined_text(rows: DataFrame, page: str, order: str, columns: list[str]) -> DataFrame:
    """A page's texts in section order, joined by blanks."""
    one = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("t")))), lambda x: x["t"]), " ").alias(c)
    return rows.groupBy(page).agg(*(one(c) for c in columns))


def first_tags(tags: Column, most: int = 5) -> Column:
    """The first tags, and how many more there are."""
    more = F.size(tags) - most
    return F.concat(F.array_join(F.slice(tags, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" … (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
