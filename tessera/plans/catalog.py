"""All registered queries over the driver's tables, and their SQL.

Documents stand for corpus rows (source: page group; lines: sections), conversations for parallel texts, pages for
rich HTML, part and customer names for term lists, events for ordered entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.reuse import once
from ..operators import annotating, glossary, indexing, matching, tagging, topics
from ..sources import pages as page_sources
from ..sources import tables

KEYWORDS = ["thatin", "ononst", "inoran", "hehely", "thble", "thing", "nicht", "attion"]
#: source, term; overlaps and phrases by design.
TERMS = [("names", "the thing"), ("names", "of the"), ("bible_names", "the and"), ("toponyms", "thble"), ("bible_places", "the of"), ("concepts", "eau"), ("concepts", "nicht"), ("concepts", "und"), ("toponyms", "of the"), ("concepts", "is the")]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {VALUES} as t(source, term)")  # a literal, whose size Spark knows


VALUES = ", ".join(f"('{s}', '{t}')" for s, t in TERMS)
LETTER = r"[\p{L}\p{N}_]"
#: Documents and terms that meet as whole words.
MET = rf"""met as (select doc_id, d.source as page, t.source as source, t.term from documents d, (values {VALUES}) t(source, term)
  where d.text is not null and regexp_matches(d.text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || t.term || '([^\p{{L}}\p{{N}}_]|$)'))"""


@query(rf"""
with hits as (select source, doc_id, unnest(regexp_extract_all(text, '(?i)({matching.alternation(KEYWORDS)})')) as hit, unnest(range(len(regexp_extract_all(text, '(?i)({matching.alternation(KEYWORDS)})')))) as place from documents),
counts as (select source, lower(hit) as keyword, count(*) as n, min(row(doc_id, place)) as first from hits group by all)
select source as location, string_agg(keyword, ', ' order by n desc, first) as keywords, 'https://texts.example/' || replace(source, ' ', '.') as link,
  count(*) as n_keywords, cast(sum(n) as bigint) as n_total from counts group by source""")
def keyword_index(spark, sf_dir):
    return indexing.keyword_index(table(spark, sf_dir, "documents"), KEYWORDS, "source", ["doc_id"], "text")


@query(rf"""
with w as (select source, regexp_extract_all(lower(text), '{LETTER}+') as ws from documents), g as (select source, unnest(ws) as keyword from w)
select source as location, keyword, count(*) as n from g where keyword in ({", ".join(f"'{k}'" for k in KEYWORDS)}) group by all""")
def keyword_index_words(spark, sf_dir):
    """Whole words; counts are combined before the shuffle."""
    found = F.filter(matching.tokens(F.col("text")), lambda w: w.isin(KEYWORDS))  # within the row: only keywords become rows
    words = matching.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"]).select("source", F.explode(found).alias("keyword"))
    return words.groupBy(F.col("source").alias("location"), "keyword").agg(F.count("*").alias("n"))


NAME_SQL = rf"""w as (select doc_id, regexp_extract_all(lower(text), '[A-Za-z\x{{0100}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}''-]+') as ws from documents),
g as (select distinct doc_id, array_to_string(ws[p : p + n - 1], ' ') as gram from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from w, (values (1), (2)) s(n) where len(ws) >= n)),
names as (select distinct term as name from (values {VALUES}) t(source, term)),
hits as (select doc_id, name from g join names on gram = lower(name))"""


def hits_of(spark, sf_dir):
    return indexing.concordance_hits(table(spark, sf_dir, "documents"), terms(spark).select("term").distinct(), "doc_id", "text")


@query(f"with {NAME_SQL} select name, count(*) as total from hits group by name")
def concordance_counts(spark, sf_dir):
    return indexing.concordance_totals(hits_of(spark, sf_dir))


@query(f"with {NAME_SQL} select name, doc_id, nth as rank from (select name, doc_id, row_number() over (partition by name order by doc_id) as nth from hits) where nth <= 5")
def concordance_top5(spark, sf_dir):
    return indexing.first_hits(hits_of(spark, sf_dir), "doc_id").select("name", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {NAME_SQL} select (select count(*) from names) as n_names, count(distinct name) as n_found, count(*) as n_entries from hits")
def concordance_summary(spark, sf_dir):
    return indexing.concordance_summary(indexing.concordance_totals(hits_of(spark, sf_dir)), terms(spark).select("term").distinct())


@query(f"with {NAME_SQL} select gram, count(*) as n_docs from g where gram like '% %' group by gram")
def ngram_counts(spark, sf_dir):
    """Documents of every bigram."""
    grams = matching.name_ngrams(table(spark, sf_dir, "documents"), ["doc_id"], "text", 2, [2])
    return grams.groupBy("gram").agg(F.count("*").alias("n_docs"))


@query(f"with {MET} select doc_id, source, term from met")
def tag_dictionary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.term_matches(docs, ["doc_id"], "text", terms(spark))


@query(f"""with {MET}, p as (select doc_id, case source when 'bible_names' then 'person:bible' when 'bible_places' then 'place:bible' when 'bible_nations' then 'place:bible' when 'names' then 'person' when 'toponyms' then 'place' else 'concept' end as prefix, term from met)
select doc_id, string_agg(distinct prefix || ':' || term, ',' order by prefix || ':' || term) as tags from p group by doc_id""")
def tag_documents(spark, sf_dir):
    """The tag algebra on whole documents; without entities every tag comes from a dictionary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("cast(array() as array<struct<text: string, label: string>>)").alias("entities"), F.expr(text.NO_STRINGS).alias("noun_phrases"))
    done = tagging.generate_tags(docs, terms(spark), "doc_id")
    return done.where(F.size("tags") > 0).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(f"with {MET} select page, string_agg(distinct term, ',' order by term) as terms from met group by page")
def tag_union_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("page"), "text")
    met = matching.term_matches(docs, ["doc_id", "page"], "text", terms(spark)).groupBy("page", "doc_id").agg(F.collect_set("term").alias("terms"))
    return tagging.union_by_page(met, "page", "terms").select("page", F.array_join("terms", ",").alias("terms"))


@query(f"with {MET} select distinct doc_id, term from met where source in ('names', 'bible_names') and term not in (select term from met m where m.doc_id = met.doc_id and m.source in ('toponyms', 'bible_places'))")
def tag_person_not_place(spark, sf_dir):
    met = tag_dictionary(spark, sf_dir)
    places = met.where(F.col("source").isin("toponyms", "bible_places")).select("doc_id", "term")
    return met.where(F.col("source").isin("names", "bible_names")).select("doc_id", "term").distinct().join(places, ["doc_id", "term"], "left_anti")


@query(f"""with t as (select lower(term) as lookup, source, term, case source when 'bible_names' then 1 when 'bible_places' then 2 when 'names' then 3 when 'toponyms' then 4 else 5 end as rank from (values {VALUES}) v(source, term))
select lookup, case rank when 1 then 'person:bible' when 2 then 'place:bible' when 3 then 'person' when 4 then 'place' else 'concept' end as label, term from (select *, row_number() over (partition by lookup order by rank, term) as nth from t) where nth = 1""")
def tag_priority(spark, sf_dir):
    return tagging.section_lookup(terms(spark))


@query(f"with {MET}, a as (select doc_id, term from met), r as (select doc_id, term from met where source = 'names') select distinct doc_id, term from a where (doc_id, term) not in (select doc_id, term from r)")
def tag_difference(spark, sf_dir):
    met = tag_dictionary(spark, sf_dir)
    return met.select("doc_id", "term").distinct().join(met.where("source = 'names'").select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")


@query("""select doc_id, n as section_number, len(ls) as total_sections, length(ls[n]) as chars, md5(ls[n]) as digest
from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as n from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))""")
def section_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("ref"), F.split("text", "\n", -1).alias("text"), F.expr(text.NO_STRINGS).alias("he"))
    parts = page_sources.split_sections(docs)
    return parts.select(F.col("page_ref").cast("long").alias("doc_id"), F.col("section_number").cast("long").alias("section_number"), F.col("total_sections").cast("long").alias("total_sections"), F.length("en_text").cast("long").alias("chars"), F.md5("en_text").alias("digest"))


@query("""with s as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn) as n from conversations where role in ('user', 'assistant'))
select coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.n, a.n) as section_number, md5(coalesce(u.text, '')) as en, md5(coalesce(a.text, '')) as he
from (select * from s where role = 'user') u full join (select * from s where role = 'assistant') a on u.conv_id = a.conv_id and u.n = a.n""")
def parallel_zip(spark, sf_dir):
    side = lambda role: F.transform(F.array_sort(F.filter("turns", lambda t: t["role"] == role)), lambda t: F.coalesce(t["text"], F.lit("")))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    rows = page_sources.split_sections(convs.select(F.col("conv_id").cast("string").alias("ref"), side("user").alias("text"), side("assistant").alias("he")))
    return rows.select(F.col("page_ref").cast("long").alias("conv_id"), F.col("section_number").cast("long").alias("section_number"), F.md5("en_text").alias("en"), F.md5("he_text").alias("he"))


@query("""select 'Work.' || n || s as ref from range(2, 65) r(n), (values ('a'), ('b')) v(s) where not (n = 2 and s < 'b') and not (n = 64 and s > 'a')""")
def page_range(spark, sf_dir):
    return page_sources.page_range(spark, "Work", "2b", "64a").select("ref")


@query("select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("select page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) as heading from pages")
def heading_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))).alias("heading"))


@query(r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_replace(url, '/[^/]*$', '') as parent, upper(substr(regexp_extract(url, '^https?://([^/?#]+)', 1), 1, 1)) as letter from pages")
def url_parts(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_replace("url", "/[^/]*$", "").alias("parent"), text.letter_bucket(host).alias("letter"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("select c_custkey, case when regexp_matches(c_name, '^[A-Za-z]') then upper(substr(c_name, 1, 1)) else '#' end as letter, lower(trim(c_name, '.:, ')) as value from customer")
def name_values(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.letter_bucket(F.col("c_name")).alias("letter"), text.tag_value(F.col("c_name")).alias("value"))


@query("select upper(substr(n_name, 1, 1)) as letter, count(*) as n, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def letter_groups(spark, sf_dir):
    return indexing.letter_groups(table(spark, sf_dir, "nation"), "n_name").select("letter", "n", F.array_join("names", ",").alias("names"))


@query("""select user_id, ts, event_type, value, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_type, value rows between unbounded preceding and current row) as last_purchase from events""")
def forward_fill(spark, sf_dir):
    order = W.partitionBy("user_id").orderBy("ts", "event_type", "value").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(order).alias("last_purchase"))


@query("select * from (select user_id, ts, event_type, value, row_number() over (partition by user_id order by ts, event_type, value) as rank from events) where rank <= 5")
def first_events(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_type", "value"))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", rank.cast("long").alias("rank")).where("rank <= 5")


HEADERS = ["thing", "thatin", "that", "nicht", "eau", "th"]


@query(f"""select doc_id, (select name from (values {", ".join(f"('{n}', {k})" for k, n in enumerate(HEADERS))}) v(name, k) where strpos(text, name) > 0 order by strpos(text, name), -length(name), k limit 1) as found from documents""")
def earliest_hit(spark, sf_dir):
    return indexing.earliest_name(table(spark, sf_dir, "documents"), HEADERS, ["doc_id"])


@query("""with f as (select source, doc_id, (select name from (values """ + ", ".join(f"('{n}', {k})" for k, n in enumerate(HEADERS[:4])) + """) v(name, k) where strpos(text, name) > 0 order by strpos(text, name), -length(name), k limit 1) as found from documents)
select source, doc_id as page_no, last_value(found ignore nulls) over (partition by source order by doc_id rows between unbounded preceding and current row) as entry from f""")
def running_headers(spark, sf_dir):
    return indexing.running_headers(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_no"), HEADERS[:4], "source")


def glossary_of(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.replace("p_type", F.lit(" "), F.lit("; ")).alias("categories"), F.concat(F.col("p_brand"), F.lit(";;")).alias("variant_names"), F.col("p_size").cast("string").alias("corpus_count"))
    return tables.glossary_entries(part)


GLOSSARY_SQL = """g as (select p_name as term, string_split(p_type, ' ') as categories, p_brand, p_size, lower(p_name || ' ' || replace(p_type, ' ', '; ') || ' ' || p_brand || ';; ' || p_size) as blob from part)"""


@query(f"with {GLOSSARY_SQL} select term, p_size as count_int from g where contains(blob, 'brand#1') and list_contains(categories, 'PROMO')")
def glossary_filter(spark, sf_dir):
    return glossary.filter_entries(glossary_of(spark, sf_dir), " Brand#1 ", "PROMO").select("term", "count_int")


@query(f"with {GLOSSARY_SQL} select distinct unnest(categories) as category from g")
def glossary_categories(spark, sf_dir):
    return glossary.categories(glossary_of(spark, sf_dir))


@query(f"with {GLOSSARY_SQL} select (select count(*) from g where contains(blob, 'brand#1') and list_contains(categories, 'PROMO')) as n_shown, count(*) as n_total from g")
def glossary_counts(spark, sf_dir):
    return glossary.counts(glossary_of(spark, sf_dir), "brand#1", "PROMO")


@query("""select source, length(string_agg(line, ' ' order by doc_id, n)) as chars, md5(string_agg(line, ' ' order by doc_id, n)) as digest
from (select source, doc_id, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from documents where text is not null) group by source""")
def page_text_concat(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("source", F.struct("doc_id", "n").alias("order"), "line")
    return tagging.joined_text(lines, "source", "order", ["line"]).select("source", F.length("line").cast("long").alias("chars"), F.md5("line").alias("digest"))


@query(r"""select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s, e' \t\n\r')), lambda s: s <> '')) as n_sentences from documents where text is not null""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("select 'שלום' as plain, 'מַיִם' as pointed, regexp_replace('מַיִם', '[֑-ׇ]', '', 'g') as stripped")
def nikud_strip(spark, sf_dir):
    return spark.range(1).select(F.lit("שלום").alias("plain"), F.lit("מַיִם").alias("pointed"), text.strip_vowel_signs(F.lit("מַיִם")).alias("stripped"))


@query("""with e as (select label, unnest(embedding) as x, unnest(range(len(embedding))) as k from embeddings), m as (select label, k, avg(cast(x as double)) as x from e group by all)
select label, round(sum(x * (k + 1)), 3) as checksum, count(*) as width from m group by label""")
def mean_pooling(spark, sf_dir):
    """Vectors are summed place by place before the shuffle, not gathered by label."""
    places = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    means = places.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.round(F.sum(F.col("x") * (F.col("k") + 1)), 3).alias("checksum"), F.count("*").alias("width"))


@query("""select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id""")
def label_lookup(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def long_phrases(spark, sf_dir):
    """Benchmark texts that documents hold as they are."""
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase")), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return matching.phrase_matches(docs, "doc_id", "body", items, "item_id", "phrase")


@query()
def topic_model(spark, sf_dir):
    return topics.topic_words(topics.fit_topics(table(spark, sf_dir, "documents").select("text")))


@query()
def annotate_documents(spark, sf_dir):
    """Rule-based analysis of documents, tags from it, and annotated sentences."""
    docs = once(annotating.annotate(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")))
    entities = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
    tags = tagging.generate_tags(docs.select("doc_id", "text", entities.alias("entities"), "noun_phrases"), terms(spark), "doc_id")
    lookup = tagging.page_lookup(tags, "doc_id").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("lookup", "label"))).alias("lookup"))
    none = F.expr("cast(array() as array<struct<rank: int, term: string, label: string>>)")
    annotated = annotating.annotate_sentences()("text", "entities", "sentences", F.coalesce("lookup", F.expr("cast(map() as map<string, string>)")), none)
    return docs.join(lookup, "doc_id", "left").select("doc_id", annotated.alias("sentences"))
