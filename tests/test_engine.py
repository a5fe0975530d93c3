"""Text functions, matching, tagging, views and all registered queries."""

import html

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text
from tessera.operators import annotating, glossary, indexing, matching, tagging, topics
from tessera.plans import catalog, pipeline
from tessera.sources import pages, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (text.rewrite_terms, "Rabbi Akiva, son of Rabbi X; the leper", "R' Akiva, ben X; the metzora"),
        (text.rewrite_terms, "rabbinic Sages", "rabbinic rabbis"),
        (text.clean_english, "<b>A <i>b</i></b> no <b>c\nd</b><b> </b>", "A b c d"),
        (text.clean_english, "plain", ""),
        (text.bold_italics, "<b>x <i>Tefillin.</i> <i>bat kol</i></b><i>out</i>", ["bat kol", "tefillin"]),
        (text.clean_other, " <b>a</b>\nb ", "a b"),
        (text.bold_text, "<b>a</strong> x <strong>b</strong>", "a b"),
        (text.repair_diacritics, "Ra?av and ?anina", "Raḥav and Ḥanina"),
        (text.html_unescape, "a&eacute;&amp;&lt;", "aé&<"),
        (text.html_escape, "<a&'\">", html.escape("<a&'\">")),
        (text.strip_vowel_signs, "מַיִם", "מים"),
        (text.sentences, "<b>a</b>. b! ", ["a", "b"]),
        (text.tag_value, " .Moses,:", "moses"),
        (text.markdown_escape, "a*b.", "a\\*b\\."),
        (text.rewrite_display, "<i title='the Lord'>the Lord</i> Rabbi X", "<i title='the Lord'>YHWH</i> R' X"),
        (lambda x: text.reader_url(x, "u"), "Bava Kamma 2a:3", "u/bava-kamma/2a#section-3"),
        (lambda x: text.reader_url(x, "u"), "nowhere", None),
        (text.page_of, "A 2a:1", "A 2a"),
        (text.letter_bucket, "éa", "É"),
        (text.letter_bucket, "1a", "#"),
        (text.wiki_title, "https://x/wiki/A_b%27c#d", "A b'c"),
        (text.wiki_title, "https://x/wiki/%zz", "https://x/wiki/%zz"),
        (text.uri_component, "a b+(c)!*~'", "a%20b%2B(c)!*~'"),
        (text.parts_of, "a; b;;", ["a", "b"]),
        (text.shown_count, "0", "-"),
        (lambda x: text.has_term(x, "ḥisda"), "Rav Ḥisda", True),
        (lambda x: text.has_term(x, "isda"), "Rav Ḥisda", False),
    ],
)
def test_text(spark, f, x, want):
    assert value(spark, f, x) == want


def test_highlight(spark):
    row = spark.createDataFrame([("no Abel <b>Abel <i abel='1'>abel</i></b>", "Abel")], "h string, n string")
    assert row.select(text.highlight_name("h", "n")).first()[0] == "no Abel <b><mark>Abel</mark> <i abel='1'><mark>abel</mark></i></b>"


def test_sections(spark):
    df = spark.createDataFrame([("P 2a", ["a", "b"], ["x"]), ("P 2b", None, None)], pages.PAGE)
    got = pages.split_sections(df).orderBy("ref").collect()
    assert [(r.ref, r.en_text, r.he_text, r.total_sections) for r in got] == [("P 2a:1", "a", "x", 2), ("P 2a:2", "b", "", 2)]
    assert [r.page for r in pages.page_range(spark, "P", "2b", "3a").orderBy("number", "side").collect()] == ["2b", "3a"]
    assert pages.page_range(spark, "P", "4a", "3a").count() == 0


def test_fetch(spark):
    def fetch(ref):
        if ref == "bad":
            raise RuntimeError("404")
        return '{"ref": "P 2a", "text": ["a"]}'

    got = {r.requested: r for r in pages.fetch_pages(spark.createDataFrame([("P.2a",), ("bad",)], "ref string"), fetch).collect()}
    assert got["P.2a"].payload.text == ["a"] and got["bad"].error == "404"


def test_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" Moses \n\nAaron\nMoses\n", encoding="utf-8")
    assert sorted(r.term for r in tables.read_terms(spark, str(tmp_path / "t.txt"), "names").collect()) == ["Aaron", "Moses"]
    assert tables.read_terms(spark, str(tmp_path / "no.txt"), "names").count() == 0
    (tmp_path / "r.csv").write_bytes('l,h\nA 2a:1,"x “y”\nz"\nshort\n'.encode("cp1252"))
    assert [tuple(r) for r in tables.read_rich_rows(spark, str(tmp_path / "r.csv")).collect()] == [(1, "A 2a:1", "x “y”\nz")]
    assert tables.probe_encoding(spark, str(tmp_path / "r.csv")) == "latin-1"
    (tmp_path / "g.csv").write_text('term,categories,my_corpus_count\nAbaye,"a; b",10\nRava,b,9\n,,\n')
    entries = tables.read_glossary(spark, str(tmp_path / "g.csv"))
    assert [r.term for r in glossary.sort_entries(entries, "count_int").collect()] == ["Abaye", "Rava"]
    assert [r.category for r in glossary.categories(entries).collect()] == ["a", "b"]
    assert [r.term for r in glossary.filter_entries(entries, " RAV ", "b").collect()] == ["Rava"]


TERMS = [("names", "Rabbi Akiva"), ("names", "Rav Ashi"), ("names", "David"), ("toponyms", "Babylonia"), ("toponyms", "Akko"), ("concepts", "Shekhina"), ("concepts", "bat kol"), ("concepts", "Shabbat"), ("bible_names", "Moses"), ("bible_names", "David")]


@pytest.mark.parametrize(
    ("words", "entities", "phrases", "want"),
    [
        ("x", [("Rabbi Akiva", "PERSON"), ("Babylonia", "GPE"), ("Moses", "PERSON"), ("Genesis", "WORK_OF_ART")], [], ["person:bible:moses", "person:rabbi akiva", "place:babylonia"]),
        ("x", [], ["the prayer", "blessings"], ["topic:blessings", "topic:prayer"]),
        ("david and Rav Ashi came", [], [], ["person:bible:david", "person:rav ashi"]),
        ("in Akko a bat kol", [], [], ["concept:bat kol", "place:akko"]),
        ("on Shabbat", [], ["Shabbat law"], ["concept:shabbat", "topic:halacha"]),
        ("x", [("Lord", "PERSON"), ("Today", "PERSON"), ("man of Akko", "PERSON"), ("Rav Ashi", "GPE")], [], ["concept:divine_name_lord"]),
    ],
)
def test_tags(spark, words, entities, phrases, want):
    docs = spark.createDataFrame([(1, words, entities, phrases)], "key long, text string, entities array<struct<text: string, label: string>>, noun_phrases array<string>")
    assert tagging.generate_tags(docs, spark.createDataFrame(TERMS, "source string, term string")).first().tags == want


def test_lookup(spark):
    tags = spark.createDataFrame([("p", ["person:shema", "concept:shema", "person:master", "person:bible:moses", "concept:bat_kol"])], "page string, tags array<string>")
    got = {r.lookup: r.label for r in tagging.page_lookup(tags, "page").collect()}
    assert got == {"shema": "concept", "master": "person", "the master": "person", "bible:moses": "person", "bat kol": "concept"}


def test_annotation():
    s = "Moses saw the First Temple in May at IBM."
    ents = [(0, 5, "Moses", "PERSON"), (30, 33, "May", "DATE"), (37, 40, "IBM", "ORG"), (20, 26, "Temple", "FAC")]
    got = annotating.annotate_sentence(s, ents, {"moses": "person:bible"}, [(1, "First Temple", "place")])
    assert got == "**Moses**`[person:bible]` saw the **First Temple**`[place]` in **May**`[DATE]` at IBM."
    assert "**May**" not in annotating.annotate_sentence(s, ents[1:2], {}, [(1, "First Temple", "place")], compat=True)


def test_index_and_concordance(spark):
    rows = spark.createDataFrame([(1, "A 2a:1", "<b>bat kol, kol</b> Abel"), (2, "A 2a:2", "<b>Kol</b> &lt;b&gt;"), (3, "A 10b:1", "<b>abel</b>")], "row_idx long, location string, html string")
    got = indexing.page_index(rows, ["kol", "bat kol"]).collect()
    assert [(r.location, r.keywords, r.n_total) for r in got] == [("A 2a", "kol, bat kol", 3)]
    names = spark.createDataFrame([("Abel",), ("bat kol",)], "term string")
    found = indexing.concordance(rows, names)
    assert sorted((r.name, r.total, r.location) for r in found.collect()) == [("Abel", 1, "A 10b:1"), ("bat kol", 1, "A 2a:1")]
    cards = pipeline.concordance_html(found)
    assert "<mark>abel</mark>" in cards.where("name = 'Abel'").first().card
    heads = indexing.running_headers(spark.createDataFrame([(1, "see Cain"), (2, "none"), (3, "Abel Cain")], "page_no int, text string"), ["Abel", "Cain"])
    assert [r.entry for r in heads.orderBy("page_no").collect()] == ["Cain", "Cain", "Abel"]


def test_substrings_longest_first(spark):
    df = spark.createDataFrame([(1, "First Temple, sinful")], "k long, t string")
    assert [r.keyword for r in matching.substring_matches(df, ["k"], "t", ["Temple", "First Temple", "sin"]).orderBy("place").collect()] == ["first temple", "sin"]


def test_page_pipeline(spark, tmp_path):
    df = spark.createDataFrame([("P 2a", ["<b>Rabbi Moses</b> x", ""], ["אַב.", ""])], pages.PAGE)
    terms = spark.createDataFrame(TERMS, "source string, term string")
    got = pipeline.process_pages(pages.split_sections(df), terms, embed=annotating.hashed_embedding(4))
    row = got.first()
    assert row.section_count == 2 and len(row.sections) == 1 and "person:bible:moses" in row.tags
    pipeline.write_pages_json(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert pipeline.plain_markdown(pages.split_sections(df)).first().document.startswith("# P 2a (Section-Aware Analysis)\n\n## Section 1\n")
    assert "- a" in pipeline.page_markdown("P", ["a"], [], [], ["s"]) and "## Section 1" in pipeline.sections_markdown("P", [{"section_number": 1, "tags": ["a"], "italics": [], "other": [], "annotated": ["s"]}])


def test_stream(spark, tmp_path):
    from tessera.streaming import tagging as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ref": "P 2a", "text": ["<b>David</b>"], "he": []}\n')
    terms = spark.createDataFrame(TERMS, "source string, term string")
    q = stream.write_matches(stream.section_stream(stream.page_stream(spark, str(tmp_path / "in"))), terms, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.source for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"names", "bible_names"}


def test_topics(spark):
    docs = spark.createDataFrame([("apple banana fruit",), ("apple fruit sweet",), ("engine wheel car",), ("car wheel road",)], "text string")
    got = topics.topic_words(topics.fit_topics(docs, 2, max_share=0.9)).collect()
    assert len(got) == 2 and all(0 < len(r.words) <= 10 for r in got)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted((tuple("" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
