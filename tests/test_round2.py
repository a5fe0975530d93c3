"""Later additions: page documents, phrases, natural order, tables by name, null keys."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text, values
from tessera.operators import annotating, glossary, matching, tagging, topics
from tessera.plans import pipeline
from tessera.sources import pages, tables

TERMS = [("names", "Rabbi Akiva"), ("toponyms", "First Temple"), ("bible_names", "Moses"), ("concepts", "bat kol")]


@pytest.fixture(scope="module")
def processed(spark):
    df = spark.createDataFrame([("P 2a", ["<b>Then Moses saw the <i>bat kol</i> at First Temple.</b> x", "", "<b>It was Moses.</b>"], ["אַב. בַּיִת", "", ""]), ("P 2b", ["<b>Nothing.</b>"], [])], pages.PAGE)
    sections = pages.split_sections(df)
    return pipeline.process_pages(sections, spark.createDataFrame(TERMS, "source string, term string"), embed=annotating.hashed_embedding(4)).cache()


def test_page_documents(processed):
    got = {r.page_ref: r.document for r in pipeline.page_documents(processed).collect()}
    assert "**Moses**`[PERSON]`" in got["P 2a"] and "**First Temple**`[place]`" in got["P 2a"] and "- concept:bat kol" in got["P 2a"] and '<div dir="rtl">אב</div>' in got["P 2a"]
    assert got["P 2b"].startswith("# P 2b\n\n## Tags\n\nNo tags generated.") and "No Hebrew text available." in got["P 2b"]


def test_section_documents(spark, processed):
    terms = spark.createDataFrame(TERMS, "source string, term string")
    got = {r.page_ref: r.document for r in pipeline.section_documents(processed, terms).collect()}
    assert "**First Temple**`[place]`" in got["P 2a"] and "**Moses**`[person:bible]`" in got["P 2a"] and "## Section 3" in got["P 2a"] and "## Section 2" not in got["P 2a"]


def test_page_files(processed, tmp_path):
    pipeline.write_page_files(processed, str(tmp_path / "files"))
    page = json.loads((tmp_path / "files/P_2a.json").read_text(encoding="utf-8"))
    assert page["he_processed"] == {"embedding_shape": [1, 4]} and page["section_count"] == 3 and len(page["sections"]) == 2
    assert page["sections"][0]["en_processed"]["italicized_words"] == ["bat kol"] and page["en_processed"]["sentences"]
    pipeline.write_pages_json(processed, str(tmp_path / "json"))
    pipeline.write_markdown(pipeline.page_documents(processed), str(tmp_path / "md"))
    assert sorted(p.name for p in (tmp_path / "md").glob("page=*")) == ["page=P_2a", "page=P_2b"]


def test_texts_are_analysed_once(spark, processed):
    plan = processed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") <= 1


def test_natural_key(spark):
    names = ["a9", "a10", "a09b", "a123456789012345678901", "a123456789012345678900", "Á1", "b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
    got = [r.n for r in glossary.numbered(rows, [text.natural_key(F.col("n"))]).orderBy("row_no").collect()]
    assert got == ["Á1", "a9", "a09b", "a10", "a123456789012345678900", "a123456789012345678901", "b"]


def test_phrases(spark):
    docs = [(1, "xone two three four five six seven eighty."), (2, "a one-two b"), (3, "nothing"), (4, None), (5, "One two")]
    phrases = [(10, "one two three four five six seven eight"), (11, "one-two"), (12, "-"), (13, None), (14, "one two three"), (15, ""), (16, "two")]
    for block in (1, 1 << 20):
        got = matching.phrase_matches(spark.createDataFrame(docs, "doc_id long, body string"), "doc_id", "body", spark.createDataFrame(phrases, "item_id long, phrase string"), "item_id", "phrase", most_bytes=block).collect()
        want = {(i, k) for i, body in docs for k, p in phrases if body is not None and p is not None and p in body}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_null_keys_keep_tags(spark):
    docs = spark.createDataFrame([(None, "saw Moses"), (1, "none")], "key long, text string").withColumns({"entities": F.expr("cast(array() as array<struct<text: string, label: string>>)"), "noun_phrases": F.expr(text.NO_STRINGS)})
    got = {r.key: r.tags for r in tagging.generate_tags(docs, spark.createDataFrame(TERMS, "source string, term string")).collect()}
    assert got == {None: ["person:bible:moses"], 1: []}


def test_tables_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes('id,Column2,Column1\n1,"é “y”, z",A 2a:1\n2,short\n3,x,B 2a:1\n'.encode("cp1252"))
    assert [tuple(r) for r in tables.read_rich_rows(spark, str(tmp_path / "r.csv"), columns=("Column1", "Column2")).orderBy("row_idx").collect()] == [(1, "A 2a:1", "é “y”, z"), (2, None, "short"), (3, "B 2a:1", "x")]
    (tmp_path / "u.csv").write_text("l,h\nA 2a:1,שלום\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_rich_file(spark, str(tmp_path / "u.csv")).collect()] == [(1, "A 2a:1", "שלום")]
    assert tables.read_rich_rows(spark, str(tmp_path / "r.csv"), first=1).count() == 1
    (tmp_path / "n.txt").write_text("b\nA\nc\n")
    assert [r.term for r in tables.read_names(spark, str(tmp_path / "n.txt")).collect()] == ["A", "b", "c"]
    assert tables.read_term_lines(spark, str(tmp_path / "n.txt")) == ["b", "A", "c"]


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ref": "P 2a",\n "text": ["x"], "he": []}')
    assert pages.read_pages(spark, str(tmp_path)).first().ref == "P 2a"


def test_index_and_concordance_files(spark, tmp_path):
    index = spark.createDataFrame([("A 2a", "kol", "u/A.2a", 1, 1)], "location string, keywords string, link string, n_keywords long, n_total long")
    pipeline.write_index_csv(index, str(tmp_path / "index"))
    assert duckdb.sql(f"select * from read_csv('{tmp_path}/index/*.csv', header=true)").fetchall() == [("A 2a", "kol", "u/A.2a")]
    cards = spark.createDataFrame([("B", "Boaz", "<h3>Boaz</h3>"), ("A", "Abel", "<h3>Abel</h3>")], "letter string, name string, card string")
    pipeline.concordance_page(cards, {"n_names": 3, "n_found": 2, "n_entries": 2}, str(tmp_path / "c.html"))
    page = (tmp_path / "c.html").read_text(encoding="utf-8")
    assert page.index("Abel") < page.index("Boaz") and "2 of 3 names, 2 entries" in page


def test_topics_use_every_document(spark):
    docs = spark.createDataFrame([("apple banana fruit",)] * 2 + [("engine wheel car",)] * 2, "text string")
    model = topics.fit_topics(docs, 2, stop_words=["fruit"], max_share=0.9)
    assert sorted(model.stages[2].vocabulary) == ["apple", "banana", "car", "engine", "wheel"]
    assert model.stages[3].getSubsamplingRate() == 1.0


def test_topics_by_definition(spark):
    """A fit over several blocks against one plain variational Bayes on the whole; the model holds the vocabulary and the weights as tables, not as lists of the driver."""
    rng = np.random.default_rng(1)
    words = [f"w{k:02d}" for k in range(40)]
    texts = [" ".join(rng.choice(words[20 * (d % 2) : 20 * (d % 2) + 20], rng.integers(1, 60))) for d in range(30)] + ["a !"]
    rows = [[t.split().count(w) for w in words] for t in texts[:-1]]
    n_docs = (np.array(rows) > 0).sum(0)
    assert ((n_docs >= 2) & (n_docs <= 0.95 * len(texts))).all()
    weights, alpha = topics.first_weights(0, len(words), 2, 3), np.full(2, 0.5)
    psi = topics.digamma
    for i in range(1, 4):
        beta, sums, logs, w = np.exp(psi(weights) - psi(weights.sum(1))[:, None]), 0, 0, (1024 + i) ** -0.51
        for c in np.array(rows):
            gamma = np.ones(2)
            for _ in range(5000):
                theta = np.exp(psi(gamma) - psi(gamma.sum()))
                gamma = theta * (beta @ (c / (theta @ beta))) + alpha
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            sums, logs = sums + theta[:, None] * (c / (theta @ beta)) * beta, logs + psi(gamma) - psi(gamma.sum())
        weights, alpha = (1 - w) * weights + w * (sums + 0.5), topics.better_alpha(alpha, logs, len(rows), w)
    model = topics.fit_topics(spark.createDataFrame([(t,) for t in texts + [None]], "text string").repartition(3), 2, seed=3, iterations=3, stop_words=["none"])
    got = np.concatenate([x for _, x in sorted(model.stages[3].weights.collect(), key=lambda x: x[0])], axis=1)
    assert model.stages[2].vocabulary == words and np.allclose(got, weights, atol=0.01)
    found = topics.topic_words(model, 5)
    assert [r.words for r in found.orderBy("topic").collect()] == [[words[k] for k in np.argsort(-x)[:5]] for x in got]
    assert not any(isinstance(x, list) and len(x) >= len(words) for x in vars(model.stages[2]).values())


def test_topics_in_parts():
    """Documents of unlike lengths inferred together, and each alone."""
    assert np.allclose(topics.digamma(np.array([0.2, 1, 5, 1e6])), [-5.2890398966, -0.5772156649, 1.5061176685, 13.8155100580]) and np.allclose(topics.trigamma(np.array([1.0, 5])), [1.6449340668, 0.2213229557])
    rng = np.random.default_rng(0)
    lengths, beta, alpha = np.array([1, 3, 900, 2, 40]), rng.random((1000, 3)), np.array([0.1, 0.3, 0.6])
    places, counts = np.concatenate([rng.choice(1000, n, replace=False) for n in lengths]), rng.integers(1, 9, lengths.sum()).astype(np.float32)
    whole = topics.block_sums(np.cumsum(lengths), places, counts, beta, alpha)
    alone = [topics.block_sums(np.array([n]), places[e - n : e], counts[e - n : e], beta, alpha) for n, e in zip(lengths, np.cumsum(lengths), strict=True)]
    assert np.allclose(whole[0], sum(x for x, *_ in alone), rtol=1e-4) and np.allclose(whole[1], sum(x for _, x, _ in alone), rtol=1e-4) and np.isclose(whole[0].sum(), counts.sum())


def test_cut_off_references(spark, tmp_path):
    """Pages that end within a reference keep its start, as the SQL has it."""
    from tessera.plans import catalog, text_queries  # noqa: F401  the second one registers its queries in the first

    texts = ["<p>a &amp; b&ampp{x}", "&am&quot;p; &&amp;copy; &copy &copy;", "&middot;&amp;amp;quot;", "&lt; &#65;", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = dict(duckdb.sql(catalog.ORACLES["html_unescape"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'")).fetchall())
    assert {r.page_id: r.text for r in catalog.QUERIES["html_unescape"](spark, str(tmp_path)).collect()} == want


def test_rewrites_search_only_what_is_held(spark):
    """The rewrites by rules against one after another, on terms side by side in any case and in letters that fold to a-z; patterns aren't run one within another over every text."""
    rng = np.random.default_rng(0)
    parts = [w for pair in values.TERM_REWRITES for w in pair] + [" ", ", ", "x", "the ", "son of ", "with "]
    fold = {"s": "ſ", "k": "K", "i": "ı", "I": "İ"}
    letter = lambda c: [c, c.upper(), c.lower(), fold.get(c, c)][rng.integers(4)] if rng.random() < 0.15 else c
    texts = ["".join(letter(c) for _ in range(rng.integers(1, 16)) for c in rng.choice(parts) + " "[: rng.integers(2)]) for _ in range(2000)] + ["", None]
    x = F.col("x")
    plain = x
    for old, new in values.TERM_REWRITES:
        plain = F.replace(plain, F.lit(old), F.lit(new)) if old in values.PLAIN_REWRITES else F.regexp_replace(plain, text.whole_word(old), new)
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", text.rewrite_terms(x).alias("got"), plain.alias("want"))
    assert df.where("not got <=> want").count() == 0 and df.where("not x <=> want").count() > 1000
    assert df.select("got")._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(") <= 1


def test_annotation_in_runs(spark):
    """Texts are annotated a bounded number of bytes at a time, long and missing ones too, with the same results."""
    import pyarrow as pa

    texts = ["x" * (annotating.MOST_BYTES + 5), None, "It is Moses here. Nothing.", "y" * (annotating.MOST_BYTES - 40), "", "x is Aaron there"]
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert [len(r) for r in annotating.runs(rows, rows.column("t"))] == [1, 4, 1] and list(annotating.runs(rows.slice(0, 0), rows.column("t").slice(0, 0))) == []
    docs = annotating.annotate(spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1))
    lookup, none = F.expr("map('moses', 'person:bible')"), F.expr("cast(array() as array<struct<rank: int, term: string, label: string>>)")
    got = {r.k: r.s for r in docs.select("k", annotating.annotate_sentences(escape=False)("text", "entities", "sentences", lookup, none).alias("s")).collect()}
    assert got == {0: [texts[0]], 1: [], 2: ["It is **Moses**`[person:bible]` here.", "Nothing."], 3: [texts[3]], 4: [], 5: ["x is **Aaron**`[PERSON]` there"]}
