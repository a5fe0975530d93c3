"""The page pipeline: sections in, tagged and annotated pages out; and its writers."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..functions.reuse import once
from ..operators import annotating, tagging
from ..sources import pages as sources


def process_sections(sections: DataFrame, terms: DataFrame, make=lambda: annotating.simple_annotator, embed=None) -> DataFrame:
    """Sections with cleaned texts, analysis, embedding and tags. Sections without any text go."""
    rows = sources.with_text(sections)
    rows = rows.withColumn("en_text_processed", text.rewrite_terms(F.col("en_text")))
    rows = rows.withColumns({"he_text_cleaned": text.clean_other(F.col("he_text")), "text": text.clean_english(F.col("en_text_processed")), "italicized_words": text.bold_italics(F.col("en_text_processed"))})
    rows = once(annotating.annotate(rows, make))  # each text is analysed once, whatever reads it
    if embed:
        rows = rows.withColumn("embedding", embed(F.col("he_text_cleaned")))
    return rows.join(tagging.generate_tags(rows, terms, "ref"), "ref", "left")


def process_pages(sections: DataFrame, terms: DataFrame, make=lambda: annotating.simple_annotator, embed=None) -> DataFrame:
    """Pages: joined texts analysed anew, tags and italics of all sections; section_count counts blank sections too."""
    done = once(process_sections(sections, terms, make, embed))
    joined = tagging.joined_text(sources.with_text(sections), "page_ref", "section_number", ["en_text", "he_text"])
    page = joined.withColumn("en_text_processed", text.rewrite_terms(F.col("en_text"))).withColumn("text", text.clean_english(F.col("en_text_processed")))
    page = page.withColumn("he_text_cleaned", text.clean_other(F.col("he_text")))
    if embed:
        page = page.withColumn("embedding", embed(F.col("he_text_cleaned")))
    page = once(annotating.annotate(page, make))
    for column in ("tags", "italicized_words"):
        page = page.join(tagging.union_by_page(done, "page_ref", column), "page_ref", "left").withColumn(column, F.coalesce(column, F.expr(text.NO_STRINGS)))
    kept = [c for c in ("section_id", "section_number", "ref", "en_text", "en_text_processed", "he_text", "he_text_cleaned", "text", "tags", "entities", "noun_phrases", "sentences", "italicized_words", "embedding") if c in done.columns]
    nested = done.groupBy("page_ref").agg(F.array_sort(F.collect_list(F.struct(*[F.col("section_number").alias("__n"), *kept]))).alias("sections"))
    count = sections.groupBy("page_ref").agg(F.max("total_sections").alias("section_count"))
    return page.join(nested, "page_ref", "left").join(count, "page_ref")


def analysed(x) -> Column:
    """en_processed of a page, or of a section within (x gives its columns): what a page file holds of the analysis."""
    texts = lambda c, *keys: F.transform(x(c), lambda e: F.struct(*(e[k].alias(k) for k in keys)) if len(keys) > 1 else e[keys[0]])
    english = F.struct(texts("entities", "text", "label").alias("entities"), x("noun_phrases").alias("noun_phrases"), texts("sentences", "text").alias("sentences"), x("italicized_words").alias("italicized_words"))
    return english.alias("en_processed")


def shape(embedding: Column) -> Column:
    """embedding_shape of a pooled vector: one row of its width; null without one."""
    return F.struct(F.when(embedding.isNotNull(), F.array(F.lit(1), F.size(embedding))).alias("embedding_shape")).alias("he_processed")


def page_objects(pages: DataFrame) -> DataFrame:
    """What a page file holds, for each page of process_pages()."""
    embedded = "embedding" in pages.columns
    own = lambda c: F.col(c)
    none = F.lit(None).cast("array<double>")

    def section(s: Column) -> Column:
        kept = [s[c].alias(c) for c in ("section_id", "section_number", "ref", "en_text", "en_text_processed", "he_text", "he_text_cleaned", "tags")]
        return F.struct(*kept, analysed(lambda c: s[c]), shape(s["embedding"] if embedded else none))

    return pages.select(F.col("page_ref").alias("ref"), "en_text", "en_text_processed", "he_text", analysed(own), shape(F.col("embedding") if embedded else none), "tags", "section_count", F.transform("sections", section).alias("sections"))


def write_pages_json(pages: DataFrame, path: str) -> None:
    """One JSON object a line for each page, UTF-8 as it is; nulls are kept."""
    page_objects(pages).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_page_files(pages: DataFrame, folder: str) -> None:
    """Small exports: an indented JSON file a page, streamed through the driver a page at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in page_objects(pages).toLocalIterator():
        name = row["ref"].replace(" ", "_")
        (Path(folder) / f"{name}.json").write_text(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2), encoding="utf-8")


def page_documents(pages: DataFrame) -> DataFrame:
    """page_ref and document: each page of process_pages() as Markdown, its sentences annotated by the page's tags."""

    @F.pandas_udf("string")
    def written(refs: pd.Series, tags: pd.Series, italics: pd.Series, other: pd.Series, annotated: pd.Series) -> pd.Series:
        return pd.Series([page_markdown(r, list(t), list(i), list(o), list(a)) for r, t, i, o, a in zip(refs, tags, italics, other, annotated, strict=True)], dtype=object)

    lookup = tagging.page_lookup(pages, "page_ref").groupBy("page_ref").agg(F.map_from_entries(F.collect_list(F.struct("lookup", "label"))).alias("lookup"))
    no_terms = F.expr("cast(array() as array<struct<rank: int, term: string, label: string>>)")
    rows = pages.join(lookup, "page_ref", "left").withColumn("lookup", F.coalesce("lookup", F.expr("cast(map() as map<string, string>)")))
    rows = rows.withColumn("annotated", annotating.annotate_sentences()("text", "entities", "sentences", "lookup", no_terms))
    return rows.select("page_ref", written("page_ref", "tags", F.array_sort("italicized_words"), text.sentences(F.col("he_text")), "annotated").alias("document"))


def section_documents(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """page_ref and document: each page section by section, sentences annotated by the dictionaries' terms."""
    ranked = tagging.section_lookup(terms)
    lists = ranked.agg(F.collect_list(F.struct("lookup", "label")).alias("pairs"), F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, values.SECTION_PRIORITY)), "label").cast("int").alias("rank"), "term", "label")).alias("phrases"))

    @F.pandas_udf("string")
    def written(refs: pd.Series, sections: pd.Series, annotated: pd.Series) -> pd.Series:
        out = []
        for ref, own, sentences in zip(refs, sections, annotated, strict=True):
            out.append(sections_markdown(ref, [{"section_number": s["section_number"], "tags": list(s["tags"]), "italics": list(s["italicized_words"]), "other": list(s["other"]), "annotated": list(a)} for s, a in zip(own, sentences, strict=True)]))
        return pd.Series(out, dtype=object)

    one = pages.select("page_ref", F.posexplode_outer("sections").alias("place", "s")).crossJoin(F.broadcast(lists))  # one row: the dictionary
    annotated = annotating.annotate_sentences(escape=False)("s.text", "s.entities", "s.sentences", F.map_from_entries("pairs"), "phrases")
    rows = one.withColumn("annotated", annotated).groupBy("page_ref").agg(F.array_sort(F.collect_list(F.struct("place", F.col("s.section_number").alias("section_number"), F.col("s.tags").alias("tags"), F.col("s.italicized_words").alias("italicized_words"), text.sentences(F.col("s.he_text")).alias("other"), "annotated"))).alias("found"))
    return rows.select("page_ref", written("page_ref", "found", F.transform("found", lambda s: s["annotated"])).alias("document"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """A folder with one text file for each page, by its name."""
    rows = documents.select(F.regexp_replace("page_ref", "[ /]", "_").alias("page"), F.col("document").alias("value"))
    rows.repartition("page").write.mode("overwrite").partitionBy("page").text(path)


def listed(title: str, items: Iterable[str] | None, none: str) -> list[str]:
    return [title, "", *([f"- {x}" for x in items] if items else [none]), ""]


def page_markdown(ref: str, tags: list[str], italics: list[str], other: list[str], annotated: list[str]) -> str:
    """A page's Markdown."""
    lines = [f"# {ref}", "", *listed("## Tags", sorted(tags), "No tags generated."), *listed("## Bolded & Italicized Words", italics, "No bolded and italicized words found.")]
    lines += ["## Hebrew Text", ""] + ([x for s in other for x in (f'<div dir="rtl">{s}</div>', "")] or ["No Hebrew text available.", ""])
    lines += ["## Annotated English Text", ""] + ([x for s in annotated for x in (s, "")] or ["No analyzed text available.", ""])
    return "\n".join(lines)


def sections_markdown(page_ref: str, sections: list[dict]) -> str:
    """Markdown of a page section by section, with the tags and italics of all above. Sections: section_number, tags, italics, other, annotated."""
    every = lambda k: sorted({x for s in sections for x in s[k] or ()})
    lines = [f"# {page_ref} (Section-Aware Analysis)", "", *listed("## Overall Page Tags", every("tags"), "No tags found."), *listed("## Bolded & Italicized Words (All Sections)", every("italics"), "No bolded and italicized words found.")]
    for s in sections:
        n = s["section_number"]
        lines += [f"## Section {n}", "", *listed(f"### Tags (Section {n})", sorted(s["tags"] or ()), "No tags found in this section.")]
        lines += [f"### Hebrew Text (Section {n})", ""] + ([x for t in s["other"] or () for x in (f'<div dir="rtl">{t}</div>', "")] or ["No Hebrew text available.", ""])
        lines += [f"### Annotated English Text (Section {n})", ""] + ([x for t in s["annotated"] or () for x in (t, "")] or ["No analyzed text available for this section.", ""])
        lines += listed(f"### Bolded & Italicized Words (Section {n})", sorted(s["italics"]), "") if s["italics"] else []
        lines += ["---", ""]
    return "\n".join(lines)


def plain_markdown(sections: DataFrame) -> DataFrame:
    """page_ref and document: sections as they are, bold tags dropped, italics as *; no analysis."""
    english = F.regexp_replace(F.regexp_replace("en_text", "</?b>", ""), "</?i>", "*")
    english = F.when(F.col("en_text") == "", "No English text available for this section.").otherwise(english)
    other = F.array_join(F.transform(text.sentences(F.col("he_text")), text.right_to_left), "\n\n")
    other = F.when(other == "", "No Hebrew text available for this section.").otherwise(other)
    n = F.col("section_number").cast("string")
    part = F.concat_ws("\n", F.concat(F.lit("## Section "), n), F.lit(""), F.concat(F.lit("### Hebrew Text (Section "), n, F.lit(")")), F.lit(""), other, F.lit(""), F.concat(F.lit("### English Text (Section "), n, F.lit(")")), F.lit(""), english, F.lit(""), F.lit("---"), F.lit(""))
    parts = sections.select("page_ref", "section_number", part.alias("t"))
    body = tagging.joined_text(parts.withColumn("t", F.concat("t", F.lit("\n"))), "page_ref", "section_number", ["t"])
    return body.select("page_ref", F.concat(F.lit("# "), "page_ref", F.lit(" (Section-Aware Analysis)\n\n"), F.regexp_replace("t", "\n (?=## Section )", "\n")).alias("document"))


def write_index_csv(index: DataFrame, path: str) -> None:
    """An index as one CSV file with header; its rows are pages, few beside the corpus."""
    index.select("location", "keywords", "link").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def concordance_html(entries: DataFrame, base: str = "https://texts.example") -> DataFrame:
    """letter, name, card: each name's entries as HTML, names marked first, then display rewrites."""
    shown = entries.withColumn("body", text.rewrite_display(text.highlight_name("html", "name"))).withColumn("url", text.reader_url(F.col("location"), base))
    place = text.html_escape(F.col("location"))
    item = F.concat(F.lit("<li>"), F.when(F.col("url").isNotNull(), F.concat(F.lit('<a href="'), "url", F.lit('">'), place, F.lit("</a>"))).otherwise(place), F.lit(" "), "body", F.lit("</li>"))
    cards = shown.groupBy("name", "total").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))).alias("items"))
    label = text.count_label(F.col("total"), F.size("items").cast("long"))
    card = F.concat(F.lit("<h3>"), text.html_escape(F.col("name")), F.lit('<span class="match-count">'), label, F.lit("</span></h3><ul>"), F.array_join(F.transform("items", lambda x: x["t"]), ""), F.lit("</ul>"))
    return cards.select(text.letter_bucket(F.col("name")).alias("letter"), "name", card.alias("card"))


def concordance_page(cards: DataFrame, summary: dict, path: str, title: str = "Concordance") -> None:
    """The cards under their letters as one HTML file, written a card at a time."""
    letters = [r.letter for r in cards.select("letter").distinct().orderBy("letter").collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><nav>" + " ".join(f'<a href="#{x}">{x}</a>' for x in letters) + "</nav>\n")
        f.write(f"<p>{summary.get('n_found', 0)} of {summary.get('n_names', 0)} names, {summary.get('n_entries', 0)} entries</p>\n")
        last = None
        for row in cards.orderBy("letter", F.lower("name"), "name").toLocalIterator():
            if row.letter != last:
                f.write(f'<h2 id="{row.letter}">{row.letter}</h2>\n')
                last = row.letter
            f.write(row.card + "\n")
