"""Annotators of texts, pooled embeddings, and annotation of sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

ANALYSIS = (
    "entities array<struct<text: string, label: string, start_char: int, end_char: int>>, noun_phrases array<string>, "
    "sentences array<struct<text: string, start_char: int, end_char: int>>"
)
NAME = re.compile(r"\b[A-ZÀ-ÞḀ-Ỿ][\w'’-]+(?:\s+(?:ben|bar|bat|of)\s+[A-ZÀ-Þ][\w'’-]+|\s+[A-ZÀ-Þ][\w'’-]+)*")
SENTENCE = re.compile(r"\S[^.!?]*[.!?]*")
PHRASE = re.compile(r"(?:the|a|an|his|her|their|this)\s+(?:\w+\s+){0,2}\w+", re.I)


#: The same in Arrow's types, and the bytes of texts whose annotation is held as Python objects at once.
SPAN = {"start_char": pa.int32(), "end_char": pa.int32()}
ANALYSED = {"entities": pa.list_(pa.struct({"text": pa.string(), "label": pa.string()} | SPAN)), "noun_phrases": pa.list_(pa.string()), "sentences": pa.list_(pa.struct({"text": pa.string()} | SPAN))}
MOST_BYTES = 1 << 20


def runs(rows: pa.RecordBatch | pa.StructArray, texts: pa.Array) -> Iterable:
    """Slices of rows with about MOST_BYTES of texts, one row at least: annotations take many times a text's bytes as Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_BYTES, "right")))
        yield rows.slice(at, to - at)
        at = to


def simple_annotator(text: str) -> dict:
    """Rules in place of a language model: sentences by marks, names by capitals within sentences, noun phrases by articles. It claims no model's quality."""
    sentences = [(m.group(), m.start(), m.end()) for m in SENTENCE.finditer(text)]
    starts = {s for _, s, _ in sentences}
    names = [{"text": m.group(), "label": "PERSON", "start_char": m.start(), "end_char": m.end()} for m in NAME.finditer(text) if m.start() not in starts or " " in m.group()]
    return {"entities": names, "noun_phrases": [m.group() for m in PHRASE.finditer(text)], "sentences": [dict(zip(("text", "start_char", "end_char"), s, strict=True)) for s in sentences]}


def annotate(docs: DataFrame, make: Callable[[], Callable[[str], dict]] = lambda: simple_annotator, column: str = "text") -> DataFrame:
    """docs with an annotator's entities, noun_phrases and sentences. make is called once a task, so that a model is loaded once."""
    keep = [c for c in docs.columns if c not in ("entities", "noun_phrases", "sentences")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep) + ", " + ANALYSIS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        annotator = make()
        for b in batches:
            for rows in runs(b, b.column(column)):
                found = [annotator(t or "") for t in rows.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([x[k] for x in found], t) for k, t in ANALYSED.items())], names=[*rows.schema.names, *ANALYSED])

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors of one length, place by place; no vectors: null."""
    first = F.transform(vectors[0], lambda _: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def hashed_embedding(width: int = 64, most: int = 512):
    """A stand-in for a model's text embedding: token vectors by hash, the first ``most`` tokens, mean-pooled."""

    def tokens(x: Column) -> Column:
        return F.slice(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, most)

    def vector(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.xxhash64(t, k), F.lit(2001)) / 1000.0 - 1.0)

    return lambda x: mean_pool(F.transform(tokens(x), vector))


def shown_label(entity: str, label: str, lookup: dict[str, str]) -> str | None:
    """What an entity is called; None: it isn't shown."""
    key = entity.lower().strip(".:, ")
    if label == "PERSON" and key not in values.DIVINE_NAMES and key in values.NON_PERSONS:
        return None
    if key in lookup:
        return lookup[key]
    if label == "PERSON" and key in values.DIVINE_NAMES:
        return f"concept:divine_name_{key}"
    return None if label in values.HIDDEN_LABELS else label


def annotate_sentence(sentence: str, entities: list[tuple[int, int, str, str]], lookup: dict[str, str], terms: list[tuple[int, str, str]] = (), compat: bool = False, escape: bool = True) -> str:
    """The sentence with **text**`[label]` for each span.

    entities: (start, end, text, label) in the sentence; lookup: key to label. terms: (rank, term, label) of phrases
    with a blank, each marked once where it first stands, later ends first. All spans keep their places in the
    original sentence; of equal ends the longer, then the lower rank wins. compat: an entity is marked only if its
    text still stands at its place in the half-marked sentence, as places shift with marks to the left.
    """
    marks, covered, out = [], [], sentence
    escaped = lambda t: re.sub(values.MARKDOWN_MARKS, r"\\\1", t) if escape else t
    free = lambda a, z: all(z <= s or e <= a for s, e in covered)
    found = []
    for rank, term, label in terms:
        if " " in term and (m := re.search(r"(?<!\w)" + re.escape(term) + r"(?!\w)", sentence, re.I)):
            found.append((-m.end(), m.start(), rank, term, label))
    for end, start, _, term, label in sorted(found):
        if free(start, -end):
            covered.append((start, -end))
            marks.append((start, -end, f"**{escaped(term)}**`[{label}]`"))
    if compat:
        for a, z, mark in marks:
            out = out[:a] + mark + out[z:]
    for start, end, entity, label in sorted(entities, key=lambda e: (-e[1], e[0])):
        if not free(start, end) or (out if compat else sentence)[start:end] != entity or (name := shown_label(entity, label, lookup)) is None:
            continue
        mark = f"**{escaped(entity)}**`[{name}]`"
        if compat:
            out = out[:start] + mark + out[end:]
        else:
            covered.append((start, end))
            marks.append((start, end, mark))
    if not compat:
        for a, z, mark in sorted(marks, reverse=True):
            out = out[:a] + mark + out[z:]
    return out


def annotate_sentences(compat: bool = False, escape: bool = True):
    """A function of (text, entities, sentences, lookup, terms) columns that gives a document's annotated sentences. lookup: map of key to label; terms: array of struct rank, term, label."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, entities: pa.Array, sentences: pa.Array, lookups: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for rows in runs(pa.RecordBatch.from_arrays([texts, entities, sentences, lookups, terms], names=list("abcde")), texts):
            done = []
            for doc, ents, sents, lookup, phrases in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                lookup, phrases = dict(lookup or ()), [(p["rank"], p["term"], p["label"]) for p in phrases or ()]
                done.append([annotate_sentence(doc[s["start_char"] : s["end_char"]], within(ents or (), s["start_char"], s["end_char"]), lookup, phrases, compat, escape) for s in sents or ()])
            out.append(pa.array(done, pa.list_(pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    def within(ents, a: int, z: int) -> list[tuple[int, int, str, str]]:
        return [(e["start_char"] - a, e["end_char"] - a, e["text"], e["label"]) for e in ents if e["start_char"] >= a and e["end_char"] <= z]

    def columns(texts, entities, sentences, lookups, terms) -> Column:
        spans = F.transform(sentences, lambda s: F.struct(s["start_char"].alias("start_char"), s["end_char"].alias("end_char")))  # their texts are the document's
        return run(texts, entities, spans, lookups, terms)

    return columns
