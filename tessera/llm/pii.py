"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that disclose them.

Corpus counts tell how strongly a term reveals a protected entity (an address, a number). With document
frequencies, the pointwise mutual information of term and entity over the entity's own information content is
``1 + log(n_both / n_term) / log(n_docs / n_entity)``: 1 if every document with the term is about the entity. Terms at or
above ``remove`` are removed, those at or above ``generalise`` are replaced by their word class; both are named as spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, cut, documents, keyed

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: time stays in proportion to the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base matches, in order."""
    out = [(a, 0, z) for a, z in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, found: str) -> str:
    return f"{KINDS[kind]}:{found.lower() if kind == 0 else NOT_DIGIT.sub('.' if kind == 1 else '', found)}"


def outside(spans: list[tuple[int, int, int]]):
    """Whether a match overlaps none of the sorted spans."""
    starts, ends = [a for a, _, _ in spans], list(accumulate((z for _, _, z in spans), max))

    def free(m: re.Match) -> bool:
        k = bisect_left(starts, m.end())
        return not k or ends[k - 1] <= m.start()

    return free


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Distinct terms that stand outside all spans."""
    if not spans:
        return {t.lower() for t in set(TERM.findall(text))}
    free = outside(spans)
    return {m.group().lower() for m in TERM.finditer(text) if free(m)}


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<start: long, kind: long, end: long>>"
FOUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("spans", SPANS), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])
FOUND_SQL = f"id long, th long, spans {SPANS_SQL}, entities array<string>, terms array<string>"


def finding(batches):
    """Base spans, and the distinct entities and terms of texts that have any."""
    for b in batches:
        rows = []
        for i, th, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
            spans = base_spans(text)
            entities = {entity(kind, text[a:z]) for a, kind, z in spans}
            rows.append((i, th, [dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans], list(entities), list(terms_of(text, spans)) if spans else []))
        if rows:
            yield batch(FOUND, *zip(*rows, strict=True))


MARKED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def marking(sieve: bytes):
    """Places of terms that pass the sieve, outside base spans; see sieve_of()."""
    mask = len(sieve) - 1

    def run(batches):
        for b in batches:
            rows = []
            for i, th, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
                strong = {t for t in set(TERM.findall(text)) if sieve[xxhash.xxh64_intdigest(t.lower().encode(), 42) & mask]}
                if strong:
                    free = outside(base_spans(text))
                    rows += [(i, th, m.group().lower(), m.start(), m.end()) for m in TERM.finditer(text) if m.group() in strong and free(m)]
                while len(rows) >= 50_000:
                    yield batch(MARKED, *zip(*rows[:50_000], strict=True))
                    del rows[:50_000]
            if rows:
                yield batch(MARKED, *zip(*rows, strict=True))

    return run


SIEVE = 1 << 23  # the most places of a sieve, a byte each


def sieve_of(terms: DataFrame) -> bytes:
    """A table that is 1 at the hash of each term, and 16 to 32 times as long as there are terms, but SIEVE at most.

    Others that pass are dropped by a join, so a fuller table costs time and loses nothing. The driver gets no more than
    the table's places.
    """
    size = min(SIEVE, 1 << max(10, (16 * terms.count()).bit_length()))
    places = terms.select(F.xxhash64("term").bitwiseAND(F.lit(size - 1)).cast("int").alias("place")).distinct().toArrow()
    table = np.zeros(size, np.uint8)
    table[places.column("place").to_numpy()] = 1
    return table.tobytes()


def counting(batches):
    """Document frequencies of terms, summed before they are sent."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    counts: Counter = Counter()

    def send():
        pairs = list(counts.items())
        for at in range(0, len(pairs), 50_000):
            yield batch(schema, *zip(*pairs[at : at + 50_000], strict=True))

    for b in batches:
        for text in b.column("text").to_pylist():
            counts.update(terms_of(text, base_spans(text)))
            if len(counts) > 500_000:
                yield from send()
                counts.clear()
    yield from send()


def disclosing_terms(found: DataFrame, texts: DataFrame, threshold: float, documents_least: int) -> DataFrame:
    """entity, term and disclosure of the pairs at or above the threshold, all counted over whole documents, each once.

    A pair is met no more often than its entity, so a term more frequent than that allows at the threshold is dropped
    before pairs are made.
    """
    n_docs = float(max(texts.count(), 2))
    own = found.where(F.size("entities") > 0).dropDuplicates(["id", "th"])
    held = own.select("id", "th", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= documents_least)
    met = own.select("id", "th", F.explode("terms").alias("term"))
    terms = texts.select("text").mapInArrow(counting, "term string, n long").join(met.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= documents_least)
    pair = held.join(entities, "entity").join(met.join(terms, "term"), ["id", "th"])
    pair = pair.where(F.col("n_term") <= F.col("n_entity") * F.pow(n_docs / F.col("n_entity"), F.lit(1 - threshold)) * (1 + 1e-9))
    both = pair.groupBy("entity", "n_entity", "term", "n_term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= documents_least)
    content = F.log(F.lit(n_docs) / F.col("n_entity"))
    disclosure = F.when(content <= 0, F.lit(0.0)).otherwise(1 + F.log(F.col("n_both") / F.greatest("n_both", "n_term")) / content)
    return both.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= threshold)


def personal_data(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, documents_least: int = 2) -> DataFrame:
    """id, th, spans (base: start, kind, end) and terms (start, end, disclosure) of each row; see keyed() for id and th.

    A term (a word of four letters or more) that stands with an entity in ``documents_least`` documents or more, and
    whose disclosure of it is ``generalise`` or more, is named wherever it stands outside base spans, in documents
    without such too, with its highest disclosure. Null text is empty and has no spans. Rows that repeat a document
    (doc_id and text) count as one and each get its result; null doc_ids with one text are one document. An empty
    table gives none. Other columns, whatever their names, are ignored.
    """
    texts = keyed(docs)
    found = cut(texts.mapInArrow(finding, FOUND_SQL))
    repeated = found.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    once = texts if repeated.isEmpty() else texts.dropDuplicates(["id", "th"])  # texts are shuffled only if some row is there twice
    strong = cut(disclosing_terms(found, once, generalise, documents_least).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    marked = texts.mapInArrow(marking(sieve_of(strong)), "id long, th long, term string, start long, end long")
    terms = marked.join(strong, "term").groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    return found.select("id", "th", "spans").join(terms, ["id", "th"], "left").select("id", "th", "spans", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, remove: float = 0.95, **options) -> DataFrame:
    """docs with text rewritten: base spans become [KIND], terms [REMOVED] or, below ``remove``, [WORD] or [NAME] (capitalised).

    All other columns are kept; null text stays null. Rows that repeat a document are each rewritten alike.
    """
    found = personal_data(docs, remove=remove, **options).distinct()
    found = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"), F.col("terms").alias("__terms"))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, base, more in zip(texts, spans, terms, strict=True):
            marks = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
            marks += [(t["start"], t["end"], "[REMOVED]" if t["disclosure"] >= remove else "[NAME]" if text[t["start"]].isupper() else "[WORD]") for t in more]
            parts, last = [], 0
            for a, z, mark in sorted(marks):
                if a >= last:
                    parts += [text[last:a], mark]
                last = max(last, z)
            out.append("".join([*parts, text[last:]]))
        return pd.Series(out, dtype=object)

    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    new = F.when(F.col("text").isNotNull(), rewritten(F.coalesce("text", F.lit("")), "__spans", "__terms"))
    return docs.join(found, on, "left").withColumn("__new", new).select(*(F.col("__new").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def digesting(batches):
    names = [*KINDS, "term"]
    for b in batches:
        rows = []
        for i, base, more in zip(b.column("id").to_pylist(), b.column("spans").to_pylist(), b.column("terms").to_pylist(), strict=True):
            own = sorted((s["start"], s["kind"], s["end"]) for s in base)
            all_ = sorted(own + [(t["start"], len(KINDS), t["end"]) for t in more])
            text = [",".join(f"{names[k]}:{a}:{z}" for a, k, z in x) for x in (own, all_)]
            rows.append((None if i == NULL_ID else i, *(sum(k == x[1] for x in own) for k in range(len(KINDS))), hashlib.sha256(text[0].encode()).hexdigest(), text[1]))
        if rows:
            yield batch(DIGEST, *zip(*rows, strict=True))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).mapInArrow(digesting, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
