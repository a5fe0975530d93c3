"""Benchmark decontamination by winnowing.

Of every ``guard`` consecutive word ``GRAM``-grams the one with the smallest hash is a fingerprint, so any span of
``window`` words that a document shares with an item holds a fingerprint common to both. Items shorter than a window are
one window each, with their own, shorter grams.

1. The items' fingerprints are written to a sieve, a bit table of bounded size, which goes to all tasks.
2. Documents are read once: a fingerprint that passes the sieve is extended to the windows that hold it. These alone are
   sent on, each as two 64-bit hashes of its words' hashes.
3. Windows of documents and items are joined. Windows that belong to the same items share a class, so a document is
   joined with the items of its few classes, not of its many windows.

All three run on the executors; the driver sees nothing but the sieve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, byte_lists, cut, documents, keyed, long_array

GRAM = 5
PLACE = np.uint64(30)  # bits for a word's place; texts of 2 GB hold fewer words
#: Bytes that part words; A-Z become lower case.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TABLE = bytes(0x20 if c in SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def word_hashes(text: bytes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hash(ids: np.ndarray, size: int, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A hash of ``size`` words from each place."""
    n = max(0, len(ids) - size + 1)
    out = np.full(n, seed)
    for k in range(size):
        out = (out ^ ids[k : k + n]) * C1
        out ^= out >> np.uint64(29)
    return out * C2


def winnowed(h: np.ndarray, guard: int) -> np.ndarray:
    """Places of the smallest hash (leftmost where the leading bits agree) in each run of ``guard`` hashes."""
    if len(h) < guard:
        return np.empty(0, np.int64)
    key, have = h >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64), 1
    while have < guard:
        step = min(have, guard - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    place = (key & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    return place[np.append(True, place[1:] != place[:-1])]


def prints(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of ``size`` words, and their places; those of other sizes are other ones."""
    gram = min(GRAM, size)
    h = gram_hash(ids, gram)
    places = winnowed(h, size - gram + 1)
    return (h[places] ^ np.uint64(size)) * C3, places


WINDOWS = pa.schema([("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("item", pa.string()), ("nameless", pa.bool_()), ("prints", pa.binary())])


def item_windows(window: int):
    """A row for each distinct window of an item; an item's fingerprints stand beside its first window."""

    def sent(held: list) -> pa.RecordBatch:
        sizes, pairs, names, nameless, own = zip(*held, strict=True)
        many = np.array([len(x) for x in pairs])
        first = np.cumsum(many) - many
        prints_of = np.full(int(many.sum()), None, object)
        prints_of[first] = own
        both = np.concatenate(pairs).view(np.int64)
        return batch(WINDOWS, np.repeat(sizes, many), both[:, 0], both[:, 1], np.repeat(np.array(names, object), many), np.repeat(nameless, many), prints_of)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for item, nameless, text in zip(b.column("item").to_pylist(), b.column("nameless").to_pylist(), byte_lists(b.column("text")), strict=True):
                ids = word_hashes(text)
                if size := min(window, len(ids)):
                    pairs = np.unique(np.stack([gram_hash(ids, size), gram_hash(ids, size, C3)], axis=1), axis=0)
                    held.append((size, pairs, item, nameless, np.unique(prints(ids, size)[0]).tobytes()))
                    n += len(pairs)
                if n > 20_000:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    return run


def sieve_of(windows: DataFrame, most_bytes: int) -> bytes:
    """A bit table with the items' fingerprints, about 32 times as many bits as those but ``most_bytes`` at most; a fuller one lets more pass, which the join drops."""
    total = windows.agg(F.sum(F.octet_length("prints"))).first()[0] or 0
    table = np.zeros(1 << max(3, min((4 * total // 8).bit_length(), most_bytes.bit_length() - 1)), np.uint8)
    mask = np.uint64(8 * len(table) - 1)
    for row in windows.where("prints is not null").select("prints").toLocalIterator(prefetchPartitions=True):
        bit = np.frombuffer(row[0], "<u8") & mask
        np.bitwise_or.at(table, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    return table.tobytes()


FOUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("start", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))])


def candidates(ids: np.ndarray, sizes: list[int], table: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Start, size and hashes of the windows that hold a fingerprint which passes the sieve."""
    out, mask = [], np.uint64(8 * len(table) - 1)
    for size in sizes:
        if len(ids) < size:
            continue
        found, places = prints(ids, size)
        bit = found & mask
        places = places[(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        if not len(places):
            continue
        near = np.zeros(len(ids) - size + 2, np.int64)  # window starts whose window holds the fingerprint
        np.add.at(near, np.maximum(0, places - (size - min(GRAM, size))), 1)
        np.add.at(near, np.minimum(len(near) - 1, places + 1), -1)
        start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        rows = np.lib.stride_tricks.sliding_window_view(ids, size)[start]
        out.append((start, np.full(len(start), size), *(gram_rows(rows, seed).view(np.int64) for seed in (np.uint64(0), C3))))
    return out


def gram_rows(rows: np.ndarray, seed: np.uint64) -> np.ndarray:
    """gram_hash() of whole rows."""
    out = np.full(len(rows), seed)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * C1
        out ^= out >> np.uint64(29)
    return out * C2


def searching(sizes: list[int], sieve):
    def run(batches) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sieve.value, np.uint8)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part, rows = b.slice(at, 1_000), []
                for i, th, text in zip(long_array(part.column("id")), long_array(part.column("th")), byte_lists(part.column("text")), strict=True):
                    ids = word_hashes(text)
                    found = candidates(ids, sizes, table)
                    rows.append((i, th, len(ids), *([np.concatenate(x) for x in zip(*found, strict=True)] if found else [()] * 4)))
                yield batch(FOUND, *zip(*rows, strict=True))

    return run


HITS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.int64()))])


def merging(batches) -> Iterator[pa.RecordBatch]:
    """Number of words in a document's windows, and the spans that these make."""
    for b in batches:
        rows = []
        for i, th, places in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("places").to_pylist(), strict=True):
            spans: list[int] = []
            for a, z in sorted((p["start"], p["start"] + p["size"]) for p in places):
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], z)
                else:
                    spans += [a, z]
            rows.append((i, th, sum(spans[1::2]) - sum(spans[::2]), spans))
        if rows:
            yield batch(HITS, *zip(*rows, strict=True))


def search_items(docs: DataFrame, items: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, th (see keyed()) and n_words of each row; n_hit and hits of each document with a window of an item; item names of each, by class."""
    spark = docs.sparkSession
    named = items.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("item_id").isNull().alias("nameless"), "text")
    schema = "size int, h1 long, h2 long, item string, nameless boolean, prints binary"
    windows = cut(named.mapInArrow(item_windows(window), schema))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # window numbers at most
    sieve = spark.sparkContext.broadcast(sieve_of(windows, block_bytes))
    found = cut(keyed(docs).mapInArrow(searching(sizes, sieve), "id long, th long, n_words long, start array<int>, size array<int>, h1 array<long>, h2 array<long>"))
    key, kind = ["size", "h1", "h2"], ["c1", "c2", "n"]
    own = windows.select(*key, "item", "nameless").distinct()
    mark = lambda seed: F.bit_xor(F.xxhash64("item", "nameless", F.lit(seed)))  # noqa: E731  of a set, whatever its order
    classes = cut(own.groupBy(*key).agg(mark(1).alias("c1"), mark(2).alias("c2"), F.count("*").alias("n")))
    places = found.where(F.size("start") > 0).select("id", "th", F.explode(F.arrays_zip("start", *key)).alias("w")).select("id", "th", "w.*")
    met = cut(places.join(classes, key).select("id", "th", "start", "size", *kind))
    hits = met.groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("places")).mapInArrow(merging, "id long, th long, n_hit long, hits array<long>")
    members = own.join(classes, key).select(*kind, "item", "nameless").distinct()
    names = met.select("id", "th", *kind).distinct().join(members, kind).groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("item", "nameless"))).alias("names"))
    return found.select("id", "th", "n_words"), hits, names


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted) and hits (starts and ends in turn) of each row of docs.

    A document word is hit inside any occurrence of ``window`` consecutive item words (of the whole item, if that is
    shorter but not empty). contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words, null
    item text is no item, items without an item_id are one item, named "null"; items that repeat an id count once, with
    all their texts. Rows of docs that repeat a document each get its result, those without doc_id too. Without items
    nothing is hit, without docs there are no rows. Other columns, whatever their names, are ignored. Words and windows
    are compared by hashes, windows by two of 64 bits. ``block_bytes`` bounds the sieve that is broadcast, not the result.
    """
    rows, hits, names = search_items(docs, items, window, block_bytes)
    done = rows.join(hits, ["id", "th"], "left").join(names, ["id", "th"], "left")
    found = F.coalesce(F.transform("names", lambda x: x["item"]), F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    done = done.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_words", n_hit.alias("n_hit"), found.alias("items"), F.coalesce("hits", F.expr("cast(array() as array<bigint>)")).alias("hits"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "items", "hits")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, block_bytes: int = 32 << 20) -> DataFrame:
    """docs without contaminated documents (see decontaminate()); all columns and clean rows stay as they are.

    Documents of null or empty text are clean. Rows that repeat a document stay or go together.
    """
    rows, hits, _ = search_items(docs, items, window, block_bytes)
    bad = rows.join(hits, ["id", "th"]).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    return docs.join(bad, on, "left_anti")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items", "hits")


#: Every window as its words; a document word is hit where a window of the same words stands over it.
SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark where text is not null),
sizes as (select distinct least(13, len(ws)) as size from i where len(ws) > 0),
iw as (
  select distinct item_id, size, array_to_string(ws[p : p + size - 1], ' ') as win
  from (select item_id, ws, least(13, len(ws)) as size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as p from i where len(ws) > 0)),
dw as (
  select doc_id, p, size, array_to_string(ws[p : p + size - 1], ' ') as win
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as p from w, sizes where len(ws) >= size)),
m as (select dw.doc_id, dw.p, dw.size, iw.item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from (select distinct doc_id, p, size from m)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""
