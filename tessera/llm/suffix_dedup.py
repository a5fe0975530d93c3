"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

A suffix array over every byte would move at least 8 bytes a suffix, many times the input. Here only *anchored*
suffixes are sorted: in each window of ``length`` bytes the ``LEAD``-byte string with the smallest hash is the
window's anchor (leftmost of equals). An anchor depends on the window's bytes alone, so equal windows hang on
suffixes that start with the same ``LEAD`` bytes at the same offset, and nothing is missed.

1. Suffixes are range-partitioned by their leading tokens with sampled splitters. The first token is 8 bytes,
   big-endian; the second stands for the other ``LEAD - 8`` (a hash: only its equality counts, and what it may merge by
   chance is told apart later by the bytes). Splitters compare both, so suffixes that agree never lie on two sides.
2. Each bucket is sorted by multikey quicksort, token by token, only ties going on to the next token. Among
   suffixes with one lead, those whose whole span of windows is equal (hash of the span, its place and length)
   are settled: all but the first are removed. Each task settles its own repeats before it shuffles, so a passage
   with very many copies sends one suffix a task.
3. Only leads whose suffixes differ further on need their text: those go on to the second sort, which compares
   window by window, with the bytes themselves checked. A lead with more than ``HOT`` kinds of suffixes would put all
   of them in one task: its windows are dealt singly, by 128 bits of hash, and each task settles its own repeats
   before it sends them, so a window with very many copies sends one a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, byte_lists, cut, documents, keyed, long_array, release, shuffle_partitions

LEAD = 32
TOKENS = LEAD // 8
PIECE = 1 << 19  # window starts handled at once; below 2 ** 20, see anchors()
FLUSH = 1_000_000  # suffixes that a task gathers before it sends them
HOT = 1_000  # kinds of suffixes of one lead above which its windows are dealt singly
KEY = np.dtype("S12")  # a suffix's leading tokens as bytes
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SUFFIX = np.dtype([("lead", "<u8"), ("rest", "<u4"), ("span", "<u8"), ("doc", "<u4"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
MARKS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("kind", pa.int32()), ("lead", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
AROUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("kind", pa.int32()), ("lead", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary())])
SPANS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return x ^ (x >> np.uint64(29))


def eights(buf: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes at each place."""
    return mixed(np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)) + M3)


def grams(eight: np.ndarray) -> np.ndarray:
    """A hash of the LEAD bytes at each place."""
    n = len(eight) - LEAD + 8
    out = eight[:n] * M2
    for k in range(1, TOKENS):
        out += eight[8 * k : 8 * k + n] * np.uint64((2 * k + 1) * 0x9FB21C651E98DF25 % 2**64 | 1)
    out ^= out >> np.uint64(31)
    out *= M1
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(gram: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows in the pieces behind gram: their place, and the first and last window that hangs on them."""
    key = gram & ~np.uint64((1 << 20) - 1) | np.arange(len(gram), dtype=np.uint64)
    at = (sliding_min(key, length - LEAD + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    change = np.zeros(len(at) + 1, np.int32)
    many = sizes >= length
    np.add.at(change, starts[many], 1)
    np.add.at(change, starts[many] + sizes[many] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[starts[many]] = True
    first = np.flatnonzero(new)
    ends = valid & np.append(new[1:] | ~valid[1:], True)
    return at[first], first, np.flatnonzero(ends)


def span_hash(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, 8 at a time; the same bytes agree wherever they stand."""
    out, n = np.zeros(len(start), np.uint64), (end - start) // 8
    for k in range(int(n.max(initial=0))):
        if k < n.min():
            out = mixed(out * M2 + eight[start + 8 * k])
        else:
            go = np.flatnonzero(k < n)
            out[go] = mixed(out[go] * M2 + eight[start[go] + 8 * k])
    return mixed(out * M2 + eight[end - 8] + (end - start).astype(np.uint64))


def sorted_by_tokens(*tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order by the first token; runs of equals alone are ordered by the next, and so on. Also the run of each."""
    order, run = np.arange(len(tokens[0])), np.zeros(len(tokens[0]), np.int64)
    tied = order
    for token in tokens:
        own = order[tied]
        order[tied] = own[np.lexsort((token[own], run[tied]))] if run[tied[-1:]].any() else own[np.argsort(token[own], kind="stable")]
        value = token[order]
        run = np.cumsum(np.append(False, (value[1:] != value[:-1]) | (run[1:] != run[:-1])))
        tied = np.flatnonzero((np.bincount(run) > 1)[run])
        if not len(tied):
            break
    return order, run


def settle(s: np.ndarray, ids: np.ndarray, ths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes: which are repeats of an earlier one with the same windows, and which must still be compared (1; of a hot lead, 2)."""
    repeat, open_ = np.zeros(len(s), bool), np.zeros(len(s), np.int8)
    if not len(s):
        return repeat, open_
    order, run = sorted_by_tokens(s["lead"], s["rest"])
    many = (np.bincount(run) > 1)[run]
    order, run = order[many], run[many]
    if not len(order):
        return repeat, open_
    x = s[order]
    fine = np.lexsort((x["pos"], ths[x["doc"]], ids[x["doc"]], x["hi"], x["lo"], x["span"], run))
    order, run, x = order[fine], run[fine], x[fine]
    new = np.append(True, (run[1:] != run[:-1]) | (x["span"][1:] != x["span"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    doc, top = x["doc"], x["doc"][head]
    repeat[order] = (ids[doc] != ids[top]) | (ths[doc] != ths[top]) | (x["pos"] != x["pos"][head])
    kinds = np.bincount(run, weights=new, minlength=run[-1] + 1)
    open_[order] = new * (kinds[run] > 1) * np.where(kinds[run] > HOT, 2, 1)
    return repeat, open_


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts, cut where they are very long (windows on the cut fall into either part), in lots of bounded size."""
    lot, held = [], 0
    for d, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            if lot and held + len(piece) > PIECE + length:
                yield lot
                lot, held = [], 0
            lot.append((d, at, piece))
            held += len(piece)
    if lot:
        yield lot


def suffixes(texts: list[bytes], length: int) -> np.ndarray:
    out = []
    for lot in pieces(texts, length):
        raw = b"".join(p for _, _, p in lot)
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in lot])
        starts = np.cumsum(sizes) - sizes
        eight = eights(buf)
        gram = grams(eight)
        at, first, last = anchors(gram, starts, sizes, length)
        of = np.searchsorted(starts, first, side="right") - 1
        s = np.empty(len(at), SUFFIX)
        s["lead"] = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))[at]
        s["rest"] = gram[at] >> np.uint64(32)
        s["span"] = span_hash(eight, first, last + length)
        s["doc"] = np.array([d for d, _, _ in lot], np.uint32)[of]
        s["pos"] = at - starts[of] + np.array([a for _, a, _ in lot])[of]
        s["lo"], s["hi"] = at - last, at - first
        out.append(s)
    return np.concatenate(out) if out else np.empty(0, SUFFIX)


def marks(s: np.ndarray, ids: np.ndarray, ths: np.ndarray, kind: int) -> tuple:
    lead = mixed(s["lead"] * M2 + s["rest"]).view(np.int64)
    return ids[s["doc"]], ths[s["doc"]], np.full(len(s), kind), lead, s["pos"].astype(np.int64), s["lo"].astype(np.int32), s["hi"].astype(np.int32)


def packed(s: np.ndarray, ids: np.ndarray, ths: np.ndarray) -> bytes:
    """Suffixes column by column, with their own short list of documents."""
    used, doc = np.unique(s["doc"], return_inverse=True)
    head = np.array([len(s), len(used)], "<u8").tobytes()
    columns = (s["lead"], s["rest"], s["span"], doc.astype("<u2" if len(used) <= 1 << 16 else "<u4"), s["pos"], s["lo"], s["hi"])
    return b"".join([head, ids[used].tobytes(), ths[used].tobytes(), *(np.ascontiguousarray(x).tobytes() for x in columns)])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    at, out = 16 + 16 * d, np.empty(n, SUFFIX)
    for name in SUFFIX.names:
        kind = SUFFIX[name] if name != "doc" else np.dtype("<u2" if d <= 1 << 16 else "<u4")
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out, np.frombuffer(blob, "<i8", d, 16), np.frombuffer(blob, "<i8", d, 16 + 8 * d)


def keys(s: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), [("lead", ">u8"), ("rest", ">u4")])
    out["lead"], out["rest"] = s["lead"], s["rest"]
    return out.view(KEY)


def sending(length: int, splitters: bytes):
    cuts = np.frombuffer(splitters, KEY)
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def send(held: list) -> Iterator[pa.RecordBatch]:
        ids, ths = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        shift = np.cumsum([0, *(len(x[1]) for x in held)])
        s = np.concatenate([x[0] for x in held])
        s["doc"] += np.repeat(shift[:-1], [len(x[0]) for x in held]).astype(np.uint32)
        repeat, _ = settle(s, ids, ths)
        done, s = s[repeat], s[~repeat]
        s = s[np.argsort(s["lead"], kind="stable")]
        where, rows = np.searchsorted(cuts, keys(s), side="right"), []
        order = np.argsort(where, kind="stable")
        s, where = s[order], where[order]
        edges = np.searchsorted(where, np.arange(len(cuts) + 2))
        rows += [(k, 1, packed(s[a:b], ids, ths)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        n = max(1, len(cuts) + 1)
        own = (done["doc"] * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(n)
        rows += [(int(k), 0, packed(done[own == k], ids, ths)) for k in np.unique(own)]
        yield batch(schema, *zip(*rows, strict=True))

    def run(batches):
        held, n = [], 0
        for b in batches:
            texts, ids, ths = byte_lists(b.column("text")), long_array(b.column("id")), long_array(b.column("th"))
            for at in range(0, len(texts), 512):
                s = suffixes(texts[at : at + 512], length)
                held.append((s, ids[at : at + 512], ths[at : at + 512]))
                n += len(s)
                if n >= FLUSH:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def sorting(batches):
    """A bucket: all its suffixes are sorted; repeats are settled, those to be compared further are named."""
    held = []
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            s, ids, ths = unpacked(blob)
            if kind == 0:
                yield batch(MARKS, *marks(s, ids, ths, 0))
            else:
                held.append((s, ids, ths))
    if held:
        ids, ths = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        shift = np.cumsum([0, *(len(x[1]) for x in held)])
        s = np.concatenate([x[0] for x in held])
        s["doc"] += np.repeat(shift[:-1], [len(x[0]) for x in held]).astype(np.uint32)
        held.clear()
        repeat, open_ = settle(s, ids, ths)
        for kind, which in ((0, repeat), (1, open_ == 1), (2, open_ == 2)):
            for at in range(0, int(which.sum()), 100_000):
                yield batch(MARKS, *marks(s[np.flatnonzero(which)[at : at + 100_000]], ids, ths, kind))


def contexts(length: int):
    """Around each suffix that must be compared further: the bytes of all windows that hang on it, left part padded.

    Kind 1: those bytes. Kind 2, of a hot lead: one window (lo = hi), named by 128 bits of hash (lead and context). Kind
    0: windows of a hot lead, lo to hi, that are repeats of others in this task.
    """

    def single(hot: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen, rows = set(), []
        for i, th, pos, lo, hi, context in sorted(set(hot)):
            first = None  # of the offsets in a row that are repeats
            for off in range(lo, hi + 2):
                digest = xxhash.xxh3_128_digest(context[hi - off : hi - off + length]) if off <= hi else None
                if digest in seen:
                    first = off if first is None else first
                    continue
                if first is not None:
                    rows.append((i, th, 0, xxhash.xxh64_intdigest(b"%d %d" % (i, pos)) - 2**63, pos, first, off - 1, b""))
                    first = None
                if digest:
                    seen.add(digest)
                    rows.append((i, th, 2, int.from_bytes(digest[:8], "little", signed=True), pos, off, off, digest[8:]))
        for at in range(0, len(rows), 50_000):
            yield batch(AROUND, *zip(*rows[at : at + 50_000], strict=True))

    def run(batches):
        hot = []
        for b in batches:
            rows = []
            for i, th, text, open_ in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), byte_lists(b.column("text")), b.column("open").to_pylist(), strict=True):
                for kind, lead, pos, lo, hi in {(m["kind"], m["lead"], m["pos"], m["lo"], m["hi"]) for m in open_}:
                    context = text[pos - hi : pos - lo + length]
                    if kind == 2:
                        hot.append((i, th, pos, lo, hi, context))
                    else:
                        rows.append((i, th, kind, lead, pos, lo, hi, context))
                if len(rows) > 20_000:
                    yield batch(AROUND, *zip(*rows, strict=True))
                    rows = []
                if len(hot) > 5_000:
                    yield from single(hot)
                    hot = []
            if rows:
                yield batch(AROUND, *zip(*rows, strict=True))
        if hot:
            yield from single(hot)

    return run


def settled(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Of windows dealt singly: those known as repeats, and all but the first of each hash."""
    ids, ths, kind, lead, pos, lo, hi = (t.column(c).to_numpy() for c in ("id", "th", "kind", "lead", "pos", "lo", "hi"))
    check = np.array([int.from_bytes(x, "little") for x in t.column("context").to_pylist()], np.uint64)
    order = np.lexsort((pos, ths, ids, check, lead, kind))
    same = (kind[order][1:] == 2) & (kind[order][:-1] == 2) & (lead[order][1:] == lead[order][:-1]) & (check[order][1:] == check[order][:-1])
    head = order[np.flatnonzero(np.append(True, ~same))[np.cumsum(np.append(True, ~same)) - 1]]
    other = (ids[order] != ids[head]) | (ths[order] != ths[head]) | (pos[order] != pos[head])
    go = order[(kind[order] == 0) | other]
    for at in range(0, len(go), 100_000):
        w = go[at : at + 100_000]
        yield batch(SPANS, ids[w], ths[w], pos[w] - hi[w], pos[w] - lo[w] + length)


def comparing(length: int):
    """All suffixes of some leads: windows at one offset from the same lead are sorted by their bytes; all but the first are repeats."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        del tables
        bytewise = pc.equal(t.column("kind"), 1)
        if len(alone := t.filter(pc.invert(bytewise))):
            yield from settled(alone, length)
        t = t.filter(bytewise).combine_chunks()
        if not len(t):
            return
        ids, ths, lead, pos, lo, hi = (t.column(c).to_numpy() for c in ("id", "th", "lead", "pos", "lo", "hi"))
        order = np.lexsort((pos, ths, ids, lead))
        data = t.column("context").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        flat, offsets = np.frombuffer(data.buffers()[2], np.uint8), np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        eight = eights(flat)
        ids, ths, lead, pos, lo, hi, begin = (x[order] for x in (ids, ths, lead, pos, lo, hi, offsets[:-1]))
        removed = np.zeros((len(ids), length - LEAD + 1), bool)
        for off in range(int(lo.min()), int(hi.max()) + 1):
            rows = np.flatnonzero((lo <= off) & (off <= hi))
            for part in blocks(lead[rows]):
                go = rows[part]
                start = begin[go] + hi[go] - off
                h = span_hash(eight, start, start + length)
                by = np.lexsort((np.arange(len(go)), h, lead[go]))
                new = np.append(True, (h[by][1:] != h[by][:-1]) | (lead[go][by][1:] != lead[go][by][:-1]))
                head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
                for at in range(0, len(by), 200_000):
                    a, z = by[at : at + 200_000], head[at : at + 200_000]
                    other = (ids[go[a]] != ids[go[z]]) | (ths[go[a]] != ths[go[z]]) | (pos[go[a]] != pos[go[z]])
                    a, z = a[other], z[other]
                    if len(a):
                        span = np.arange(length)
                        equal = (flat[start[a][:, None] + span] == flat[start[z][:, None] + span]).all(axis=1)
                        removed[go[a[equal]], off] = True
        edge = np.diff(np.pad(removed.astype(np.int8), ((0, 0), (1, 1))), axis=1)  # runs of offsets make one span
        which, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        for at in range(0, len(which), 100_000):
            w = which[at : at + 100_000]
            yield batch(SPANS, ids[w], ths[w], pos[w] - last[at : at + 100_000], pos[w] - first[at : at + 100_000] + length)

    return run


def blocks(lead: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of sorted leads of about ``most`` rows that never part equal leads."""
    at = 0
    while at < len(lead):
        end = min(len(lead), at + most)
        end = int(np.searchsorted(lead, lead[end - 1], side="right"))
        yield slice(at, end)
        at = end


def removing(keep_text: bool):
    def run(batches):
        for b in batches:
            rows = []
            for doc, text, spans in zip(long_array(b.column("id")), byte_lists(b.column("text")), b.column("spans").to_pylist(), strict=True):
                merged, kept, last = [], [], 0
                for x in sorted(spans or ()):
                    a, z = x >> 32, x & 0xFFFFFFFF
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], z)
                    else:
                        merged += [a, z]
                for a, z in zip(merged[::2], merged[1::2], strict=True):
                    kept.append(text[last:a])
                    last = z
                left = b"".join([*kept, text[last:]])
                rows.append((None if doc == NULL_ID else int(doc), len(text), len(text) - len(left), len(merged) // 2, hashlib.sha256(left).hexdigest(), merged, left if keep_text else None))
            if rows:
                yield batch(RESULT, *zip(*rows, strict=True))

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, sampled: int = 5_000, keep_text: bool = False) -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier: in a smaller doc_id (null last), or in the same document before. Null text is empty; texts under
    ``length`` bytes lose nothing. Rows that repeat a doc_id with one text count as one document and get equal
    results; with several texts they are several documents, ordered by a hash of the text. Other columns are
    ignored. Splitters come from about ``sampled`` documents; they decide balance, never the result.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in turn) and, where
    ``keep_text``, the kept bytes.
    """
    if not 2 * LEAD < length <= LEAD + 255:
        raise ValueError(f"length must lie in {2 * LEAD + 1}..{LEAD + 255}")
    spark, rows = docs.sparkSession, keyed(docs)
    n = shuffle_partitions(spark)

    def sample(batches):
        schema = pa.schema([("lead", pa.binary())])
        for b in batches:
            some = keys(suffixes(byte_lists(b.column("text")), length)[::16])
            yield batch(schema, [x.ljust(KEY.itemsize, b"\0") for x in some.tolist()])

    share = min(1.0, sampled / max(1, docs.count()))
    found = sorted(bytes(r.lead) for r in rows.select("text").sample(share, 7).mapInArrow(sample, "lead binary").collect())
    splitters = sorted({found[len(found) * k // n] for k in range(1, n)}) if found else []
    sent = rows.mapInArrow(sending(length, b"".join(splitters)), "bucket int, kind int, blob binary")
    marked = cut(sent.repartitionById(n, "bucket").select("kind", "blob").mapInArrow(sorting, "id long, th long, kind int, lead long, pos long, lo int, hi int"))
    release(spark)
    opened = marked.where("kind > 0").groupBy("id", "th").agg(F.collect_list(F.struct("kind", "lead", "pos", "lo", "hi")).alias("open"))
    around = rows.join(opened, ["id", "th"]).select("id", "th", "text", "open").mapInArrow(contexts(length), "id long, th long, kind int, lead long, pos long, lo int, hi int, context binary")
    compared = cut(around.repartition(n, "lead").mapInArrow(comparing(length), "id long, th long, start long, end long"))
    release(spark)
    repeats = marked.where("kind = 0").select("id", "th", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))
    spans = repeats.unionByName(compared).groupBy("id", "th").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))
    out = rows.join(spans, ["id", "th"], "left").select("id", "text", "spans")
    return out.mapInArrow(removing(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("spans", "kept")
