"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

near_duplicates() links 64-bit fingerprints at a few differing bits, as follows; similar_groups() links sets of
shingles at a given similarity by wide fingerprints, as it says.

Fingerprints at ``distance`` or fewer differing bits agree wholly in ``blocks - distance`` of ``blocks`` bit blocks,
so every choice of kept blocks makes one table and each linked pair meets in at least one of them. Within a table
the bits are permuted so that the kept ones lead, and fingerprints are sorted by Gray rank. Upper nodes hold the bit
pattern shared by all fingerprints below under the node's mask; two nodes are compared by their patterns, the
differences add up on the way down, and a pair of groups that has exceeded the distance is dropped whole - as is one
whose members are all known to be connected, so that a dense group costs little more than a spanning tree.
Only spanning edges leave a task.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batch, byte_lists, cut, documents, keyed, long_array, shuffle_partitions
from .components import connected_components

SEED = 42
LEVELS = 4  # of nodes below the kept blocks
PAIRS = 1 << 20  # node pairs compared at once
WIDE, WIDE_PAIRS, FAN = 16, 1 << 16, 8  # words of a wide fingerprint; its node pairs compared at once; nodes below a node
BANDS, ROWS = 40, 6  # at similarity 0.8, all bands differ for 5 in a million pairs
SLACK = 5.0  # standard deviations of the differing bits allowed for in candidates; the sets themselves decide
SMALL, LOOSE = 20, 255  # shingles of sets that are also dealt by the start of their sorted hashes; bits in which such may differ: 192 on average for 4 in 5, 12.5 the deviation

BLOCK = 1_000  # members of a group that are compared at once, twice as many in the second pass


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the ASCII-lower-cased text's word shingles; no words: 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        end = np.cumsum(size)
        start = (end - size)[: len(found) - words + 1].tolist()
        hashes = list(map(xxhash.xxh64_intdigest, [joined[a:z] for a, z in zip(start, (end[words - 1 :] - 1).tolist(), strict=True)], repeat(SEED)))
    n, total = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, n, 65_536):
        total += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprinting(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in byte_lists(b.column("text"))), np.uint64, b.num_rows)
            yield batch(schema, b.column("doc_id"), fps.view(np.int64))

    return run


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprinting(words), "doc_id long, fp long")


def layouts(blocks: int, distance: int) -> list[tuple[list[int], int]]:
    """Per table: the order in which bits (63 first) are read, kept blocks leading, and how many bits those hold."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for kept in combinations(range(blocks), blocks - distance):
        order = [bit for k in [*kept, *(k for k in range(blocks) if k not in kept)] for bit in range(cuts[k], cuts[k + 1])]
        out.append((order, sum(cuts[k + 1] - cuts[k] for k in kept)))
    return out


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit order[k] (counted from the highest) moves to place k; runs of bits move together."""
    out, at = np.zeros(len(fps), np.uint64), 0
    while at < 64:
        run = 1
        while at + run < 64 and order[at + run] == order[at] + run:
            run += 1
        part = fps << np.uint64(order[at]) >> np.uint64(64 - run)
        out |= part << np.uint64(64 - at - run)
        at += run
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def dealing(tables: list[tuple[list[int], int]], buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("tab", pa.int32()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = long_array(b.column("fp")).view(np.uint64)
            for t, (order, kept) in enumerate(tables):
                key = permuted(fps, order) >> np.uint64(64 - kept)
                bucket = ((key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
                yield batch(schema, (bucket % np.uint64(buckets)).astype(np.int32), np.full(len(fps), t, np.int32), fps.view(np.int64))

    return run


class Forest:
    """Labels of entries; each names the root of its tree, the smallest entry."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def connect(code: np.ndarray, table: np.ndarray, kept: np.ndarray, entry: np.ndarray, forest: Forest, distance: int) -> None:
    """Joins entries whose codes lie within ``distance``, among codes of one table that share its kept bits."""
    order = np.lexsort((gray_rank(code), table))
    code, table, kept, entry = code[order], table[order], kept[order], entry[order]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    starts, masks = [], []
    above = np.zeros(len(code), np.uint64)
    new = np.zeros(len(code), bool)
    new[0] = True
    for level in range(LEVELS + 1):
        depth = kept + (64 - kept) * level // LEVELS
        mask = full << (64 - depth).astype(np.uint64)
        new[1:] |= (table[1:] != table[:-1]) | ((code[1:] ^ code[:-1]) & mask[1:] != 0)
        starts.append(np.flatnonzero(new))
        masks.append(mask & ~above)
        above = mask
    child = [np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])) for k in range(LEVELS)]
    near = np.flatnonzero((table[1:] == table[:-1]) & (np.bitwise_count(code[1:] ^ code[:-1]) <= distance))
    forest.join(entry[near], entry[near + 1])  # neighbours in Gray order mostly differ little

    roots = np.flatnonzero(np.diff(np.append(starts[0], len(code))) > 1)
    stack = [(0, roots[at : at + PAIRS], roots[at : at + PAIRS], np.zeros(min(PAIRS, len(roots) - at), np.uint8)) for at in range(0, len(roots), PAIRS)]
    while stack:
        level, u, v, far = stack.pop()
        if level == LEVELS:
            rows_u, rows_v = starts[level][u], starts[level][v]
            forest.join(entry[rows_u], entry[rows_v])
            continue
        label = forest.label[entry]
        low, high = np.minimum.reduceat(label, starts[level]), np.maximum.reduceat(label, starts[level])
        apart = (low[u] != high[u]) | (low[v] != high[v]) | (low[u] != low[v])
        u, v, far = u[apart], v[apart], far[apart]
        n_u, n_v = child[level][u + 1] - child[level][u], child[level][v + 1] - child[level][v]
        total = np.cumsum(n_u * n_v)
        at = 0
        while at < len(u):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            size = n_u[at:end] * n_v[at:end]
            pair = np.repeat(np.arange(at, end), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            a, b = child[level][u[pair]] + k // n_v[pair], child[level][v[pair]] + k % n_v[pair]
            go = (u[pair] != v[pair]) | ((a < b) if level + 1 == LEVELS else (a <= b))
            a, b, pair = a[go], b[go], pair[go]
            left, right = starts[level + 1][a], starts[level + 1][b]
            d = far[pair] + np.bitwise_count((code[left] ^ code[right]) & masks[level + 1][left])
            go = d <= distance
            if go.any():
                stack.append((level + 1, a[go], b[go], d[go].astype(np.uint8)))
            at = end


def linking(tables: list[tuple[list[int], int]], distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        parts = [(long_array(b.column("tab")), long_array(b.column("fp")).view(np.uint64)) for b in batches if b.num_rows]
        if not parts:
            return
        tab, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, entry = np.unique(fp, return_inverse=True)
        code, kept = np.empty(len(fp), np.uint64), np.empty(len(fp), np.int64)
        for t, (order, bits) in enumerate(tables):
            here = tab == t
            code[here], kept[here] = permuted(fp[here], order), bits
        forest = Forest(len(own))
        connect(code, tab, kept, entry, forest, distance)
        moved = np.flatnonzero(forest.label != np.arange(len(own)))
        for at in range(0, len(moved), 100_000):
            m = moved[at : at + 100_000]
            yield batch(schema, own[m].view(np.int64), own[forest.label[m]].view(np.int64))

    return run


def blocks_for(n: int, distance: int) -> int:
    """As many blocks as keep about 16 random fingerprints or fewer to a key."""
    blocks = distance + 1
    while blocks < distance + 5 and n / 2 ** (64 * (blocks - distance) / blocks) > 16:
        blocks += 1
    return blocks


def fingerprint_components(fps: DataFrame, distance: int) -> DataFrame:
    """Columns fp and root (its component's smallest fingerprint) of all fingerprints that have a link; fps: distinct ones."""
    spark = fps.sparkSession
    tables, n = layouts(blocks_for(fps.count(), distance), distance), shuffle_partitions(spark)
    dealt = fps.select("fp").mapInArrow(dealing(tables, 64 * n), "bucket int, tab int, fp long")
    edges = dealt.repartition(n, "bucket").select("tab", "fp").mapInArrow(linking(tables, distance), "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of each row.

    Fingerprints link at ``distance`` or fewer differing bits; equal ones always. Texts without words have fingerprint
    zero and link like any other; null text has none. Null doc_ids are kept, and name a component only where it has
    no other id. Rows that repeat a doc_id stay rows. Other columns are ignored.
    """
    own = cut(fingerprints(docs, words))
    least = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = fingerprint_components(least, distance)
    named = least.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(first, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; none if the text has no words."""
    found = text.lower().split()
    shingles = {b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def mixed(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A row for each hash, in it another hash for each salt."""
    out = (hashes[:, None] ^ salts) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return out


def salts(first: int, count: int) -> np.ndarray:
    return np.arange(first, first + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


FOR_BITS, FOR_BANDS = salts(1, WIDE), salts(1_000, BANDS * ROWS)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WIDE words of 64 bits over distinct shingles, each counted once."""
    total = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 2_048):
        bits = np.unpackbits(mixed(hashes[at : at + 2_048], FOR_BITS).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band, of its ROWS smallest hashes under as many orders; equal with the chance similarity ** ROWS."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF if len(hashes) else 0, "<u8")
    for at in range(0, len(hashes), 1_024):
        np.minimum(least, mixed(hashes[at : at + 1_024], FOR_BANDS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(least.reshape(BANDS, ROWS))]


def least_share(n: int, similarity: float) -> int:
    """The fewest of n shingles that a set of this similarity or more has too."""
    return max(1, int(np.ceil(similarity * n - 1e-9)))


def small_keys(hashes: np.ndarray, similarity: float) -> list[int]:
    """Keys of a small set, of which sets of this similarity or more share one: the least hashes, but for as many as they must share."""
    n = len(hashes)
    return [xxhash.xxh64_intdigest(x.tobytes(), BANDS) - 2**63 for x in hashes[: n - least_share(n, similarity) + 1]] if 0 < n <= SMALL else []


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets of sorted hashes is at least this."""
    n, m = len(a), len(b)
    if min(n, m) < similarity * max(n, m) - 1e-9:
        return False
    if not max(n, m):
        return True
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (n + m - common) - 1e-9


def describing(words: int, similarity: float):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("own", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            own, fps, bands = [], [], []
            for text in byte_lists(b.column("text")):
                hashes = shingle_hashes(text, words)
                own.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63)
                fps.append(wide_fingerprint(hashes).tobytes())
                bands.append([k & ~1 for k in band_keys(hashes)] + [k | 1 for k in small_keys(hashes, similarity)])
            if own:
                yield batch(schema, b.column("id"), b.column("th"), own, fps, bands)

    return run


def checked(forest: Forest, same):
    """Like the forest's join(), for pairs of which same(a, b) holds; those already connected aren't looked at."""

    def join(a: np.ndarray, b: np.ndarray) -> None:
        at, size = 0, 64
        while at < len(a):
            x, y = a[at : at + size], b[at : at + size]
            at, size = at + size, min(2 * size, 4_096)
            apart = forest.label[x] != forest.label[y]
            x, y = x[apart], y[apart]
            go = np.fromiter(map(same, x.tolist(), y.tolist()), bool, len(x))
            forest.join(x[go], y[go])

    return join


def connect_wide(code: np.ndarray, bucket: np.ndarray, entry: np.ndarray, forest: Forest, distance, same=None) -> None:
    """Joins entries of one bucket whose codes (rows of 64-bit words) differ in at most ``distance`` bits (one number, or one for each row's bucket) and, with ``same``, for which that holds too.

    In Gray order, nodes stand for up to FAN nodes below and hold the bits that all of those have set, or unset. Bits
    set in one node and unset in another differ for all pairs below, so too many of them drop both groups whole.
    """
    order = np.lexsort((gray_rank(code[:, 0]), bucket))
    code, bucket, entry, limit = code[order], bucket[order], entry[order], np.broadcast_to(distance, len(code))[order]
    join = forest.join if same is None else checked(forest, same)
    near = np.flatnonzero((bucket[1:] == bucket[:-1]) & (np.bitwise_count(code[1:] ^ code[:-1]).sum(axis=1, dtype=np.int64) <= limit[1:]))
    join(entry[near], entry[near + 1])
    starts, child = [np.arange(len(code))], []  # rows at which nodes start, from the leaves up; children's bounds
    while True:
        owner = bucket[starts[-1]]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        if len(first) == len(owner):
            break
        within = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        heads = np.flatnonzero(within % FAN == 0)
        child.append(np.append(heads, len(owner)))
        starts.append(starts[-1][heads])
    ones = [np.bitwise_and.reduceat(code, at, axis=0) for at in starts]
    zeros = [np.bitwise_and.reduceat(~code, at, axis=0) for at in starts]
    top = len(starts) - 1
    roots = np.arange(len(starts[top]))
    stack = [(top, roots, roots)] if top else []
    while stack:
        level, u, v = stack.pop()
        if level == 0:
            join(entry[u], entry[v])
            continue
        label = forest.label[entry]
        low, high = np.minimum.reduceat(label, starts[level]), np.maximum.reduceat(label, starts[level])
        apart = (low[u] != high[u]) | (low[v] != high[v]) | (low[u] != low[v])
        u, v = u[apart], v[apart]
        bound = child[level - 1]
        n_u, n_v = bound[u + 1] - bound[u], bound[v + 1] - bound[v]
        total = np.cumsum(n_u * n_v)
        at = 0
        while at < len(u):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WIDE_PAIRS, side="right")))
            size = n_u[at:end] * n_v[at:end]
            pair = np.repeat(np.arange(at, end), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            a, b = bound[u[pair]] + k // n_v[pair], bound[v[pair]] + k % n_v[pair]
            go = (u[pair] != v[pair]) | ((a < b) if level == 1 else (a <= b))
            a, b = a[go], b[go]
            differ = (ones[level - 1][a] & zeros[level - 1][b]) | (zeros[level - 1][a] & ones[level - 1][b])
            go = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= limit[starts[level - 1][a]]
            if go.any():
                stack.append((level - 1, a[go], b[go]))
            at = end


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def seeded(name: np.ndarray, entry: np.ndarray, comp: np.ndarray) -> Forest:
    """A forest over names in which entries of one component (of an earlier pass) are connected."""
    forest, order = Forest(len(name)), np.argsort(comp, kind="stable")
    same = comp[order][1:] == comp[order][:-1]
    forest.join(entry[order][1:][same], entry[order][:-1][same])
    return forest


def spanning(name: np.ndarray, forest: Forest):
    moved = np.flatnonzero(forest.label != np.arange(len(name)))
    for at in range(0, len(moved), 100_000):
        m = moved[at : at + 100_000]
        yield batch(LINKS, name[m], name[forest.label[m]])


def linking_wide(distance: int):
    """Candidates within each cell, by their wide fingerprints; cells of small sets have odd numbers."""

    def run(batches):
        parts = [(long_array(b.column("cell")), long_array(b.column("own")), long_array(b.column("comp")), b"".join(b.column("fp").to_pylist())) for b in batches if b.num_rows]
        if not parts:
            return
        cell, own, comp = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        code = np.frombuffer(b"".join(p[3] for p in parts), "<u8").reshape(-1, WIDE)
        name, entry = np.unique(own, return_inverse=True)
        forest = seeded(name, entry, comp)
        connect_wide(code, cell, entry, forest, np.where(cell & 1, LOOSE, distance))
        yield from spanning(name, forest)

    return run


def verifying(words: int, similarity: float, distance: int):
    """Links within each cell by the sets themselves."""

    def run(batches):
        members, sets, comps = set(), {}, {}
        for b in batches:
            for cell, own, comp, text in zip(*(b.column(c).to_pylist() for c in ("cell", "own", "comp")), byte_lists(b.column("text")), strict=True):
                members.add((cell, own))
                if own not in sets:
                    sets[own], comps[own] = shingle_hashes(text, words), comp
        if not members:
            return
        name = np.array(sorted(sets), np.int64)
        hashes = [sets[x] for x in name.tolist()]
        code = np.array([wide_fingerprint(x) for x in hashes])
        cell, own = np.array(sorted(members), np.int64).T
        entry = np.searchsorted(name, own)
        forest = seeded(name, np.arange(len(name)), np.array([comps[x] for x in name.tolist()], np.int64))
        connect_wide(code[entry], cell, entry, forest, distance, lambda i, j: alike(hashes[i], hashes[j], similarity))
        yield from spanning(name, forest)

    return run


def in_blocks(members: DataFrame, link) -> DataFrame:
    """node and component of what ``link`` connects within groups, none of which has to meet in one task.

    members: group and own (once a group), both long. ``link`` takes cell, own and comp and returns edges a, b within
    each cell; of members that agree in comp it may take for granted that they are connected.

    First pass: a group of more than ``block`` members is dealt to blocks by hash, and its smallest and largest member
    go to each, so that a group of copies is connected already. Second pass, for groups where it isn't: members
    outside the smallest one's component are dealt to blocks of their own, each of which meets every other block of the
    group. All members of a group have then met, or are known to be connected.
    """
    number = lambda *c: F.xxhash64("group", *c).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("group").bitwiseAND(F.lit(1)))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("long")
    place = lambda n: F.pmod(F.xxhash64("own", F.lit(1)), n)
    sizes = cut(members.groupBy("group").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high")).where("n > 1"))
    dealt = members.join(sizes, "group").withColumn("blocks", blocks("n"))
    everywhere = F.col("own").isin(F.col("low"), F.col("high"))
    dealt = dealt.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(place(F.col("blocks"))))))
    near = connected_components(link(dealt.select(number("part").alias("cell"), "own", F.col("own").alias("comp"))))
    large = sizes.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return near
    named = members.join(large.select("group", "low"), "group").join(near.withColumnRenamed("node", "own"), "own", "left")
    named = cut(named.select("group", "own", F.coalesce("component", "own").alias("comp"), (F.col("own") == F.col("low")).alias("lowest")))
    main = named.where("lowest").select("group", F.col("comp").alias("main"))
    out = F.col("comp") != F.col("main")
    apart = cut(named.join(main, "group").groupBy("group", "main").agg(F.sum((~out).cast("long")).alias("n_main"), F.sum(out.cast("long")).alias("n_out")).where("n_out > 0"))
    if apart.isEmpty():
        return near
    dealt = named.join(apart, "group").withColumns({"m": blocks("n_main"), "all": blocks("n_main") + blocks("n_out")})
    dealt = dealt.withColumn("part", F.when(out, F.col("m") + place(F.col("all") - F.col("m"))).otherwise(place(F.col("m"))))
    others = F.sequence(F.when(out, F.lit(0).cast("long")).otherwise(F.col("m")), F.col("all") - 1)
    dealt = dealt.withColumn("other", F.explode(others)).where("other != part")
    edges = link(dealt.select(number(F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "own", "comp"))
    return connected_components(edges.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, th (see keyed()), first_id and first_th of each row: the smallest of its group of near-duplicates.

    Texts are linked if their shingle sets have this Jaccard similarity or more. Candidates are texts whose wide
    fingerprints differ in no more bits than such sets do, with allowance for chance. Two sets of cosine c differ in a
    bit with the chance arccos(c) / pi, and c is at least 2 s / (1 + s). At 0.8 that is 15 in 100 bits, too many to deal
    fingerprints by whole bit blocks, so they are dealt by bands of smallest shingle hashes and compared within a band in
    Gray order. Within a component of candidates only pairs whose sets are similar are then joined. Large bands and
    components are compared in blocks; see in_blocks().
    Texts without words, null ones too, are one group. Other columns are ignored.
    """
    spark = docs.sparkSession
    chance = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    distance = int(64 * WIDE * chance + SLACK * (64 * WIDE * chance * (1 - chance)) ** 0.5)
    rows = cut(keyed(docs).mapInArrow(describing(words, similarity), "id long, th long, own long, fp binary, bands array<long>"))
    least = F.min(F.struct("id", "th")).alias("least")
    sets = cut(rows.groupBy("own").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    n = shuffle_partitions(spark)

    def candidates(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(sets.select("own", "fp"), "own").repartition(n, "cell").select("cell", "own", "comp", "fp")
        return rows.mapInArrow(linking_wide(distance), "a long, b long")

    def verified(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(sets.select("own", "least.id", "least.th"), "own").join(keyed(docs), ["id", "th"]).repartition(n, "cell")
        return rows.select("cell", "own", "comp", "text").mapInArrow(verifying(words, similarity, max(distance, LOOSE)), "a long, b long")

    bands = sets.select(F.explode(F.array_distinct("bands")).alias("group"), "own")
    near = cut(in_blocks(bands, candidates).select(F.col("component").alias("group"), F.col("node").alias("own")))
    root = in_blocks(near, verified).select(F.col("node").alias("own"), F.col("component").alias("root"))
    named = cut(sets.select("own", "least").join(root, "own", "left").select("own", "least", F.coalesce("root", "own").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(first, "root").select("own", "first")
    return rows.select("id", "th", "own").join(named, "own").select("id", "th", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"))


def one_per_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, of each group of near-duplicates (see similar_groups()) one document: the smallest doc_id, null last, of equal ones the smallest hash of the text.

    Of rows that repeat that document one stays. All columns are kept.
    """
    groups = cut(similar_groups(docs, words, similarity))
    kept = groups.where("id = first_id and th = first_th").groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"))
    kept = cut(kept)
    rows = docs.withColumns({"__key": F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), "__hash": F.xxhash64(docs["text"])})
    on = (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th"))
    single = rows.join(kept.where("__n = 1"), on, "left_semi")
    repeated = rows.join(kept.where("__n > 1"), on, "left_semi").dropDuplicates(["__key", "__hash"])
    return single.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3)
