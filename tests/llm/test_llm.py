"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessera.llm import chat, decontaminate, gif, langid, licenses, lines, mixing, pii, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, size string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "straße", "été"]
    made = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) + "\n", "en", f"s{k % 3}") for k in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    made += [(100, f"x {passage} y", "en", "s1"), (101, f"other {passage}", "en", None), (102, made[3][1], "fr", "s2"), (102, made[3][1], "fr", "s2")]
    made += [(103, None, None, None), (104, "", "en", "s1"), (None, "no id here " * 30, "en", "s1"), (105, "ab" * 300, "en", "s1"), (106, "one line\n" * 9, "en", "s1"), (107, "word " * 20_000, "de", "s0"), (108, "?!" * 40, None, "s0")]
    return [(i, t, lang, s, None, 1, "x", "y") for i, t, lang, s in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return 2**63 if i is None else i


def test_suffix_dedup(docs, rows, none):
    seen, want = set(), {}
    for i, text in sorted({(key(r[0]), r[1] or "") for r in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    assert all(tuple(r)[1:5] == want[key(r.doc_id)] for r in got)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def brute_fingerprint(text, n):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, rows, none):
    fps = {}
    for r in rows:
        fps.setdefault(brute_fingerprint(r[1] or "", 3), []).append(r[0])
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for f, ids in fps.items():
        least.setdefault(find(f), []).extend(x for x in ids if x is not None)
    got = simhash.near_duplicates(docs, 3).collect()
    assert len(got) == len(rows)
    for r in got:
        f = int(r.fingerprint, 16)
        assert r.doc_id in fps[f] and r.component_id == min(least[find(f)], default=None)
    assert simhash.near_duplicates(none, 3).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups(spark, docs, rows, none):
    """Edited copies are found, others are left alone; groups of many copies, ties and awkward rows."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    made, base = [], [text(rng.randrange(60, 400)) for _ in range(40)]
    for k, own in enumerate(base):
        made.append((k, " ".join(own)))
        for copy in range(12 if k == 0 else 2):
            edited = list(own)
            for _ in range(max(1, len(own) // 120)):  # about 5 shingles an edit: similarity 0.9 or so
                edited[rng.randrange(len(own))] = "edit"
            made.append((100 + 20 * k + copy, " ".join(edited)))
        made.append((2_000 + k, " ".join(own[: len(own) // 2] + text(len(own) // 2))))  # a third in common
    got = {r.id: r.first_id for r in simhash.similar_groups(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in made}
    for (i, _), (j, _) in combinations(made, 2):
        s = jaccard(sets[i], sets[j])
        assert got[i] == got[j] or s < 0.82
        assert got[i] != got[j] or s > 0.45  # chains may join less similar ones
    assert all(got[2_000 + k] == 2_000 + k for k in range(40))
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and simhash.one_per_group(none).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 102 not in ids and 103 in ids and 104 not in ids and None in ids
    many = [(k, f"x {k}" if k % 3 else "the same text again and again for all of them") for k in range(3_000)] + [(0, "the same text again and again for all of them")] * 50 + [(None, "x 1")] * 3
    kept = simhash.one_per_group(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, *(k for k in range(3_000) if k % 3)]


def test_similar_groups_are_exact(spark):
    """Groups are the components of true Jaccard similarity, for dense families just below 0.8 and for small nested sets."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    made = []
    for _ in range(40):
        own = text(rng.randrange(80, 300))
        made.append(" ".join(own))
        for _ in range(4):  # similarities of 0.6 to 0.95
            edited, at = list(own), rng.randrange(len(own) // 2)
            size = int(len(own) * rng.uniform(0.02, 0.22))
            edited[at : at + size] = text(size)
            made.append(" ".join(edited))
    for _ in range(60):
        own = text(9)
        made += [" ".join(own), " ".join(own[:8])]  # 4 shingles of 5
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in made]
    root = list(range(len(made)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(len(made)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = {r.id: r.first_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: find(k) for k in range(len(made))}


def test_wide_index_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (60, simhash.WIDE), dtype=np.uint64)
    code = base[rng.integers(0, 60, 900)]
    for _ in range(40):
        code[np.arange(900), rng.integers(0, simhash.WIDE, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    bucket = rng.integers(0, 3, 900)
    want, got = simhash.Forest(900), simhash.Forest(900)
    for k in range(900):
        other = np.flatnonzero((np.bitwise_count(code ^ code[k]).sum(axis=1) <= 70) & (bucket == bucket[k]))
        want.join(np.full(len(other), k), other)
    simhash.connect_wide(code, bucket, np.arange(900), got, 70)
    assert np.array_equal(want.label, got.label) and len(set(want.label)) > 180


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_index_finds_all_links(blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    want, got = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for k in range(len(fps)):
        other = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3)
        want.join(np.full(len(other), k), other)
    for t, (order, bits) in enumerate(simhash.layouts(blocks, 3)):
        simhash.connect(simhash.permuted(fps, order), np.full(len(fps), t), np.full(len(fps), bits), np.arange(len(fps)), got, 3)
    assert np.array_equal(want.label, got.label)


def test_mixing(spark, docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(none).count() == 0
    sizes = {}
    for r in rows:
        sizes[(r[3] is None, r[3] or "")] = sizes.get((r[3] is None, r[3] or ""), 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in target.values()}
    many = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    by = mixing.mix_sources(many, lot=3_000).groupBy("source_size").agg({"target": "first", "taken": "sum"}).collect()
    assert all(abs(r["first(target)"] - r["sum(taken)"]) < 100 for r in by)
    with pytest.raises(ValueError, match="lot"):
        mixing.mix_sources(many, lot=10)


def test_decontaminate(spark, docs, rows, none):
    text = {r[0]: r[1] or "" for r in rows}
    items = [(1, " ".join(text[100].split()[5:40])), (2, "beta"), (3, None), (4, ""), (None, "the of"), (5, text[107][:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    for block in (1 << 24, 100):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            own, hit, found = words(text[r.doc_id]), set(), set()
            for name, item in items:
                w = words(item or "")
                n = min(13, len(w))
                windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
                at = [k for k in range(len(own) - n + 1) if n and tuple(own[k : k + n]) in windows]
                hit |= {q for k in at for q in range(k, k + n)}
                found |= {"null" if name is None else str(name)} if at else set()
            assert (r.n_words, r.n_hit, r.items) == (len(own), len(hit), sorted(found))
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.without_contaminated(docs, bench).columns == docs.columns


def test_lines(docs, rows, none):
    seen, want = set(), {}
    for i, text in sorted({(key(r[0]), r[1]) for r in rows if r[1] is not None}):
        own, gone = text.split("\n"), set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    got = lines.line_dedup(docs)
    assert got.columns == docs.columns
    assert all(r.text == want.get(key(r.doc_id)) for r in got.collect())
    assert lines.line_dedup(none).count() == 0


def test_chat(spark):
    nasty = ["", "[INST]", "[\\INST] <s>", "</s>[SYS][/ROLE]\\", "<", "\\", "[ROLE]x[/ROLE][/TURN]", "<<s>s>"]
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([(random.Random(c * 7 + k).choice(["user", "assistant", "system", "tool", None, ""]), random.Random(c + k * 31).choice([*nasty, None])) for k in range(c % 6)])]
    rows += [(99, 0, "user", "a"), (99, 1, "assistant", "b"), (None, None, None, None), (98, 1, "user", "a"), (98, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_format(df).withColumn("back", chat.read_back(chat.F.col("formatted"))).collect()}
    for c, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", x or "") for k, t, role, x in rows if k == c))
        assert [(b.role, b.text) for b in r.back] == [(role, x) for _, role, x in own]
    assert got[99].valid and not got[98].valid and got[98].first_error == 1
    assert chat.chat_format(df.where("false")).count() == 0


def test_licenses(docs, rows, none, spark):
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(rows) and licenses.license_scan(none).count() == 0
    cases = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Released under the MIT License.": "mit", "All rights reserved": "reserved", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "nothing": ""}
    made = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.labels for r in licenses.license_scan(made).orderBy("doc_id").collect()] == list(cases.values())
    r = licenses.license_scan(spark.createDataFrame([(1, "a cc-by cc by, general public license")], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (8, 3, 1, 5, "cc-by,gpl")


def test_gif():
    rng = random.Random(1)
    for root, n in ((8, 0), (8, 64), (8, 90_000), (2, 5_000), (5, 20_000)):
        data = bytes(rng.randrange(1 << root) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, root), root, n) == data
    one, two = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]), bytes([9, 9, 9, 1, 2, 3])
    frames = [gif.Frame(0, 0, np.ones((4, 4), np.uint8), one, -1, 1, 5), gif.Frame(1, 1, np.array([[2, 0], [0, 2]], np.uint8), one, 0, 3, 7), gif.Frame(0, 0, np.full((2, 2), 1, np.uint8), two, -1, 2, 9), gif.Frame(3, 3, np.full((1, 1), 3, np.uint8), one, -1, 0, 1)]
    width, height, back = gif.decode_frames(gif.encode_gif(frames, 4, 4))
    assert (width, height, [f.delay for f in back]) == (4, 4, [5, 7, 9, 1])
    seen = [rgba for rgba, _ in gif.compose(4, 4, back)]
    assert seen[1][1, 1].tolist() == [0, 255, 0, 255] and seen[1][1, 2].tolist() == [255, 0, 0, 255]  # transparent: what was there
    assert seen[2][2, 2].tolist() == [255, 0, 0, 255] and seen[2][0, 0].tolist() == [1, 2, 3, 255]  # restored; own palette
    assert seen[3][0, 0].tolist() == [0, 0, 0, 0] and seen[3][3, 3].tolist() == [0, 0, 255, 255]  # cleared
    assert gif.histogram(seen[3]).sum() == 12
    with pytest.raises(ValueError):
        gif.decode_frames(b"no")


def test_gif_rows(spark, docs, rows, none):
    media = gif.text_gifs(docs)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in gif.gif_features(media).collect():
        t = text[r.doc_id]
        assert (r.n_bytes, r.payload_sha256) == (len(t), hashlib.sha256(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest())
    assert gif.gif_frames(media).count() >= len(rows) and gif.gif_features(gif.text_gifs(none)).count() == 0
    assert gif.gif_frames(spark.createDataFrame([(1, b"bad"), (2, None)], "doc_id long, media binary")).first().error


def test_pii(spark, docs, rows, none):
    assert pii.personal_data(docs).count() == len(rows) and pii.personal_data(none).count() == 0
    made = [(k, f"Contact Quillfeather{k} about it: zorblatt a.b@c.de now plain words {k}" if k < 3 else "plain words about it now") for k in range(60)]
    got = {r.id: [made[r.id][1][t.start : t.end] for t in r.terms] for r in pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert "zorblatt" in got[0] and "plain" not in got[0] and got[10] == []
    clean = pii.sanitise(spark.createDataFrame([*made, (61, None)], "doc_id long, text string")).collect()
    assert "[EMAIL]" in next(r.text for r in clean if r.doc_id == 0) and next(r.text for r in clean if r.doc_id == 61) is None
    assert pii.base_spans("a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 x 4111 1111 1111 1111 +1 (017) 555-7713") == [(0, 0, 5), (5, 0, 11), (12, 1, 19), (20, 1, 27), (40, 2, 59), (60, 3, 77)]


def test_pii_terms_anywhere(spark):
    """Terms count and are marked far from the span, beyond the nearest four, and in documents without one."""
    far = "common filler words only here " * 20
    made = [(k, f"Zorblatt {far} mail a.b@c.de now" if k < 6 else "common words") for k in range(200)] + [(200, "met zorblatt again")]
    got = {r.id: [made[r.id][1][t.start : t.end] for t in r.terms] for r in pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert "Zorblatt" in got[0] and got[200] == ["zorblatt"] and got[50] == []


def test_pii_many_spans(spark):
    """No term lies within a base span, in documents of more than 64 too."""
    text = "list " + " ".join(f"person{k:03}x.smithers@company.example" for k in range(90))
    got = pii.personal_data(spark.createDataFrame([(k, text + f" {k}" if k < 2 else "plain words") for k in range(30)], "doc_id long, text string")).where("id < 2").collect()
    for r in got:
        assert len(r.spans) == 90 and not [t for t in r.terms for s in r.spans if t.start < s.end and s.start < t.end]


def test_language(spark, docs, rows, none):
    made = [(k, ("the and of with that is " if k % 2 else "le la des que pour ètré ") * 9, "en" if k % 2 else "fr") for k in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    net = langid.learn(df)
    got = langid.identify(df, net).join(df, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    all_ = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert all(all_[k].lang_pred == "und" for k in (103, 104, 108)) and all_[107].lang_pred != "und"
    assert langid.known_language(docs, net).count() == len(rows) - 3
    assert langid.learn(none) is None and langid.identify(none, None).count() == 0 and langid.identify(docs, None).first().lang_pred == "und"


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text, seen = {}, set()
    for r in docs.orderBy("doc_id").collect():  # languages, then lines
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            continue
        own, gone = r.text.split("\n"), set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        text[r.doc_id] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    hashes = {i: simhash.shingle_hashes(t.encode(), 5) for i, t in text.items()}
    fps = {i: int.from_bytes(simhash.wide_fingerprint(h).tobytes(), "little") for i, h in hashes.items()}
    most = max(d for d in range(1024) if d <= 1024 * 0.1514 + 2.3 * (1024 * 0.1514 * 0.8486) ** 0.5)  # arccos(8 / 9) / pi
    root = {i: i for i in text}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in combinations(sorted(text), 2):
        if np.array_equal(hashes[a], hashes[b]) or ((fps[a] ^ fps[b]).bit_count() <= most and set(simhash.band_keys(hashes[a])) & set(simhash.band_keys(hashes[b]))):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = {i: t for i, t in text.items() if find(i) == i}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    left = decontaminate.decontaminate(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), bench).where("not contaminated").collect()
    assert set(got) == {r.doc_id for r in left}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", kept[i])) and r.taken <= 3 * r.size for i, r in got.items())
