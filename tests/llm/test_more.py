"""More of the training-data operators against brute force: awkward rows, hot groups, and the pipeline by its definition."""

import hashlib
import random
import re
import re._parser as regex_parser
import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, decontaminate, gif, langid, licenses, lines, mixing, pii, simhash, suffix_dedup

BLANK = r"[\x20\x09-\x0D]+"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_suffix_dedup_without_ids(spark):
    """Documents without an id are told apart by their texts, by 64 bits of hash."""
    rng = random.Random(3)
    text = ["".join(rng.choice("abcdefgh") for _ in range(256)) for _ in range(40)]
    rows = [(1, text[0])] + [(None, t) for t in text]
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(r.n_removed for r in got) == [0] * 40 + [256]


def removed_bytes(texts: list[str], length: int = 100) -> list[int]:
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(text[p : p + length])
        out.append(sum(gone))
    return out


def test_suffix_dedup_hot_lead(spark):
    """A passage between many different beginnings and ends: its windows are dealt singly, with the same result."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    middle, short, ends = word(120), word(70), [word(90) for _ in range(40)]
    texts = [(ends[k % 40] if k % 3 else word(90)) + (middle if k % 4 else short) + (ends[k // 40] if k % 5 else word(90)) for k in range(1_500)]
    got = suffix_dedup.suffix_dedup(frame(spark, [*enumerate(texts), (7, texts[7]), (8, texts[8])])).collect()
    want = removed_bytes(texts)
    assert len(got) == 1_502 and [(r.doc_id, r.n_removed) for r in got if r.n_removed != want[r.doc_id]] == []


def test_chat_role_with_line_break(spark):
    rows = [(1, 0, "to\nol", "a\nb"), (1, 1, "[ROLE]\n", "</s>"), (1, 2, "assistant", "x" * 200_000)]
    df = frame(spark, [(*r, "y", "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid string")
    got = chat.chat_format(df).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(b.role, b.text) for b in got.back] == [(role, x) for _, _, role, x in rows]


def sample(tree, rng):
    """A string that a regex matches."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "ANY":
                out += "y"
            case "BRANCH":
                out += sample(rng.choice(arg[1]), rng)
            case "SUBPATTERN":
                out += sample(arg[3], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            case "IN":
                kind, value = rng.choice(arg)
                out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else "x"
    return out


def test_license_gates():
    """What a rule's regex matches always holds the words that its gate asks for."""
    rng = random.Random(1)
    for rule in licenses.rules():
        tree = regex_parser.parse(rule.regex)
        for _ in range(25):
            words = f" {sample(tree, rng)} "
            assert re.fullmatch(rule.regex, words[1:-1])
            assert all(any(f" {n} " in words for n in need.split("|")) for need in rule.needs), (rule, words)


def test_license_base_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["CC BY", "cc-by", "ccby", "General Public License", "all rights reserved", "All  rights\nreserved", "rights reserved", "é", "by cc", "GPLv3 licence", "x_y", "", "licensed under Apache 2.0"]
    rows = [(k, " ".join(rng.choice(parts) + rng.choice(["", ".", " and"]) for _ in range(rng.randrange(40)))) for k in range(150)] + [(200, None), (201, ""), (202, "CC BY " * 30_000), (202, "CC BY")]
    got = licenses.license_scan(frame(spark, [(*r, "x", "y") for r in rows], "doc_id long, text string, w string, labels string")).collect()
    key = lambda r: (r[0], r[1], r[2])
    want = []
    for i, text in rows:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in hits]
        want.append((i, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_cases(spark):
    cases = {"Licensed under Apache 2.0": "apache-2.0", "MPL 2.0": "mpl-2.0", "Apache License v2.0": "apache-2.0", "Released under the GPLv3": "gpl-3", "Python Software Foundation License": "python", "New BSD License": "bsd-3-clause", "BSD Zero Clause License": "0bsd", "PHP 3.0 is out": ""}
    got = licenses.license_scan(frame(spark, list(enumerate(cases)))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(cases.values())


def test_gif_refuses_broken_streams(spark):
    whole = gif.payload_gif(bytes(range(256)) * 64)
    for data in (whole[: len(whole) // 2], whole[:-1], whole[:40]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            gif.decode_frames(data)
    huge = bytearray(whole)
    huge[6:10] = struct.pack("<HH", 65_535, 65_535)
    with pytest.raises(ValueError, match="too large"):
        gif.decode_frames(bytes(huge))
    with pytest.raises(ValueError):
        gif.lzw_decode(np.packbits([1] * 60).tobytes(), 8, 10)
    media = frame(spark, [(1, 7, bytes(huge)), (2, 8, whole), (2, 8, whole), (3, 9, None)], "doc_id long, width long, media binary")
    got = gif.gif_frames(media).collect()
    assert sorted((r.doc_id, r.width or 0, bool(r.error)) for r in got) == [(1, 0, True), (2, 64, False), (2, 64, False)]


def test_gif_interlaced_and_older():
    """Rows stored in four passes; a file of the older version."""
    rows = np.arange(20, dtype=np.uint8)[:, None].repeat(3, axis=1)
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, 20, step)]
    data = bytearray(gif.encode_gif([gif.Frame(0, 0, rows[order], gif.GREY)], 3, 20))
    data[:6] = b"GIF87a"
    at = data.index(b"\x2c\0\0\0\0", 13 + 768)
    data[at + 9] |= 0x40
    assert (gif.decode_frames(bytes(data))[2][0].samples == rows).all()


def test_gif_columns_by_brute_force(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "é" * 70_000), (5, "ab" * 32), (5, "ab" * 32)]
    got = gif.gif_features(gif.text_gifs(frame(spark, [(*r, b"x", 1) for r in rows], "doc_id long, text string, media binary, n_bytes int"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "" for i, t in rows if i == r.doc_id)).encode()
        payload = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
        media = gif.payload_gif(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 64 * 21, minlength=64)
        assert r.feature.split(";")[-1] == ",".join(f"{k}:{n}" for k, n in enumerate(counts) if n)


def test_pii_base_by_brute_force():
    """Each pattern as it is written, leftmost and non-overlapping, against the faster finders."""
    rng = random.Random(6)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    pool = ["a", "@", ".", "1", "25", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.255", "-", " ", "é", "x.y@b.co", "\n", "300", "0"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        want += [(m.start(), 2, m.end()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == sorted(want), text


def test_pii_counts_rows_once(spark):
    """Rows that repeat a document change no statistic; an empty table and clashing names are no matter."""
    made = [(k, f"zorblatt wrote {'a.b@c.de' if k < 3 else 'nothing'} at noon") for k in range(4)] + [(k, f"plain words {k}") for k in range(4, 60)]
    terms = lambda rows: {(r.id, t.start, t.end, t.disclosure) for r in pii.personal_data(frame(spark, [(*x, 1, "y") for x in rows], "doc_id long, text string, id long, spans string")).collect() for t in r.terms}
    once = terms(made)
    assert once == terms(made + [made[0]] * 20 + [made[10]] * 20)
    left = pii.sanitise(frame(spark, [(*x, 1) for x in made], "doc_id long, text string, terms long"))
    assert left.columns == ["doc_id", "text", "terms"] and left.where("contains(text, '@')").isEmpty()
    assert pii.sanitise(frame(spark, made).where("false")).isEmpty()


def test_pii_full_sieve(spark, monkeypatch):
    """A sieve has no more places than SIEVE, and one that lets everything pass changes no result."""
    name = lambda k: f"zorblatt{chr(97 + k % 4)}{chr(97 + k % 40 // 4)}"
    made = [(k, f"{name(k)} wrote a{k % 40}.b@c.de at noon") for k in range(120)] + [(k, f"plain words {k} {name(k)}") for k in range(200, 230)]
    found = lambda: {(r.id, t.start, t.end) for r in pii.personal_data(frame(spark, made)).collect() for t in r.terms}
    want = found()
    monkeypatch.setattr(pii, "SIEVE", 8)
    assert len(pii.sieve_of(frame(spark, [(f"t{k}",) for k in range(500)], "term string"))) == 8
    assert want and found() == want


def test_language_letters(spark):
    """Signs that count as word characters but are no letters."""
    assert not langid.has_letter("½ ² ٣ _ 7") and langid.has_letter("½ ª") and langid.has_letter("7x")
    made = [(k, ("the and of with that is " if k % 2 else "le la des que pour ètré ") * 9, "en" if k % 2 else "fr") for k in range(300)]
    net = langid.learn(frame(spark, made + [(None, t, lang) for _, t, lang in made], "doc_id long, text string, lang string"), sampled=50)
    rows = frame(spark, [(1, "½ ²", 1), (2, "the and of", 2), (2, "the and of", 2), (3, "", 3)], "doc_id long, text string, lang_pred long")
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(rows, net).collect()} == {(1, "und"), (2, "en"), (3, "und")}
    assert [tuple(r) for r in langid.known_language(rows, net).collect()] == [(2, "the and of", 2)] * 2


def test_decontaminate_hot_and_nameless(spark):
    """A passage of many documents and many items; items without a name beside one named null; clashing names."""
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    common_, own = words(30), [words(20) for _ in range(6)]
    items = [(str(k), f"{common_} {own[k]}", 1) for k in range(4)] + [(None, own[4], 1), ("null", own[5], 1), ("0", words(14), 1)]
    docs = [(k, f"{words(10)} {common_ if k % 2 else words(5)} {own[k % 6] if k % 3 == 0 else ''} {words(rng.randrange(400))}", "h", 1) for k in range(120)] + [(0, None, "h", 1), (7, "W1 " * 60_000, "h", 1)]
    bench = frame(spark, items, "item_id string, text string, size long")
    df = frame(spark, docs, "doc_id long, text string, hits string, n_words long")
    split = lambda t: (t or "").lower().split()
    windows = {}
    for k, (_, t, _) in enumerate(items):
        for a in range(len(split(t)) - 12):
            windows.setdefault(tuple(split(t)[a : a + 13]), set()).add(k)
    want = []
    for i, t, _, _ in docs:
        own_, hit, found = split(t), set(), set()
        for a in range(len(own_) - 12):
            if tuple(own_[a : a + 13]) in windows:
                hit |= set(range(a, a + 13))
                found |= windows[tuple(own_[a : a + 13])]
        names = sorted({(str(items[k][0]).replace("None", "null"), items[k][0] is None) for k in found})
        want.append((i, len(own_), len(hit), [n for n, _ in names]))
    got = decontaminate.decontaminate(df, bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    clean = decontaminate.without_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in want)
    assert decontaminate.without_contaminated(df, bench.where("false")).count() == len(docs)


def left_lines(texts: dict, run: int, words: int | None) -> dict:
    """Texts by id, without later repeats of ``run`` lines, or of fewer with enough words."""
    seen, out = set(), {}
    for i in sorted(texts):
        own, gone = texts[i].split("\n"), set()
        for size in [run, *(range(1, run) if words else ())]:
            for p in range(len(own) - size + 1):
                w = tuple(own[p : p + size])
                if size == run or sum(len([x for x in re.split(BLANK, line) if x]) for line in w) >= words:
                    gone |= set(range(p, p + size)) if w in seen else set()
                    seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


@pytest.mark.parametrize("words", [None, 6])
def test_lines_by_brute_force(spark, words):
    rng = random.Random(9)
    pool = ["", "a", "b c", "one two three", "one two three four five six seven", "x y z u v w", "long " * 40]
    texts = {k: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for k in range(250)} | {900: "\n".join(["", "a"] * 4_000)}
    df = frame(spark, [(i, t, 1, "g") for i, t in texts.items()] + [(3, texts[3], 1, "g"), (950, None, 1, "g")], "doc_id long, text string, n_chars int, gone string").repartition(5)
    got = lines.line_dedup(df, words=words, marks="gone")
    want = left_lines(texts, 3, words) | {950: None}
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "n_chars", "gone"] and len(rows) == len(texts) + 2
    assert all(r.text == want[r.doc_id] for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if r.gone)


@pytest.mark.parametrize("kinds", [1, 7, 4_000])
def test_in_blocks(spark, kinds):
    """Groups beyond a block: all that link meet, whatever the number of components, and no cell is larger than two blocks."""
    members = spark.range(6_000).selectExpr("explode(array(2L, 3L + id div 5000, 9L + 2 * (id div 3))) as group", "id * 31 as own")
    sizes = []

    def link(rows):
        sizes.append(rows.groupBy("cell").count().agg(F.max("count")).first()[0])
        kind = rows.withColumn("kind", F.col("own") % kinds)
        least = kind.groupBy("cell", "kind").agg(F.min("own").alias("b"))
        return kind.join(least, ["cell", "kind"]).select(F.col("own").alias("a"), "b")

    got = {r.node: r.component for r in simhash.in_blocks(members, link).collect()}
    want = {}
    for own in range(0, 6_000 * 31, 31):
        want.setdefault(own % kinds, own)
    assert all(got.get(own, own) == want[own % kinds] for own in range(0, 6_000 * 31, 31))
    assert len(sizes) == (1 if kinds == 1 else 2) and max(sizes) <= 2.5 * simhash.BLOCK


def test_similar_groups_beyond_a_block(spark):
    """Near copies, more of them than a block holds, and others that share bands with them, fall into their own groups."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    short = [f"s{k}" for k in range(8)]
    rows = [(k, " ".join([*base[: k % 60], f"x{k}", *base[k % 60 + 1 :]])) for k in range(1_200)]
    rows += [(10_000 + k, " ".join([*short, f"y{k}", f"z{k % 600}"])) for k in range(1_200)]  # one shingle of six in common, or more
    got = {r.id: r.first_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if root(i) != root(j) and jaccard(a, sets[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert got == {rows[k][0]: rows[root(k)][0] for k in range(len(rows))}


def test_large_documents_are_balanced(spark):
    """A document far larger than the others doesn't throw its source off its target."""
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(50, 800), "a") for k in range(500)] + [(500, "w " * 20_000, "a")] + [(k, "w " * 300, "b") for k in range(501, 900)]
    got = mixing.mix_sources(frame(spark, rows, "doc_id long, text string, source string")).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.002 * r.target for r in got)


def test_checkpoint_folder_is_asked_for(spark, monkeypatch):
    class Away:
        def __init__(self, spark):
            self.sparkContext, self.conf = self, self

        master, getCheckpointDir, get = "spark://host:7077", lambda self: None, lambda self, *a: None

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Away(spark))


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline_by_definition(spark):
    """The pipeline's rows from its definition: letters, line runs, Jaccard similarity of five-word shingles, benchmark windows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and any(map(str.isalpha, r.text))}
    text = left_lines(docs, 3, 50)
    shingles = {}
    for i, t in text.items():
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) if x]
        shingles[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in text}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in combinations(sorted(text), 2):
        if jaccard(shingles[a], shingles[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    windows = set()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text or "")
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    want = set()
    for i, t in text.items():
        w = words(t)
        hit = {q for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for q in range(k, k + n)}
        if find(i) == i and not (hit and 20 * len(hit) >= len(w)):
            want.add(i)
    assert set(got) == want
    assert all(r.size == len([x for x in re.split(BLANK, text[i]) if x]) and 0 <= r.taken <= 3 * r.size for i, r in got.items())
