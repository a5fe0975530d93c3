"""License scans with ordered signature rules, in SQL functions alone.

A text is reduced to lower-case words parted by single blanks. A rule has a regex over such words, words that must
occur before the regex is tried (whatever the regex matches holds them), a rank and a confidence. Detections keep their place; one that lies within another is
dropped if the other is longer, or equally long and of higher rank.
"""

from __future__ import annotations

import json
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are counted at every place, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Rule(NamedTuple):
    label: str
    regex: str  # over words; it matches whole words, see matched()
    needs: tuple[str, ...]  # the gate: of each entry's alternatives, parted by |, one must occur as a word
    rank: int
    confidence: float


LICENSE = r"licen[cs]es?"
LICENSES = "license|licence|licenses|licences"
UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:for use )?under (?:the (?:terms of )?(?:the )?|an? )?"
#: Families that are named by a phrase and a version: label, phrase, a word it needs, versions; a short name says as much as the phrase and "license".
VERSIONED = [
    ("apache", r"apache (?:software )?", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", r"(?:mozilla public|mpl) ", "mozilla|mpl", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public ", "eclipse", ("1.0", "2.0")),
    ("cddl", r"common development and distribution ", "development", ("1.0", "1.1")),
    ("afl", r"academic free ", "academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", r"open software ", "software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("eupl", r"european union public ", "european", ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic ", "artistic", ("1.0", "2.0")),
    ("ofl", r"(?:sil )?open font ", "font", ("1.0", "1.1")),
    ("lppl", r"latex project public ", "latex", ("1.0", "1.1", "1.2", "1.3")),
    ("cecill", r"cecill (?:free software )?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("php", r"php ", "php", ("3.0", "3.01")),
    ("zpl", r"zope public ", "zope", ("1.1", "2.0", "2.1")),
    ("bsl", r"boost (?:software )?", "boost", ("1.0",)),
    ("elastic", r"elastic ", "elastic", ("1.0", "2.0")),
    ("sspl", r"server side public ", "server", ("1.0",)),
    ("busl", r"business source ", "business", ("1.0", "1.1")),
    ("apsl", r"apple public source ", "apple", ("1.0", "1.1", "1.2", "2.0")),
    ("rpl", r"reciprocal public ", "reciprocal", ("1.1", "1.5")),
    ("spl", r"sun public ", "sun", ("1.0",)),
    ("qpl", r"q public ", "q", ("1.0",)),
    ("ipl", r"ibm public ", "ibm", ("1.0",)),
    ("cpl", r"common public ", "common", ("1.0",)),
    ("cpal", r"common public attribution ", "attribution", ("1.0",)),
    ("upl", r"universal permissive ", "permissive", ("1.0",)),
    ("odbl", r"open database ", "database", ("1.0",)),
    ("odc-by", r"open data commons attribution ", "commons", ("1.0",)),
    ("cc0", r"(?:cc0|creative commons zero) (?:universal )?", "cc0|zero", ("1.0",)),
]
SHORT = ("mpl", "epl", "cddl", "afl", "osl", "eupl", "ofl", "lppl", "cecill", "zpl", "bsl", "sspl", "busl", "apsl", "rpl", "qpl", "ipl", "cpl", "cpal", "upl", "odbl", "cc0")
#: Families with one text: label, phrase.
NAMED = [
    ("mit", r"mit", "mit"), ("mit-0", r"mit no attribution", "attribution"), ("x11", r"x11", "x11"), ("isc", r"isc", "isc"), ("zlib", r"zlib", "zlib"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd|freebsd"), ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"), ("bsd", r"bsd(?: style)?", "bsd"), ("0bsd", r"(?:0bsd|bsd zero clause)", "0bsd|zero"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa"), ("postgresql", r"postgresql", "postgresql"), ("python", r"(?:python software foundation|psf)", "python|psf"),
    ("ruby", r"ruby", "ruby"), ("perl", r"same terms as perl(?: itself)?", "perl"), ("openssl", r"openssl", "openssl"), ("vim", r"vim", "vim"), ("json", r"json", "json"),
    ("w3c", r"w3c (?:software(?: notice)?)", "w3c"), ("unicode", r"unicode", "unicode"), ("beerware", r"beer ?ware", "beerware|beer"), ("ms-pl", r"microsoft public", "microsoft"),
    ("ms-rl", r"microsoft reciprocal", "reciprocal"), ("curl", r"curl", "curl"), ("libpng", r"libpng", "libpng"), ("ijg", r"independent jpeg group", "jpeg"),
    ("naist", r"nara institute of science", "nara"), ("sleepycat", r"sleepycat", "sleepycat"), ("tcl", r"tcl tk", "tcl"), ("xfree86", r"xfree86", "xfree86"),
]
#: Sentences that belong to a license's own text: label, regex, needed words.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation", ("hereby", "obtaining")),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", ("above", "notice")),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby", "fee")),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary")),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse", ("neither", "endorse")),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", ("advertising", "mentioning")),
    ("apache-2.0", r"you may not use this file except in compliance with the license", ("compliance", "except")),
    ("apache-2.0", r"www apache org licenses license 2 0", ("apache", "licenses")),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute", "gnu")),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ("redistribute", "gnu")),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", ("redistribute", "affero")),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "subject")),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("warranty", "authors")),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered", "domain")),
    ("unlicense", r"(?:the )?unlicense", ("unlicense",)),
    ("wtfpl", r"do what the f\w+ you want to(?: public license)?", ("want", "what")),
    ("wtfpl", r"wtfpl", ("wtfpl",)),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", ("public", "domain")),
    ("public-domain", r"public domain dedication", ("dedication", "domain")),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy", ("hereby", "organization")),
    ("warranty-disclaimer", r"(?:provided|distributed) (?:on an )?as is (?:basis )?without warranty", ("warranty", "without")),
    ("warranty-disclaimer", r"(?:provided|distributed) (?:on an )?as is (?:basis )?without warranties", ("warranties", "without")),
    ("warranty-disclaimer", r"without (?:even the implied|any) warranty", ("warranty",)),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", ("copyright",)),
    ("copyright", r"(?:c|copr) (?:19|20)[0-9]{2} all rights reserved", ("reserved", "rights")),
    ("reserved", r"all rights reserved", ("reserved", "rights")),
    ("reserved", r"some rights reserved", ("reserved", "some")),
    ("proprietary", r"proprietary and confidential", ("proprietary", "confidential")),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:.{0,60}? )?(?:strictly )?prohibited", ("prohibited",)),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed) without (?:prior |express )?(?:written )?permission", ("permission", "may")),
    ("commons-clause", r"commons clause(?: license condition)?", ("commons", "clause")),
    ("non-commercial", r"(?:for )?non ?commercial use only", ("only", "use")),
    ("fair-use", r"fair use (?:notice|doctrine)", ("fair", "use")),
    ("see-license", r"see (?:the )?(?:accompanying )?license (?:file|txt|md)", ("license", "see")),
    ("unknown-license", UNDER + r"(?:\w+ ){0,4}?license", ("license", "under")),
    ("unknown-license", UNDER + r"(?:\w+ ){0,4}?licence", ("licence", "under")),
]
CREATIVE = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?derivatives", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?derivatives"}
GNU = {"gpl": "", "lgpl": "(?:lesser|library) ", "agpl": "affero ", "fdl": "free documentation"}


def spoken(version: str) -> str:
    return version.replace(".", " ")


def rules() -> list[Rule]:
    """All rules, most specific first; ranks fall in that order."""
    found: list[tuple[str, str, tuple[str, ...], float]] = []
    add = lambda label, regex, needs, confidence: found.append((label, regex, needs, confidence))
    identifiers = [f"{label}-{v}" for label, _, _, versions in VERSIONED for v in versions] + [label for label, *_ in NAMED]
    identifiers += [f"{g}-{v}-{x}" for g, v, x in product(("gpl", "lgpl", "agpl"), ("1.0", "2.0", "2.1", "3.0"), ("only", "or-later"))]
    identifiers += [f"cc-{p.replace(' ', '-')}-{v}" for p, v in product(CREATIVE, ("1.0", "2.0", "2.5", "3.0", "4.0"))]
    for name in identifiers:
        add(name, "spdx license identifier " + name.replace("-", " ").replace(".", " "), ("spdx", "identifier"), 1.0)
    for parts, version in product(CREATIVE, ("1.0", "2.0", "2.5", "3.0", "4.0")):
        label = f"cc-{parts.replace(' ', '-')}-{version}"
        for name, need in (("cc", "cc"), ("creative commons", "creative")):
            add(label, f"(?:{UNDER})?{name} {parts} (?:international |unported )?(?:{LICENSE} )?(?:version |v )?{spoken(version)}", (need, parts.split()[-1]), 0.95)
        add(label, f"(?:{UNDER})?creative commons {CREATIVE[parts]} (?:{LICENSE} )?(?:version |v )?{spoken(version)}(?: international| unported| generic)?(?: {LICENSE})?", ("creative", "commons"), 0.95)
        add(label, f"creativecommons org licenses {parts} {spoken(version)}", ("creativecommons",), 1.0)
    for parts in CREATIVE:
        add(f"cc-{parts.replace(' ', '-')}", f"(?:{UNDER})?cc {parts}", ("cc", "by"), 0.7)
    for label, version, later in product(GNU, ("1", "2", "2.1", "3"), (True, False)):
        name = f"(?:gnu )?{GNU[label]}" + ("" if label == "fdl" else "general public ") + (" " if label == "fdl" else "") + LICENSE
        tail = r" (?:version |v |v)?" + spoken(version) + (r"(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?" if later else r"(?: 0)?(?: only)?")
        add(f"{label}-{version}" + ("-or-later" if later else ""), f"(?:{UNDER})?{name}{tail}", ("documentation" if label == "fdl" else "general", "public" if label != "fdl" else "free"), 0.95)
        first = version[0]
        add(f"{label}-{version}" + ("-or-later" if later else ""), f"(?:{UNDER})?(?:gnu )?{label}(?: version | v | v|v| )?{spoken(version)}" + (r"(?: 0)? or (?:any )?later" if later else "(?: 0)?(?: only)?"), (f"{label}|{label}v{first}|{label}{first}",), 0.9)
    for label in GNU:
        name = f"(?:gnu )?{GNU[label]}" + ("" if label == "fdl" else "general public ") + (" " if label == "fdl" else "") + LICENSE
        add(label, f"(?:{UNDER})?{name}", ("documentation" if label == "fdl" else "general",), 0.8)
        add(label, f"{UNDER}(?:gnu )?{label}", (label, "under"), 0.8)
    for label, phrase, need, versions in VERSIONED:
        for version in versions:
            number, digits = rf"(?:version |v |v)?{spoken(version)}", f"{version.split('.')[0]}|v{version.split('.')[0]}"
            add(f"{label}-{version}", f"(?:{UNDER})?(?:the )?{phrase}{LICENSE} {number}", (need, LICENSES, digits), 0.95)
            add(f"{label}-{version}", f"(?:{UNDER})?(?:the )?{phrase}{number} {LICENSE}", (need, LICENSES, digits), 0.95)
            add(f"{label}-{version}", f"{UNDER}(?:the )?{phrase}{number}", (need, "under", digits), 0.95)
            if label in SHORT:
                add(f"{label}-{version}", f"(?:{UNDER})?(?:the )?{label} {number}", (label, digits), 0.9)
        add(label, f"(?:{UNDER})?(?:the )?{phrase}{LICENSE}", (need, LICENSES), 0.8)
    for label, phrase, need in NAMED:
        for word in ("license", "licence"):
            add(label, f"{UNDER}{phrase} {word}", (word, need, "under"), 0.9)
            add(label, f"(?:the )?{phrase} {word}", (word, need), 0.8)
    for label, regex, needs in TEXTS:
        add(label, regex, needs, 0.6 if label in ("unknown-license", "see-license", "warranty-disclaimer", "copyright") else 0.9)
    return [Rule(label, regex, needs, len(found) - k, confidence) for k, (label, regex, needs, confidence) in enumerate(found)]


def spaced(text: Column) -> Column:
    """Lower-case words, one blank before and after each. Letters beyond ASCII are lowered too, which parts no words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " ")), F.lit(" "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_hits(words: Column) -> tuple[Column, Column]:
    """What matched of BASE, in order, and the words of the text split there; places follow from the pieces."""
    pattern = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    return F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), F.split(words, pattern, -1)


def let(value: Column, body) -> Column:
    """body(value), where value is computed once, however often body uses it, within a function's argument too."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join, block: int = 128) -> Column:
    """What join() makes of all values before each one, from 0 on.

    Arrays are copied as they grow, so they grow by blocks: first a value for each block, then the values within. A text's
    time stays about in proportion to its matches.
    """
    zero = F.lit(0).cast("long")
    grown = lambda start, part: F.aggregate(part, F.array(start), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x))))

    def of(v: Column) -> Column:
        part = lambda k: F.slice(v, k * block + 1, block)
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / block) - 1, F.lit(0)).cast("int"))
        starts = grown(zero, F.transform(parts, lambda k: F.aggregate(part(k), zero, join)))
        return F.flatten(let(starts, lambda s: F.transform(parts, lambda k: F.slice(grown(F.get(s, k), part(k)), F.lit(1), F.size(part(k))))))

    return let(values, of)


def places(matches: Column, pieces: Column, make) -> Column:
    """make(start, end) for each match, in characters, from what stands between matches."""
    size = lambda x: F.length(x).cast("long")
    sizes = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(size(p).alias("piece"), size(m).alias("match")))

    def of(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["piece"] + x["match"]), lambda x, y: x + y)
        return F.zip_with(s, before, lambda x, b: make(F.struct((b + x["piece"]).alias("start"), (b + x["piece"] + x["match"]).alias("end"))))

    return let(sizes, of)


def unmatched_within(found: Column) -> Column:
    """Detections that lie within no other one, and of equal ones that of the highest rank, by place."""
    keyed = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), (-d["rank"]).alias("rank"), d.alias("d")))

    def of(ordered: Column) -> Column:  # whatever contains a detection stands before it
        reach = running(F.transform(ordered, lambda x: -x["end"]), lambda x, y: F.greatest(x, y))
        return F.filter(F.zip_with(ordered, reach, lambda x, r: F.when(r < -x["end"], x["d"])), lambda d: d.isNotNull())

    return let(F.array_sort(keyed), of)


def license_scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections (start, end, label, rank, confidence) of each row.

    Null text is empty. first_word and last_word are null where no base phrase stands. Places in detections are
    characters of the spaced words. score: the highest confidence among what is left, 1 with a base phrase's label
    alone; 0 without labels. Rows that repeat a document are treated one by one; other columns are ignored.
    """
    table = rules() if table is None else table
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.coalesce("text", F.lit(""))).alias("w"))
    needs = sorted({n for r in table for n in r.needs[0].split("|")})
    rows = [{"label": r.label, "regex": f"(?<= )(?:{r.regex})(?= )", "needs": [[f" {n} " for n in alternatives.split("|")] for alternatives in r.needs], "rank": r.rank, "confidence": r.confidence} for r in table]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,regex:string,needs:array<array<string>>,rank:int,confidence:double>>")
    first = F.filter(F.array(*(F.lit(f" {n} ") for n in needs)), lambda n: F.contains(F.col("w"), n))

    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,rank:int,confidence:double>>")

    def detected(r: Column) -> Column:
        matches, pieces = F.regexp_extract_all("w", r["regex"], F.lit(0)), F.split("w", r["regex"], -1)
        found = let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(places(m, pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["label"].alias("label"), r["rank"].alias("rank"), r["confidence"].alias("confidence")))))
        return found

    tried = F.filter(literal, lambda r: F.arrays_overlap(F.col("gate"), r["needs"][0]) & F.forall(F.slice(r["needs"], 2, 9), lambda any_: F.exists(any_, lambda n: F.contains(F.col("w"), n))))
    out = words.withColumn("gate", first)
    out = out.withColumn("raw", F.when(F.size("gate") > 0, F.flatten(F.transform(tried, detected))).otherwise(none))
    out = out.withColumn("detections", F.when(F.size("raw") > 1, unmatched_within(F.col("raw"))).otherwise(F.col("raw")))
    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | F.contains("w", F.lit(f" {phrase} "))
    matches, pieces = base_hits(F.col("w"))
    out = out.withColumn("m", F.when(any_base, matches).otherwise(F.array().cast("array<string>"))).withColumn("p", F.when(any_base, pieces).otherwise(F.array().cast("array<string>")))
    n_words = F.greatest(blanks(F.col("w")) - 1, F.lit(0))
    n_words = F.when(F.trim("w") == "", F.lit(0)).otherwise(n_words)
    hit = F.size("m") > 0
    last = F.element_at("m", -1)
    label = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    base_labels = F.array_sort(F.array_distinct(F.transform("m", lambda x: label[x])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.size("m").cast("long").alias("n_base"),
        F.when(hit, blanks(F.element_at("p", 1)) - 1).cast("long").alias("first_word"),
        F.when(hit, n_words - (blanks(F.element_at("p", -1)) - 1) - (blanks(last) + 1)).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "detections",
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("detections")
