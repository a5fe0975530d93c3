"""Scalar text functions, Column to Column, inside the JVM (html_unescape and highlight_names apart)."""

from __future__ import annotations

import functools
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values

WORD = r"[\p{L}\p{N}_]"
NO_STRINGS = "cast(array() as array<string>)"


def quoted(term: str) -> str:
    """A term as a regex that Java, RE2 and Python read alike."""
    return re.sub(r"([^\w\s'’,-]|_)", r"\\\1", term)


def whole_word(term: str) -> str:
    """Java regex: the term, any case, not beside a word character (any letter, digit or underscore)."""
    return f"(?iu)(?<!{WORD}){quoted(term)}(?!{WORD})"


def strip_space(x: Column) -> Column:
    """All white space goes from both ends, not blanks alone."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rewrites() -> list[tuple[str, str, bool, list[str]]]:
    """The ordered term rewrites: pattern, new text, whether it is replaced as it stands, and the lower-case texts of which one must be in the input for it to match.

    That is the term, or a shorter one in it, or what is needed for an earlier rewrite whose new text could be a part of this term.
    """
    out = []
    for k, (old, new) in enumerate(values.TERM_REWRITES):
        plain, low = old in values.PLAIN_REWRITES, old.lower()
        needed = [min((t.lower() for t, _ in values.TERM_REWRITES if t.lower() in low), key=len)]
        for before, (_, made) in enumerate(values.TERM_REWRITES[:k]):
            made = made.lower()
            starts = [i for i in range(len(made)) if plain or i == 0 or not made[i - 1].isalnum()]
            meets = any(low.startswith(made[i:]) or made[i:].startswith(low) for i in starts) or any(low.startswith(made, i) or made.startswith(low[i:]) for i in range(len(low)))
            needed += out[before][3] if meets else []
        out.append((old if plain else whole_word(old), new, plain, sorted(set(needed))))
    return out


#: Letters beside A-Z that a pattern without regard to case takes for one of a-z, and which.
FOLDED = ("ıİſ\u212a", "iisk")


def rewrite_terms(x: Column) -> Column:
    """The ordered term rewrites; whole words in any case, but for a few that are replaced as they stand.

    A text is searched only for the terms whose letters it holds; most hold none.
    """
    rules = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(plain).alias("plain"), F.array(*map(F.lit, needed)).alias("needed")) for old, new, plain, needed in rewrites()))
    one = lambda t, r: F.when(r["plain"], F.replace(t, r["old"], r["new"])).otherwise(F.regexp_replace(t, r["old"], r["new"]))
    parts = F.array(*map(F.lit, sorted({n for *_, needed in rewrites() for n in needed})))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  what f reads more than once is computed once
    held = bound(F.lower(F.translate(x, *FOLDED)), lambda low: F.filter(parts, lambda n: F.contains(low, n)))
    return F.aggregate(bound(held, lambda h: F.filter(rules, lambda r: F.arrays_overlap(r["needed"], h))), x, one)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"[\n\r]", " ")


def bold_parts(x: Column) -> Column:
    """Contents of <b> spans."""
    return F.regexp_extract_all(x, F.lit("(?is)<b>(.*?)</b>"), F.lit(1))


def clean_english(x: Column) -> Column:
    """What stands in bold, without tags, joined by blanks; without bold text, empty."""
    parts = F.transform(bold_parts(x), lambda p: strip_space(one_line(strip_tags(p))))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def bold_italics(x: Column) -> Column:
    """Lower-case words in italics within bold, less one closing mark, sorted and unique."""
    spans = F.flatten(F.transform(bold_parts(x), lambda p: F.regexp_extract_all(p, F.lit("(?is)<i>(.*?)</i>"), F.lit(1))))
    words = F.transform(spans, lambda w: F.lower(F.regexp_replace(strip_space(one_line(strip_tags(w))), "[.,;:!?]$", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def clean_other(x: Column) -> Column:
    return strip_space(one_line(strip_tags(x)))


def bold_text(x: Column) -> Column:
    """Contents of <b> and <strong> spans, whichever tag closes them, joined by blanks as they are."""
    return F.array_join(F.regexp_extract_all(x, F.lit("(?is)<(?:b|strong)>(.*?)</(?:b|strong)>"), F.lit(1)), " ")


def repair_diacritics(x: Column) -> Column:
    """A question mark within a word stands for ḥ, one that begins a lower-case word for Ḥ."""
    return F.regexp_replace(F.regexp_replace(x, "(?<=[A-Za-z])\\?(?=[A-Za-z])", "ḥ"), "(?<![A-Za-z])\\?(?=[a-z])", "Ḥ")


@F.pandas_udf(T.StringType())
def html_unescape(x: pd.Series) -> pd.Series:
    """All entities of HTML 5; there is no SQL function for them."""
    return x.map(html.unescape, na_action="ignore")


def unescape_closed(x: Column, names: dict[str, str]) -> Column:
    """References of these names that a semicolon ends; what is cut off before it stays as it is. An ampersand comes last, so that nothing is decoded twice."""
    return functools.reduce(lambda t, n: F.replace(t, F.lit(f"&{n};"), F.lit(names[n])), sorted(names, key=lambda n: n == "amp"), x)


def html_escape(x: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, x)


def strip_vowel_signs(x: Column) -> Column:
    return F.regexp_replace(x, values.VOWEL_SIGNS, "")


def sentences(x: Column) -> Column:
    """Sentences of pointed text without tags and vowel signs, stripped, none empty."""
    parts = F.split(strip_vowel_signs(strip_tags(x)), values.SENTENCE_ENDS, -1)
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def right_to_left(x: Column) -> Column:
    return F.concat(F.lit('<div dir="rtl">'), x, F.lit("</div>"))


def tag_value(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "^[.:, ]+|[.:, ]+$", "")


def has_term(text: Column, term: str) -> Column:
    return text.rlike(whole_word(term))


def markdown_escape(x: Column) -> Column:
    return F.regexp_replace(x, values.MARKDOWN_MARKS, r"\\$1")


def rewrite_display(x: Column) -> Column:
    """Display rewrites outside tags."""
    rewritten = lambda p: functools.reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), values.DISPLAY_REWRITES, p)
    parts = F.regexp_extract_all(x, F.lit("<[^>]+>|<|[^<]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<"), p).otherwise(rewritten(p))), "")


@F.pandas_udf(T.StringType())
def highlight_name(htmls: pd.Series, names: pd.Series) -> pd.Series:
    """The name, any case, marked in the text of bold spans; tags within them stay as they are."""
    bold, tag = re.compile(r"<(b|strong)>(.*?)</\1>", re.I | re.S), re.compile(r"(<[^>]+>)")
    out = []
    for text, name in zip(htmls, names, strict=True):
        if text is None or not name:
            out.append(text)
            continue
        found = re.compile(re.escape(name), re.I)

        def marked(m, found=found):
            inner = "".join(p if k % 2 else found.sub(lambda x: f"<mark>{x.group()}</mark>", p) for k, p in enumerate(tag.split(m.group(2))))
            return f"{m.group()[: m.start(2) - m.start()]}{inner}</{m.group(1)}>"

        out.append(bold.sub(marked, text))
    return pd.Series(out, dtype=object)


LOCATION = r"^(.+?)\s+(\d+[ab]):(\d+)$"


def reader_url(location: Column, base: str) -> Column:
    """base/work/page#section-n of "Work 2a:1"; null for other forms."""
    part = lambda k: F.regexp_extract(location, LOCATION, k)
    url = F.concat(F.lit(f"{base}/"), F.replace(F.lower(part(1)), F.lit(" "), F.lit("-")), F.lit("/"), part(2), F.lit("#section-"), part(3))
    return F.when(location.rlike(LOCATION), url)


def page_of(location: Column) -> Column:
    """What stands before the last colon."""
    return F.regexp_replace(location, ":[^:]*$", "")


def page_link(page: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}/"), F.replace(page, F.lit(" "), F.lit(".")))


def page_sort_key(page: Column) -> Column:
    """(work, number, side); what has no page number: (itself, 0, "a")."""
    form = r"^(.+?)\s+(\d+)([ab])"
    known = page.rlike(form)
    return F.struct(
        F.when(known, F.regexp_extract(page, form, 1)).otherwise(page).alias("work"),
        F.when(known, F.regexp_extract(page, form, 2).cast("int")).otherwise(0).alias("number"),
        F.when(known, F.regexp_extract(page, form, 3)).otherwise("a").alias("side"),
    )


def letter_bucket(name: Column) -> Column:
    """The first letter in upper case; # for anything else."""
    first = F.upper(F.substring(name, 1, 1))
    return F.when(first.rlike(r"^\p{L}"), first).otherwise("#")


def wiki_title(url: Column) -> Column:
    """The title in a /wiki/ URL, decoded; other or broken URLs stay."""
    raw = F.regexp_extract(url, r"/wiki/([^#]*)", 1)
    plain = F.try_url_decode(F.replace(F.replace(raw, F.lit("+"), F.lit("%2B")), F.lit("_"), F.lit(" ")))
    return F.when(url.contains("/wiki/"), F.coalesce(plain, url)).otherwise(url)


def uri_component(x: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    pairs = [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.url_encode(x))


def search_url(x: Column, base: str) -> Column:
    return F.concat(F.lit(base), uri_component(x))


def shown_count(x: Column) -> Column:
    return F.when(x.isNull() | x.isin("", "0"), "-").otherwise(x)


def count_label(total: Column, shown: Column) -> Column:
    label = F.concat(total.cast("string"), F.when(total == 1, " total match").otherwise(" total matches"))
    return F.when(shown < total, F.concat(label, F.lit(", showing "), shown.cast("string"))).otherwise(label)


def parts_of(x: Column) -> Column:
    """Parts between semicolons, trimmed, none empty."""
    return F.filter(F.transform(F.split(x, ";", -1), strip_space), lambda p: p != "")


def natural_key(x: Column) -> Column:
    """Sorts without regard to case and accents, digit runs by value: by their length, which stands before them, then as they are."""
    plain = F.lower(F.translate(x, "ÁÀÂÄÃÅĀáàâäãåāÉÈÊËĒéèêëēÍÌÎÏĪíìîïīÓÒÔÖÕŌóòôöõōÚÙÛÜŪúùûüūÇçÑñḤḥṬṭṢṣẒẓ", "AAAAAAAaaaaaaaEEEEEeeeeeIIIIIiiiiiOOOOOOooooooUUUUUuuuuuCcNnHhTtSsZz"))
    parts = F.regexp_extract_all(plain, F.lit(r"\d+|\D+"), F.lit(0))
    digits = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.regexp_replace(p, "^0+(?=.)", "")).otherwise(p))
    return F.array_join(F.transform(digits, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(p).cast("string"), 10, "0"), p)).otherwise(p)), "")
