"""Deletion of repeated line runs by winnowing over line hashes.

In every run of ``run`` consecutive lines the one with the smallest hash (rightmost of equals) is selected, so two
equal runs select the same line at the same place. There is one row for each selected position; it carries the hashes
of the lines before and after that its runs reach. Positions are joined on the selected line's hash, and only those that
meet a partner are extended both ways over the hashes they carry. Of equal runs all but the first are deleted;
overlapping ones add up to runs of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, documents

WORD = r"[^\x20\x09-\x0D]+"


def selected_positions(rows: DataFrame, size: int, words: int) -> DataFrame:
    """id, th, size, hash, first and around for each selected position of runs of ``size`` lines that hold at least ``words`` words.

    rows: id, th, hashes and, with ``words``, counts (of words) of each line. hash is that of the selected line, first the
    start of the first run that selects it, around the hashes of all lines of its runs.
    """
    at = lambda name, k: F.get(F.col(name), k)

    def mark(s: Column) -> Column:
        """The selected line of the run that starts at s; -1: the run doesn't count."""
        own = [at("hashes", s + k) for k in range(size)]
        least, place = F.least(*own) if size > 1 else own[0], s + (size - 1)
        for k in range(size - 2, -1, -1):  # the rightmost of equals
            later = [own[j] == least for j in range(k + 1, size)]
            place = F.when((own[k] == least) & ~any_of(later), s + k).otherwise(place)
        return F.when(sum((at("counts", s + k) for k in range(1, size)), at("counts", s)) >= words, place).otherwise(-1) if words else place

    marked = rows.where(F.size("hashes") >= size).withColumn("marks", F.transform(F.sequence(F.lit(0), F.size("hashes") - size), mark))
    new = F.filter(F.sequence(F.lit(0), F.size("marks") - 1), lambda s: (at("marks", s) >= 0) & ((s == 0) | (at("marks", s) != F.coalesce(at("marks", s - 1), F.lit(-1)))))

    def position(s: Column) -> Column:
        own, last, open_ = at("marks", s), s, F.lit(True)
        for k in range(1, size):
            open_ = open_ & F.coalesce(at("marks", s + k) == own, F.lit(False))
            last = F.when(open_, s + k).otherwise(last)
        return F.struct(at("hashes", own).alias("hash"), s.alias("first"), F.slice("hashes", s + 1, last - s + size).alias("around"))

    return marked.select("id", "th", F.lit(size).alias("size"), F.explode(F.transform(new, position)).alias("p")).select("id", "th", "size", "p.*")


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def repeated_lines(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """id, th and gone (places of lines in later repeats of a run, from 0, sorted) of each document that has any."""
    split = F.split("text", "\n", -1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), split.alias("lines"))
    rows = rows.select("id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), *([F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("counts")] if words else []))
    positions = selected_positions(rows, run, 0)
    for size in range(1, run) if words else ():
        positions = positions.unionByName(selected_positions(rows, size, words))
    positions = cut(positions)
    # What joins the positions is written first: Spark can then split the rows of a very common line or run.
    met = cut(positions.groupBy("size", "hash").agg(F.count("*").alias("n")).where("n > 1").select("size", "hash"))
    # Extension: each run of a position that met another is spelled as the hashes of its lines; equal spelling, equal run.
    extended = positions.join(met, ["size", "hash"]).select("id", "th", "size", "first", "around", F.explode(F.expr("sequence(0, size(around) - size)")).alias("k"))
    extended = extended.select("id", "th", "size", (F.col("first") + F.col("k")).alias("start"), F.slice("around", F.col("k") + 1, F.col("size")).alias("content"))
    first = cut(extended.groupBy("content").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first"))
    later = extended.join(first, "content").where(F.struct("id", "th", "start") > F.col("first"))
    gone = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("size") - 1)))
    return later.groupBy("id", "th").agg(F.array_sort(F.array_distinct(gone)).alias("gone"))


def line_dedup(docs: DataFrame, run: int = 3, words: int | None = None, marks: str | None = None) -> DataFrame:
    """docs without later repeats of ``run`` or more consecutive lines; text and, where it exists, n_chars change.

    A line goes if it lies in ``run`` lines that also start earlier, in a smaller doc_id (null last) or before in the
    document; lines are judged on the input. With ``words``, fewer lines are a run too if they hold that many words
    together. Documents without such a run stay as they are, null text stays null, an empty table stays empty. Rows that repeat a doc_id with one text
    are one document; with several texts, several, ordered by a hash of the text. All other columns are kept. With
    ``marks``, a column of that name (one that docs has is replaced) names the places of the lines that went.

    Lines are compared by 64-bit hashes, so runs of three agree in 192 bits.
    """
    found = repeated_lines(docs, run, words).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    joined = docs.join(found, on, "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    # What stays lies between lines that go: slices, in proportion to the text.
    before = lambda k: F.when(k == 0, -1).otherwise(F.get(F.col("__gone"), k - 1))
    after = lambda k: F.coalesce(F.get(F.col("__gone"), k), F.size("__lines"))
    kept = F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda k: F.slice("__lines", before(k) + 2, after(k) - before(k) - 1))
    changed = F.col("__gone").isNotNull()
    out = joined.withColumn("__text", F.when(changed, F.array_join(F.flatten(kept), "\n")).otherwise(F.col("text")))
    columns = [F.col("__text").alias("text") if c == "text" else F.when(changed, F.length("__text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes if c != marks]
    return out.select(*columns, *([F.coalesce("__gone", F.expr("cast(array() as array<int>)")).alias(marks)] if marks else []))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = line_dedup(docs.select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("lines")), marks="gone")
    return done.select(
        "doc_id",
        F.coalesce(F.when(F.col("text").isNotNull(), F.col("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: Every window of three lines against its first occurrence.
SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls, text is null as none from documents),
w as (select doc_id, p, array_to_string(ls[p : p + 2], chr(10)) as content from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as p from d where len(ls) >= 3)),
f as (select *, row_number() over (partition by content order by doc_id, p) as nth from w),
gone as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 3)) as q from f where nth > 1)),
l as (select doc_id, unnest(range(1, len(ls) + 1)) as q, unnest(ls) as line from d),
kept as (select l.doc_id, string_agg(line, chr(10) order by l.q) as text from l left join gone on l.doc_id = gone.doc_id and l.q = gone.q where gone.q is null group by l.doc_id)
select d.doc_id, case when none then 0 else len(ls) end as n_lines, coalesce(g.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
"""
