"""Mixing sources to target weights by the cube method.

Every document starts with a fractional expected number of copies; whole copies are taken, the fraction is an
inclusion probability. Documents too large for a landing are settled first, against all others. The flight phase moves probabilities along directions that keep both balances - words and
documents - until each task's lot has at most about LAST fractions left; leftovers are flown again together, and the few of
a source that remain are landed by the choice nearest to both balances.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, shuffle_partitions

WEIGHTS = (5, 2, 1)
LAST = 14  # fractions that one landing settles
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """no_source, source_key, source_size, target for each source.

    Weights repeat over the sources by code point, null last. The total of all sizes is shared by weight; a source
    takes at most ``most`` times its size, and the excess goes to the others by weight. With sources ordered by
    size / weight those that stop come first, so running sums give the level at which the rest share.
    The windows run over one row a source, never over documents.
    """
    by = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy("no_source", "source_key")) - 1) % len(weights) + 1))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source_key")
    before, after, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level).withColumn("stops", most * F.col("source_size") < F.col("level") * F.col("weight"))
    share = F.coalesce(F.max(F.when(~F.col("stops"), F.col("level"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0))
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    target = F.when(F.col("stops"), most * F.col("source_size").cast("double")).otherwise(F.coalesce(first, share) * F.col("weight"))
    return by.select("no_source", "source_key", "source_size", "n", F.least(target, most * F.col("source_size").cast("double")).alias("target"))


def flight(sizes: list[float], p: list[float], rng: random.Random) -> None:
    """Moves p until at most two places are neither 0 nor 1. Sums of p and of p * size stay."""
    near = 1e-9
    live: list[int] = []
    for k in range(len(p)):
        if p[k] <= near or p[k] >= 1 - near:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, x in zip(live, u, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
                elif x < 0:
                    up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(live, u, strict=True):
                p[i] = min(1.0, max(0.0, p[i] + step * x))
                if p[i] <= near or p[i] >= 1 - near:
                    p[i] = float(round(p[i]))
            live = [i for i in live if 0 < p[i] < 1]


def settle_large(sizes: np.ndarray, p: np.ndarray, limit: float, rng: random.Random) -> None:
    """Moves p of documents beyond ``limit`` words, which no landing could balance, to 0 or 1, all smaller ones in the other direction.

    Each step lies in the null-space of both balances and goes on until some p is 0 or 1; if the smaller ones are all
    of one size, words alone are balanced.
    """
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] <= limit:
            break
        while 0 < p[k] < 1:
            live = np.flatnonzero((p > 0) & (p < 1) & (sizes <= limit))
            s = sizes[live]
            if len(live) < LAST or not s.any():
                break
            if s.min() < s.max():
                slope = -(sizes[k] - s.mean()) / ((s - s.mean()) ** 2).sum()
                move = slope * (s - s.mean()) - 1 / len(s)
            else:
                move = np.full(len(s), -sizes[k] / s.sum())
            move, own = np.append(move, 1.0), np.append(live, k)
            with np.errstate(divide="ignore"):
                up = np.where(move > 0, (1 - p[own]) / move, np.where(move < 0, p[own] / -move, np.inf)).min()
                down = np.where(move > 0, p[own] / move, np.where(move < 0, (1 - p[own]) / -move, np.inf)).min()
            moved = p[own] + (up if rng.random() * (up + down) < down else -down) * move
            p[own] = np.where(moved < 1e-9, 0.0, np.where(moved > 1 - 1e-9, 1.0, moved))


def landing(sizes: np.ndarray, p: np.ndarray) -> None:
    """Sets the last fractions (at most about LAST of them) to the 0s and 1s that come nearest to their words and documents."""
    live = np.flatnonzero((p > 0) & (p < 1))
    if len(live):
        choices = (np.arange(2 ** len(live))[:, None] >> np.arange(len(live))) & 1
        words = np.abs(choices @ sizes[live] - p[live] @ sizes[live])
        many = np.abs(choices.sum(axis=1) - p[live].sum())
        p[live] = choices[np.argmin(words + 0.02 * sizes[live].mean() * many)]


def lot_flight(land: bool):
    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["place", "doc_id", "size"], kind="stable", ignore_index=True)
        sizes, p = lot["size"].to_numpy(float), lot["p"].to_numpy(float).copy()
        rng = random.Random(int(lot["place"].iloc[0]) ^ len(lot))
        # Documents of all sizes stay for the landing, so that it can come near.
        stay = np.argsort(sizes, kind="stable")[np.unique(np.linspace(0, len(lot) - 1, LAST - 2).astype(int))]
        settle_large(sizes, p, sizes[stay[:-1]].sum(), rng)
        fly = np.setdiff1d(np.arange(len(lot)), stay)
        flown = p[fly].tolist()
        flight(sizes[fly].tolist(), flown, rng)
        p[fly] = flown
        if land:
            landing(sizes, p)
        lot["p"] = p
        return lot

    return run


def lot_of(run):
    return lambda lot: run(lot.drop(columns="lot"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, lot: int = 2_000) -> DataFrame:
    """doc_id, size (words), source_size, target (its source's) and taken (words the mix takes, repeats counted) of each row.

    Null text has size 0 and null source is a source of its own; rows that repeat a document are taken one by one.
    Lots are formed by a hash of doc_id and size, so that reruns agree; a source with more documents has more lots,
    and none meets in one task. A lot holds 10 * LAST documents at least. Other columns are ignored.
    """
    if lot < 10 * LAST:
        raise ValueError(f"lot must be {10 * LAST} at least: each leaves about {LAST} documents to the next flight")
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
    )
    sized = cut(sized)
    targets = cut(source_targets(sized, weights, most))
    largest = targets.agg(F.max("n")).first()[0] or 0
    rows = sized.join(targets, ["no_source", "source_key"])
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    place = F.xxhash64("doc_id", "size")
    rows = rows.select("*", F.floor(times).alias("whole"), (times - F.floor(times)).alias("p"), place.alias("place"))
    schema = "no_source boolean, source_key string, doc_id long, size long, source_size long, n long, target double, whole long, p double, place long"
    rows = rows.select(*(x.split()[0] for x in schema.split(", ")))
    settled = []
    while True:
        last = largest <= lot
        lots = F.pmod(F.xxhash64("place"), F.ceil(F.col("n") / lot))
        # Dealt by lot: else Spark keeps the join's partitions by source, and a hot source's lots meet in one task.
        dealt = rows.withColumn("lot", lots).repartition(shuffle_partitions(spark), "no_source", "source_key", "lot")
        rows = cut(dealt.groupBy("no_source", "source_key", "lot").applyInPandas(lot_of(lot_flight(last)), schema))
        if last:
            settled.append(rows)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(rows.where(~open_))
        left = rows.where(open_)
        counts = left.groupBy("no_source", "source_key").agg(F.count("*").alias("n"))
        rows = left.drop("n").join(counts, ["no_source", "source_key"]).select(*(x.split()[0] for x in schema.split(", ")))
        largest = counts.agg(F.max("n")).first()[0] or 0
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
