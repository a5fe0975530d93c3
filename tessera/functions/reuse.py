"""Tables that several branches of a plan read."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the session's checkpoint folder if it names one, else kept on the executors' disks, where a lost part is computed anew."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True) if sc.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def in_place(rows: DataFrame, column: str) -> DataFrame:
    """rows numbered from 1 as they stand: within each partition, and by what stands in the partitions before, one number each."""
    placed = once(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [(p, n) for (p, _), n in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)]
    known = rows.sparkSession.createDataFrame(starts, "__part long, __before long")  # as many rows as partitions
    return placed.join(F.broadcast(known), part == F.col("__part")).withColumn(column, F.col("__before") + within + 1).drop("__at", "__part", "__before")
