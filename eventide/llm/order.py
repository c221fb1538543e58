"""A total order of terms, the rarest first, from a table of fixed size.

Terms are counted by 2^22 hash buckets, and a bucket's count is kept as one byte (eight steps for each doubling), so the table has 4 MB
for any number of terms. Any total order gives right joins; where several terms share a bucket the order only takes them for more
frequent than they are. Equal counts are ordered by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, STEPS = 1 << 22, 8


def frequency_codes(records: DataFrame) -> np.ndarray:
    """The byte of each bucket, for the ``terms`` ARRAY<BIGINT> of ``records``; at most 2^22 rows come to the driver."""
    bucket = F.col("term").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    n = records.select(F.explode("terms").alias("term")).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    rows = n.select("bucket", F.least(F.ceil(F.log2("n") * STEPS), F.lit(255)).cast("short").alias("code")).toArrow()
    codes = np.zeros(BUCKETS, np.uint8)
    codes[rows.column("bucket").to_numpy()] = rows.column("code").to_numpy()
    return codes


def codes_of(codes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return codes[terms & (BUCKETS - 1)]


def code_above(n: int) -> int:
    """The least code that a bucket with more than ``n`` terms can have."""
    return int(min(255, np.ceil(np.log2(n) * STEPS)))


def dealt(entries: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``entries`` (cell, id, ...) with ``task`` and ``side``: a cell of more records than a task should hold becomes a triangle of blocks.

    ``hot`` are (cell, sides), one for each large cell. Records of block i and block j of a cell meet in the task (i, j); there, those with
    ``side`` 0 meet those with 1 only. Elsewhere ``side`` is -1.
    """
    if hot is None:
        return entries.withColumns({"task": F.col("cell"), "side": F.lit(-1).cast("byte")})
    sides = F.coalesce(F.col("sides"), F.lit(1))
    known = entries.join(F.broadcast(hot), "cell", "left").withColumn("own", F.pmod(F.xxhash64("id"), sides).cast("int"))
    known = known.select("*", F.explode(F.sequence(F.lit(0), sides - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, F.lit(-1)).otherwise(F.when(F.col("own") == low, F.lit(0)).otherwise(F.lit(1))).cast("byte")
    task = F.when(F.col("sides").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", low, high))
    return known.withColumns({"task": task, "side": side}).drop("sides", "own", "other")


def hot_cells(cells: DataFrame, codes: np.ndarray, block: int) -> DataFrame | None:
    """``(cell, sides)`` of the cells with more than ``block`` rows, or None. There are at most rows / ``block`` of them.

    ``cells`` are the rows (cell) of terms whose bucket is frequent enough; they are only computed if there is such a bucket.
    """
    if int(codes.max(initial=0)) < code_above(block):
        return None
    found = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("sides")).filter("sides > 1").collect()
    return cells.sparkSession.createDataFrame([(r["cell"], r["sides"]) for r in found], "cell bigint, sides int") if found else None
