"""Groups of similar sparse vectors, by hierarchical density clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from .cells import similar


def vectors(rows: DataFrame, id_col: str, term_col: str, weight_col: str) -> DataFrame:
    """``(id, terms, weights)`` from rows (id, term, weight).

    Terms are trimmed of spaces and lower-cased. Rows with a null id, a null or blank term or a weight that isn't finite and above 0
    don't count; rows that are then equal count once, different weights of one term add up. Ids without a row have no vector.
    """
    t, w = F.lower(F.trim(F.col(term_col).cast("string"))), F.col(weight_col).cast("double")
    fit = F.col(id_col).isNotNull() & (F.length(F.translate(t, " \t\r\n", "")) > 0) & (w > 0) & (w < float("inf")) & ~F.isnan(w)
    clean = rows.filter(fit).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(t).alias("term"), w.alias("w")).distinct()
    return clean.groupBy("id", "term").agg(F.sum("w").alias("w")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v")).select("id", F.col("v.term").alias("terms"), F.col("v.w").alias("weights"))


def neighbour_graph(records: DataFrame, least_cosine: float, min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """Mutual-reachability edges ``(a, b, distance)`` between representatives, and ``(id, rep)`` of every vector.

    Equal vectors are one node, represented by its smallest id. The distance is 1 - cosine; an edge's length is the greatest of it and
    both core distances, the distance to the ``min_samples``-th vector from each (itself and its copies included). Nodes with fewer
    vectors within reach have no edges. Up to ``min_samples`` 2 a core distance is at most that to the nearest neighbour, so no edge is
    longer than its distance; above that, a first pass keeps the nearest neighbours of each node. Edges aren't stored: who takes them reduces
    them to a forest in the task that finds them.
    """
    held = runtime.cut(records)
    nodes = runtime.cut(held.groupBy("terms", "weights").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    member = held.join(nodes.filter("copies > 1").select("terms", "weights", F.col("id").alias("rep")), ["terms", "weights"]).select("id", "rep")
    member = member.unionByName(nodes.filter("copies = 1").select("id", F.col("id").alias("rep")))
    edges = similar(nodes.select("id", "terms", "weights"), least_cosine)
    if min_samples <= 2:
        return edges, member
    size = nodes.select("id", "copies")
    ends = edges.mapInArrow(_nearest(min_samples - 1), "id bigint, o bigint, distance double")
    ends = ends.unionByName(size.select("id", F.col("id").alias("o"), F.lit(0.0).alias("distance")))
    # the nearest min_samples nodes hold at least as many vectors
    near = ends.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("distance", "o"))).filter(F.col("k") <= min_samples)
    near = near.join(size.withColumnRenamed("id", "o"), "o")
    upto = near.withColumn("n", F.sum("copies").over(Window.partitionBy("id").orderBy("distance", "o")))
    core = runtime.cut(upto.filter(F.col("n") >= min_samples).groupBy("id").agg(F.min("distance").alias("core")))
    edges = edges.join(core.select(F.col("id").alias("a"), F.col("core").alias("x")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("y")), "b")
    return edges.select("a", "b", F.greatest("distance", "x", "y").alias("distance")), member


def _nearest(k: int):
    """Of the edges of a task, those to the ``k`` nearest of each end, as ``(id, o, distance)``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in it:
            a, b, d = (c.to_numpy() for c in batch.columns)
            ends = [np.concatenate(c) for c in zip(held, (a, b, d), (b, a, d))]
            order = np.lexsort((ends[1], ends[2], ends[0]))
            i = ends[0][order]
            order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
            held = [c[order] for c in ends]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["id", "o", "distance"])

    return run
