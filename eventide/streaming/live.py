"""Period counts, document frequencies and clustering over streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import runtime
from ..operators.fold import CosineFold
from ..operators.grid import check_period
from ..operators.tokenize import simple_terms


def _window(length: timedelta, shift: timedelta | None) -> tuple[str, str, str]:
    check_period(length, shift)
    seconds = lambda t: f"{int(t.total_seconds())} seconds"
    # a negative start is the same grid as the one a whole length later
    moved = (shift or timedelta()) % length
    return seconds(length), seconds(length), seconds(moved)


def live_counts(stream: DataFrame, ts: str, length: timedelta, shift: timedelta | None = None, keys: list[str] | None = None, late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """``(start_timestamp, end_timestamp, keys, docs)`` of each period; rows later than the watermark and rows without a time are dropped."""
    size, slide, start = _window(length, shift)
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{int(late.total_seconds())} seconds")
    counts = marked.groupBy(F.window(ts, size, slide, start).alias("w"), *(keys or [])).agg(F.count("*").alias("docs"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start_timestamp"), F.col("w.end").cast("timestamp_ntz").alias("end_timestamp"), *(keys or []), "docs")


def live_document_frequencies(stream: DataFrame, text: str) -> DataFrame:
    """``(term, document_count)``, for the update or complete mode."""
    return stream.select(F.explode(F.array_distinct(simple_terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("document_count"))


def live_single_pass(stream: DataFrame, id_col: str, ts_col: str, text: str, idf: DataFrame, threshold: float, key: str) -> DataFrame:
    """``(key, id, cid)``: a clustering pass per key that goes on from batch to batch, with a fixed idf (term, idf).

    Documents come in the order of batches, within a batch by (ts, id). Terms that the idf table hasn't weigh 0. The state of a key is its fold,
    which grows with the terms of its clusters; a key that ends (a day) keeps it small.
    """
    runtime.prepare(stream.sparkSession)
    docs = stream.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), F.col(ts_col).alias("ts"), simple_terms(F.col(text)).alias("w"))
    rows = docs.select("key", "id", "ts", F.size("w").alias("size"), F.explode_outer("w").alias("term"))
    rows = rows.join(idf.select("term", "idf"), "term", "left")  # a stream meets a table by join, however large the table is

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else CosineFold(threshold)
        out = []
        for (_, i), own in pd.concat(list(batches)).groupby(["ts", "id"], dropna=False):  # in their order, null times last
            weights = (own["idf"].fillna(0.0) / own["size"]).groupby(own["term"]).sum()
            out.append((k[0], i, fold.add(list(weights.index), list(weights))[0]))
        state.update((pickle.dumps(fold),))
        yield pd.DataFrame(out, columns=["key", "id", "cid"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, id bigint, cid int", "fold binary", "append", GroupStateTimeout.NoTimeout)
