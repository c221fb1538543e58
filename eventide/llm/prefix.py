"""All similar pairs of sets, by prefix filtering.

Terms have one order, the rarest first. A set of n terms that is similar to another shares with it a term among its first n - ceil(t n) + 1, so
both meet in the cell of such a term. What goes to a cell is light: an id, the number of terms, the place of the cell's term and a sketch of 64
bits. Sizes, places and sketches bound the overlap of two sets; the terms are fetched once for each pair that they leave, and decide.

Why pivots drawn from the sets aren't used is told in the README, with figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .order import code_above, codes_of, dealt, frequency_codes, hot_cells

#: Records of a cell that one task compares, pairs looked at together, entries gathered before they are compared, and terms spread together.
BLOCK, PAIRS, ENTRIES, TERMS = 20_000, 1 << 19, 200_000, 1 << 20
_ENTRY = "cell bigint, id bigint, place bigint, sketch bigint"
_EPS = 1e-9


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of a list column without nulls."""
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _slices(batch: pa.RecordBatch, lists: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``TERMS`` list elements."""
    ends = np.cumsum(pc.list_value_length(batch.column(lists)).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // TERMS)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _spread(held, threshold: float, least_code: int = 0):
    """The entries of each record; with ``least_code`` only the cells of terms with at least that code."""

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in _slices(whole, "terms"):
                size, terms = _flat(batch.column("terms"))
                record = np.repeat(np.arange(len(size)), size)
                code = codes_of(held.value, terms)
                order = np.lexsort((terms, code, record))
                terms, code = terms[order], code[order]
                first = np.cumsum(size) - size
                place = np.arange(len(terms)) - first[record]
                keep = size[record] - place >= threshold * size[record] - _EPS
                rows = np.flatnonzero(keep & (code >= least_code))
                sketch = np.bitwise_or.reduceat(np.uint64(1) << ((terms.view(np.uint64) >> np.uint64(24)) & np.uint64(63)), first).view(np.int64)
                own = record[rows]
                packed = size[own] << 32 | place[rows]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (terms[rows], batch.column("id").to_numpy()[own], packed, sketch[own])], names=["cell", "id", "place", "sketch"])

    return spread


def _candidates(threshold: float):
    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        task, ids, place, side, sketch = (table.column(c).to_numpy() for c in ("task", "id", "place", "side", "sketch"))
        cell = np.cumsum(np.append(0, task[1:] != task[:-1]))
        size, place = place >> 32, place & 0xFFFFFFFF
        order = np.lexsort((size, cell))
        cell, ids, size, place, side, sketch = (c[order] for c in (cell, ids, size, place, side, sketch))
        span = int(size.max()) + 2
        # sorted by size in its cell, a record's partners are the next ones, up to the size that its own can reach
        last = np.searchsorted(cell * span + size, cell * span + np.minimum(np.floor(size / threshold + _EPS).astype(np.int64), span - 1), "right")
        n = np.maximum(0, last - np.arange(len(cell)) - 1)
        total = np.cumsum(n)
        cuts = np.flatnonzero(np.diff(total // PAIRS)) + 1
        for rows in np.split(np.arange(len(n)), cuts):
            m = n[rows]
            i = np.repeat(rows, m)
            j = i + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            keep = (ids[i] != ids[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[keep], j[keep]
            need = threshold / (1 + threshold) * (size[i] + size[j]) - _EPS
            keep = np.minimum(size[i] - place[i], size[j] - place[j]) >= need  # what is left from their first common term on
            i, j, need = i[keep], j[keep], need[keep]
            only = lambda a, b: np.bitwise_count((sketch[a] & ~sketch[b]).view(np.uint64)).astype(np.int64)
            keep = np.minimum(size[i] - only(i, j), size[j] - only(j, i)) >= need
            i, j = i[keep], j[keep]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in it:
            held.append(batch)
            n += len(batch)
            if n < ENTRIES:
                continue
            table = pa.Table.from_batches(held)
            task = table.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1]))  # tasks come in order; the last may go on
            if cut:
                yield from found(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from found(pa.Table.from_batches(held))

    return join


def overlaps(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of two list columns with distinct elements: (row, place in a, place in b) of each common element, places in the flat values."""
    (na, va), (nb, vb) = _flat(a), _flat(b)
    code = np.unique(np.concatenate([va, vb]), return_inverse=True)[1]
    span = int(code.max(initial=0)) + 1
    ka = np.repeat(np.arange(len(na)), na) * span + code[: len(va)]
    kb = np.repeat(np.arange(len(nb)), nb) * span + code[len(va) :]
    same, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return same // span, x, y


def _verify(threshold: float):
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in _slices(whole, "ta"):
                ta, tb = batch.column("ta"), batch.column("tb")
                n = np.bincount(overlaps(ta, tb)[0], minlength=len(batch))
                union = _flat(ta)[0] + _flat(tb)[0] - n
                good = np.flatnonzero(n >= threshold * union - _EPS)
                at = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(1 - n[good] / union[good])], names=["a", "b", "distance"])

    return verify


def similar_pairs(records: DataFrame, threshold: float, *, block: int | None = None) -> DataFrame:
    """``(a, b, distance)``, a < b, of all pairs of records with a Jaccard similarity of ``threshold`` or more (equality included), each pair once.

    ``records`` has ``id`` BIGINT (unique) and ``terms`` ARRAY<BIGINT> of distinct term hashes; records without terms are similar to
    nothing. It is read several times and should be stored. A cell of more than ``block`` records is dealt as a triangle of blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = records.sparkSession
    runtime.prepare(spark)
    block = BLOCK if block is None else block
    records = records.filter(F.size("terms") > 0).select("id", "terms")
    codes = frequency_codes(records)
    held = spark.sparkContext.broadcast(codes)
    entries = records.mapInArrow(_spread(held, threshold), _ENTRY)
    hot = hot_cells(records.mapInArrow(_spread(held, threshold, code_above(block)), _ENTRY).select("cell"), codes, block)
    tasks = dealt(entries, hot).select("task", "id", "place", "side", "sketch")
    pairs = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_candidates(threshold), "a bigint, b bigint").distinct()
    side = lambda c: records.select(F.col("id").alias(c), F.col("terms").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a bigint, b bigint, distance double")
