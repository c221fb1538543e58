"""All similar pairs of sparse vectors by cosine.

Terms have one order, the rarest first. Vectors of length one whose first common term is the k-th of one of them have in common with it at most the
norm of its rest from there on, so a vector goes to the cells of its terms as long as that rest allows the threshold. Both vectors of a similar
pair meet in the cell of their first common term, and only there the pair is given. A cell larger than a task should hold is dealt as a triangle of
blocks.
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
from .prefix import overlaps

#: Records of a cell that one task compares; pairs, and term rows, held at once.
BLOCK, PAIRS, ROWS = 20_000, 1 << 19, 400_000
#: Terms up to which a record travels to its cells whole; a longer one is looked for by its cells' numbers and fetched for each candidate pair.
LONG = 1_000
#: The similarity that counts: digits of a distance, so that the order of a sum decides nothing.
DIGITS = 12


class Batch:
    """Records as flat arrays; terms of a record are in pivot order, ``codes`` are ascending instead."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray | None, at: np.ndarray):
        self.size = np.diff(offsets)
        self.first = offsets[:-1]
        words = np.unique(terms, return_inverse=True)[1]
        record = np.repeat(np.arange(len(self.size)), self.size)
        self.span = int(words.max()) + 1 if len(words) else 1
        key = record * self.span + words
        self.words = words
        order = np.argsort(key, kind="stable")
        self.keys, self.codes = key[order], words[order]
        self.weights = None if weights is None else weights[order]
        bit = (terms.view(np.uint64) >> np.uint64(20)) & np.uint64(127)
        self.marks, self.early = [], []  # of all terms, and of those before ``at``
        before = np.arange(len(terms)) - np.repeat(self.first, self.size) < np.repeat(at, self.size)
        for half in range(2):
            own = np.where(bit >> np.uint64(6) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            for marks, bits in ((self.marks, own), (self.early, np.where(before, own, np.uint64(0)))):
                marks.append(np.bitwise_or.reduceat(bits, self.first) if len(bits) else bits)

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, row of a, row of b) of each term that two records share."""
        n = self.size[a]
        pair = np.repeat(np.arange(len(a)), n)
        row = np.repeat(self.first[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = b[pair] * self.span + self.codes[row]
        other = np.searchsorted(self.keys, key)
        hit = np.flatnonzero((other < len(self.keys)) & (self.keys[np.minimum(other, len(self.keys) - 1)] == key))
        return pair[hit], row[hit], other[hit]

    def met_before(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a term before position ``at`` of ``a`` is in ``b``; the marks of these terms rule most pairs out."""
        out = np.zeros(len(a), bool)
        may = np.flatnonzero((at[a] > 0) & np.any([(e[a] & m[b]) != 0 for e, m in zip(self.early, self.marks)], axis=0))
        n = at[a[may]]
        pair = np.repeat(may, n)
        row = np.repeat(self.first[a[may]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = b[pair] * self.span + self.words[row]
        other = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[pair[self.keys[other] == key]] = True
        return out


def cosine(batch: Batch, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of vectors of length one reach the threshold, and their distances."""
    pair, row, other = batch.common(a, b)
    dot = np.round(np.bincount(pair, batch.weights[row] * batch.weights[other], minlength=len(a)), DIGITS)
    good = np.flatnonzero(dot >= threshold)
    return good, np.round(np.maximum(0.0, 1 - dot[good]), DIGITS)


def _pairs_of_small(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i before j in one cell, for consecutive cells of these sizes, in bounded portions."""
    ends = np.cumsum(sizes)
    rest = np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0) - 1
    total = np.cumsum(rest)
    cuts = np.flatnonzero(np.diff(total // PAIRS)) + 1
    for rows in np.split(np.arange(len(rest)), cuts):
        n = rest[rows]
        i = np.repeat(rows, n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _spread(held, threshold: float, light: bool = False, least_code: int = 0):
    """Rows (cell, id, at, terms, weights): each record in every cell that the bound leaves it; ``light``: (cell, id, size) only, of terms with at least that code."""

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                ids, lists = batch.column("id").to_numpy(), batch.column("terms")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                terms = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                size = np.diff(offsets)
                record = np.repeat(np.arange(len(size)), size)
                code = codes_of(held.value, terms)
                order = np.lexsort((terms, code, record))
                terms, code = terms[order], code[order]
                first = np.cumsum(size) - size
                position = np.arange(len(terms)) - np.repeat(first, size)
                weights = batch.column("weights").values.to_numpy()[offsets[0] : offsets[-1]][order]
                power = np.bincount(record, weights**2, minlength=len(size))
                weights = weights / np.sqrt(power[record])
                done = np.cumsum(weights**2)
                left = np.where(size > 0, 1.0, 0)[record] - (done - weights**2 - np.append(0.0, done)[first][record])
                keep = (left >= threshold**2 - 1e-9) & (code >= least_code)
                rows = np.flatnonzero(keep)
                if light:
                    for part in np.array_split(rows, -(-len(rows) // (4 * ROWS)) or 1):
                        yield pa.RecordBatch.from_arrays([pa.array(terms[part]), pa.array(ids[record[part]]), pa.array(size[record[part]].astype(np.int32))], names=["cell", "id", "size"])
                    continue
                for part in np.array_split(rows, -(-int(size[record[rows]].sum()) // (4 * ROWS)) or 1):
                    if not len(part):
                        continue
                    n = size[record[part]]
                    pick = np.repeat(first[record[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(terms[part]), pa.array(ids[record[part]]), pa.array(position[part].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(terms[pick])), pa.ListArray.from_arrays(ends, pa.array(weights[pick]))],
                        names=["cell", "id", "at", "terms", "weights"],
                    )

    return spread


def _join(threshold: float):
    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Joins the records of whole tasks. In a block off the diagonal, records of side 0 meet those of side 1 only."""
        rows = table.combine_chunks().to_batches()[0]
        cell, ids, at, side = (rows.column(c).to_numpy() for c in ("task", "id", "at", "side"))
        lists = rows.column("terms")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        weights = rows.column("weights").values.to_numpy()[offsets[0] : offsets[-1]]
        batch = Batch(offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]], weights, at.astype(np.int64))
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for i, j in _pairs_of_small(np.diff(np.append(begin, len(cell)))):
            keep = (ids[i] != ids[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[keep], j[keep]
            new = ~batch.met_before(i, j, at)
            i, j = i[new], j[new]
            for part in np.array_split(np.arange(len(i)), -(-int(batch.size[i].sum()) // (8 * PAIRS)) or 1):
                good, distance = cosine(batch, i[part], j[part], threshold)
                if len(good):
                    a, b = ids[i[part[good]]], ids[j[part[good]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance)], names=["a", "b", "distance"])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for whole in it:
            for lo in range(0, len(whole), 2000):
                batch = whole.slice(lo, 2000)
                held.append(batch)
                weight += len(batch.column("terms").flatten())
                if weight < ROWS:
                    continue
                table = pa.Table.from_batches(held)
                task = table.column("task").to_numpy()
                last = int(np.searchsorted(task, task[-1]))  # tasks come in order; the last may go on
                if last:
                    yield from found(table.slice(0, last))
                    table = table.slice(last)
                    weight = len(table.column("terms").combine_chunks().flatten())
                held = table.to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    return join


def _verify(threshold: float):
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ta, tb = batch.column("ta"), batch.column("tb")
            wa, wb = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("wa", "wb"))
            pair, x, y = overlaps(ta, tb)
            power = [np.add.reduceat(w * w, np.append(0, np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))[:-1])) if len(batch) else w for t, w in ((ta, wa), (tb, wb))]
            dot = np.round(np.bincount(pair, wa[x] * wb[y], minlength=len(batch)) / np.sqrt(power[0] * power[1]), DIGITS)
            good = np.flatnonzero(dot >= threshold)
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(np.round(np.maximum(0.0, 1 - dot[good]), DIGITS))], names=["a", "b", "distance"])

    return verify


def _long_pairs(records: DataFrame, held, threshold: float) -> DataFrame:
    """The similar pairs with a record of more than ``LONG`` terms: candidates share a cell, each is verified once."""
    light = records.mapInArrow(_spread(held, threshold, light=True), "cell bigint, id bigint, size int")
    a = light.filter(F.col("size") > LONG).select("cell", F.col("id").alias("x"))
    b = light.select("cell", F.col("id").alias("y"))
    pairs = a.join(b, "cell").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: records.select(F.col("id").alias(c), F.col("terms").alias(f"t{c}"), F.col("weights").alias(f"w{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(threshold), "a bigint, b bigint, distance double")


def similar(records: DataFrame, threshold: float, *, block: int | None = None) -> DataFrame:
    """``(a, b, distance)``, a < b, of all pairs of records whose cosine reaches ``threshold``, each pair once; distances have 12 digits.

    ``records`` has ``id`` BIGINT (unique), ``terms`` ARRAY<BIGINT> of distinct term hashes and ``weights`` ARRAY<DOUBLE>, positive and
    parallel to them. Records without terms are similar to nothing. ``records`` is read several times and should be stored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = records.sparkSession
    runtime.prepare(spark)
    block = BLOCK if block is None else block
    records = records.filter(F.size("terms") > 0)
    codes = frequency_codes(records)
    held = spark.sparkContext.broadcast(codes)
    longest = records.agg(F.max(F.size("terms"))).first()[0] or 0
    long = _long_pairs(records, held, threshold) if longest > LONG else None
    records = records.filter(F.size("terms") <= LONG)
    spread = records.mapInArrow(_spread(held, threshold), "cell bigint, id bigint, at int, terms array<bigint>, weights array<double>")
    cells = records.mapInArrow(_spread(held, threshold, True, code_above(block)), "cell bigint, id bigint, size int").select("cell")
    tasks = dealt(spread, hot_cells(cells, codes, block)).select("task", "id", "at", "terms", "weights", "side")
    pairs = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_join(threshold), "a bigint, b bigint, distance double")
    return pairs if long is None else pairs.unionByName(long)
