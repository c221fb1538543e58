"""Frequency of every distinct value, from compressed record bitmaps with parallel counters.

Vertical layout: for each value the records that have it are kept in containers of 2^16 ids, with a counter beside each id. Containers
are built where the rows are, moved by (value, id range) and merged by union; a row delivered twice has the same id, spelling and
counter and so counts once, and a value of any frequency is spread over the ranges of its records. The number of records of a value
is the cardinality of its union, its occurrences are the sum of the counters.

While it travels, a container has one of four forms: LIST (16-bit offset, 16-bit counter of each entry), WIDE (offset, counter and spelling, 64 bits
each), BITS (a bitmap, all counters 1) or COUNTED (a bitmap, then 16-bit counters). Bitmaps are merged as bytes where no counters differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Ids in a container's range, the most of them that it keeps as a list, and rows that a task gathers before it builds containers.
RANGE, LIST_MOST, GATHER = 1 << 16, 4096, 200_000
LIST, WIDE, BITS, COUNTED = range(4)
#: The range that stands for a null record id.
NO_RECORD = -(1 << 62)
_PIECE = "value string, high bigint, form tinyint, data binary"


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive slices of bytes as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def encode(group: np.ndarray, low: np.ndarray, n: np.ndarray, spelling: np.ndarray, groups: int) -> tuple[np.ndarray, pa.Array]:
    """(form, data) of containers of distinct entries, sorted by (group, low)."""
    size = np.bincount(group, minlength=groups)
    wide = np.bincount(group, (n >= RANGE) | (n < 0) | (spelling != 0), minlength=groups) > 0
    again = np.append(False, (group[1:] == group[:-1]) & (low[1:] == low[:-1]))
    dense = (size > LIST_MOST) & ~wide & (np.bincount(group, again, minlength=groups) == 0)
    form = np.where(wide, WIDE, LIST).astype(np.int8)
    forms, parts, order = [], [], []
    for kind, own in ((LIST, ~wide & ~dense), (WIDE, wide)):
        rows = own[group]
        columns = [low[rows], n[rows]] if kind == LIST else [low[rows], n[rows], spelling[rows]]
        width = 2 if kind == LIST else 8
        data = np.stack([c.astype(np.int64) for c in columns], 1).astype(f"<u{width}" if kind == LIST else "<i8")
        parts.append(_binaries(data.ravel(), np.cumsum(size[own]) * width * len(columns)))
        order.append(np.flatnonzero(own))
    blobs = []
    ends = np.cumsum(size)
    for k in np.flatnonzero(dense):
        rows = slice(ends[k] - size[k], ends[k])
        bits = np.zeros(RANGE, np.uint8)
        bits[low[rows]] = 1
        plain = bool((n[rows] == 1).all())
        form[k] = BITS if plain else COUNTED
        blobs.append(np.packbits(bits).tobytes() + (b"" if plain else n[rows].astype("<u2").tobytes()))
    parts.append(pa.array(blobs, pa.binary()))
    order.append(np.flatnonzero(dense))
    back = np.empty(groups, np.int64)
    back[np.concatenate(order)] = np.arange(groups)
    return form, pa.concat_arrays(parts).take(pa.array(back))


def _lists(data: pa.Array, rows: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
    """(row, low, n, spelling) of the entries of containers of form ``kind``, LIST or WIDE."""
    own = data.take(pa.array(rows))
    size = pc.binary_length(own).to_numpy(zero_copy_only=False) // (4 if kind == LIST else 24)
    start = np.frombuffer(own.buffers()[1], np.int32)[own.offset :][: len(own) + 1]
    raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[start[0] : start[-1]] if len(own) else np.zeros(0, np.uint8)
    flat = raw.view("<u2" if kind == LIST else "<i8").reshape(-1, 2 if kind == LIST else 3).astype(np.int64)
    return np.repeat(rows, size), flat[:, 0], flat[:, 1], flat[:, 2] if kind == WIDE else np.zeros(len(flat), np.int64)


def _one(form: int, data: bytes) -> tuple[np.ndarray, ...]:
    """(low, n, spelling) of one container."""
    if form in (LIST, WIDE):
        return _lists(pa.array([data], pa.binary()), np.zeros(1, np.int64), form)[1:]
    low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, RANGE // 8)))
    n = np.ones(len(low), np.int64) if form == BITS else np.frombuffer(data, "<u2", offset=RANGE // 8).astype(np.int64)
    return low, n, np.zeros(len(low), np.int64)


class Dense:
    """The union of many containers of one range: a bitmap of ids whose counter is 1, one counter for each other id, and entries beside them."""

    def __init__(self):
        self.bits = np.zeros(RANGE // 8, np.uint8)
        self.n = np.full(RANGE, -1, np.int64)
        self.rest: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, form: int, data: bytes) -> None:
        if form == BITS:
            self.bits |= np.frombuffer(data, np.uint8)
        else:
            self.entries(*_one(form, data))

    def entries(self, low: np.ndarray, n: np.ndarray, spelling: np.ndarray) -> None:
        plain = np.flatnonzero((spelling == 0) & (n >= 0))
        free = plain[self.n[low[plain]] < 0]
        self.n[low[free]] = n[free]  # of several counters of one id one stays, the others go beside
        other = np.flatnonzero((spelling != 0) | (self.n[low] != n))
        if len(other):
            self.rest.append((low[other], n[other], spelling[other]))
            self.held += len(other)
            if self.held > 4 * RANGE:
                self.rest = [_distinct(*(np.concatenate(c) for c in zip(*self.rest)))]
                self.held = len(self.rest[0][0])

    def all(self) -> tuple[np.ndarray, ...]:
        one, some = np.flatnonzero(np.unpackbits(self.bits)), np.flatnonzero(self.n >= 0)
        parts = [(one, np.ones(len(one), np.int64), np.zeros(len(one), np.int64)), (some, self.n[some], np.zeros(len(some), np.int64)), *self.rest]
        return _distinct(*(np.concatenate(c) for c in zip(*parts)))


def _distinct(low: np.ndarray, n: np.ndarray, spelling: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((spelling, n, low))
    first = order[_groups(low[order], n[order], spelling[order])[1]] if len(order) else order
    return low[first], n[first], spelling[first]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row of sorted columns, and the first row of each group."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def built(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        values, n, record, spelling = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
        code = pc.dictionary_encode(values)
        null = record.is_null().to_numpy(zero_copy_only=False)
        record = record.fill_null(0).to_numpy()
        high, low = np.where(null, NO_RECORD, record >> 16), np.where(null, 0, record & (RANGE - 1))
        keys = (code.indices.to_numpy(), high, low, n.to_numpy(), spelling.to_numpy())
        order = np.lexsort(keys[::-1])
        keys = tuple(k[order] for k in keys)
        first = _groups(*keys)[1]
        c, high, low, n, spelling = (k[first] for k in keys)
        group, first = _groups(c, high)
        form, data = encode(group, low, n, spelling, len(first))
        return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(c[first])), pa.array(high[first]), pa.array(form), data], names=["value", "high", "form", "data"])

    held, rows = [], 0
    for batch in it:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= GATHER:
            yield built(held)
            held, rows = [], 0
    if held:
        yield built(held)


def _union(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the containers of equal keys, which are next to each other; the last key's union waits for the next batch."""
    carry: tuple | None = None  # (value, high, entries)

    def done(value: pa.Array, high: np.ndarray, group: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Sorted entries of whole containers, as ids with a counter each."""
        k = len(high)
        first = _groups(group, low)[1] if len(group) else group
        counter = np.add.reduceat(n, first) if len(first) else n
        group, low = group[first], low[first]
        card = np.bincount(group, minlength=k)
        ends = np.cumsum(card)
        ids = _binaries(low.astype("<u2"), 2 * ends)
        dense = np.flatnonzero(card > LIST_MOST)
        if len(dense):
            listed = ids.to_pylist()
            for j in dense:
                bits = np.zeros(RANGE, np.uint8)
                bits[low[ends[j] - card[j] : ends[j]]] = 1
                listed[j] = np.packbits(bits).tobytes()
            ids = pa.array(listed, pa.binary())
        total = np.zeros(k, np.int64)
        np.add.at(total, group, counter)
        return pa.RecordBatch.from_arrays([value, pa.array(high), ids, _binaries(counter.astype("<i8"), 8 * ends), pa.array(card), pa.array(total)], names=["value", "high", "ids", "counters", "card", "occurrences"])

    def single(key: tuple) -> pa.RecordBatch:
        value, high, (low, n, _) = key
        return done(pa.array([value], pa.string()), np.array([high]), np.zeros(len(low), np.int64), low, n)

    for batch in it:
        if not batch.num_rows:
            continue
        value, high, form, data = batch.columns
        high, form = high.to_numpy(), form.to_numpy()
        code = pc.dictionary_encode(value).indices.to_numpy()
        group, first = _groups(code, high)
        last = len(first) - 1
        if carry and (carry[0] != value[0].as_py() or carry[1] != high[0]):
            yield single(carry)
            carry = None
        bulky = (np.bincount(group, form >= BITS) > 0) | (np.bincount(group, pc.binary_length(data).to_numpy(zero_copy_only=False)) > 64 * LIST_MOST)
        unions: dict[int, tuple] = {}
        for g in np.flatnonzero(bulky):
            dense = Dense()
            if carry and g == 0:
                dense.entries(*carry[2])
            for k in range(first[g], first[g + 1] if g < last else len(batch)):
                dense.add(int(form[k]), data[k].as_py())
            unions[g] = dense.all()
        light = ~bulky[group]
        parts = [(group[r], *e) for r, *e in (_lists(data, np.flatnonzero(light & (form == kind)), kind) for kind in (LIST, WIDE))]
        if carry and 0 not in unions:
            parts.append((np.zeros(len(carry[2][0]), np.int64), *carry[2]))
        parts += [(np.full(len(e[0]), g), *e) for g, e in unions.items()]
        g, low, n, spelling = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((spelling, n, low, g))
        g, low, n, spelling = (c[order] for c in (g, low, n, spelling))
        keep = _groups(g, low, n, spelling)[1]
        g, low, n, spelling = (c[keep] for c in (g, low, n, spelling))
        cut = np.searchsorted(g, last)
        carry = (value[int(first[last])].as_py(), int(high[first[last]]), (low[cut:], n[cut:], spelling[cut:]))
        if last:
            at = first[:last]
            yield done(value.take(pa.array(at)), high[at], g[:cut], low[:cut], n[:cut])
    if carry:
        yield single(carry)


def bitmaps(rows: DataFrame, record: str, value: str, count: str | Column | None = None, normalise=None) -> DataFrame:
    """``(value, high, ids, counters, card, occurrences)``: the records of each value, by range of record ids.

    ``ids`` are the offsets in the range, a list of 16-bit numbers or from 4,097 of them on a bitmap, ``counters`` the occurrences in each of
    these records as 64-bit numbers, ``card`` and ``occurrences`` their number and sum. ``normalise`` maps the stored value to the counted one (a Column to a
    Column). A row counts ``count`` times (1 without it), and rows equal in record, stored value and count count once. Records and counts are
    integers. Rows with a null value or a null count don't count; null record ids are together one record. An empty input gives an
    empty result; other columns are ignored.
    """
    runtime.prepare(rows.sparkSession)
    n = F.lit(1) if count is None else F.col(count) if isinstance(count, str) else count
    stored = F.col(value).cast("string")
    held = stored if normalise is None else normalise(stored)
    spelling = F.when(held.eqNullSafe(stored), F.lit(0)).otherwise(F.xxhash64(stored)).cast("bigint")
    clean = rows.select(held.alias("value"), n.cast("bigint").alias("n"), F.col(record).cast("bigint").alias("record"), spelling.alias("spelling"))
    clean = clean.filter("value IS NOT NULL AND n IS NOT NULL")
    built = clean.mapInArrow(_build, _PIECE)
    near = built.repartition("value", "high").sortWithinPartitions("value", "high")
    return near.mapInArrow(_union, "value string, high bigint, ids binary, counters binary, card bigint, occurrences bigint")


def frequencies(rows: DataFrame, record: str, value: str, count: str | Column | None = None, normalise=None) -> DataFrame:
    """``(value, occurrences, records)`` of each distinct value: how often it occurs, and in how many records. See ``bitmaps``."""
    merged = bitmaps(rows, record, value, count, normalise)
    return merged.groupBy("value").agg(F.sum("occurrences").alias("occurrences"), F.sum("card").alias("records"))


def marked(freq: DataFrame, rare_most: int, common_share: float) -> DataFrame:
    """``(value, mark)``: "rare" for values with at most ``rare_most`` occurrences, "common" above ``common_share`` of all.

    A value that is both (in a tiny collection) has a row for each mark.
    """
    total = freq.agg(F.sum("occurrences")).scalar()
    n = F.col("occurrences")
    marks = F.array_compact(F.array(F.when(n <= rare_most, F.lit("rare")), F.when(n / F.lit(common_share) > total, F.lit("common"))))
    return freq.select("value", F.explode(marks).alias("mark"))
