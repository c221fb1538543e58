"""Passages of test items in a corpus, by suffix arrays over its shards.

Only stretches of words that all occur in some item, at least as long as the shortest passage asked for, can hold a match; each task
gathers these stretches of its documents into a shard and sorts their suffixes by prefix doubling. Every item suffix is then
searched in the shard by bisection; the suffixes that share its first words are next to each other, and give the matching
documents, the places and the longest match. No pair of a document and an item is looked at unless it matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Words in a shard; bytes of item texts searched in one pass; characters split at once; suffix matches looked at together.
SHARD, ITEM_BYTES, PORTION, AT_ONCE = 2_000_000, 16 << 20, 1 << 20, 1 << 19
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_GAP = regex.compile(r"[^\p{L}\p{N}]")


def words(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters and digits of the lower-cased text, in portions."""
    text = text.lower()
    lo = 0
    while lo < len(text):
        hi = lo + PORTION
        if hi < len(text):
            gap = _GAP.search(text, hi)
            hi = gap.start() if gap else len(text)
        yield _WORDS.findall(text, lo, hi)
        lo = hi


@dataclass
class Items:
    """Item texts as word codes; ``codes`` ends in a word that no text has. ``starts`` are the places with ``least`` words or more ``left``, ``first`` those where an item begins."""

    vocabulary: dict[str, int]
    codes: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    left: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]], least: int) -> "Items":
        vocabulary: dict[str, int] = {}
        codes, item, left, first = [], [], [], []
        for i, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary)) for part in words(text) for w in part]
            if len(own) >= least:
                codes += own
                item += [i] * len(own)
                left += range(len(own), 0, -1)
                first += [True] + [False] * (len(own) - 1)
        left_ = np.asarray(left, np.int64)
        return Items(vocabulary, np.append(np.asarray(codes, np.int64), -2), np.append(np.asarray(item, np.int64), 0), np.flatnonzero(left_ >= least), np.append(left_, 0), np.append(np.asarray(first, bool), True))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (0 or more, -1 between texts) in the order of their first ``depth`` words or more."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < depth and len(codes):
        after = np.append(rank[step:], np.full(min(step, len(rank)), -1))[: len(rank)]
        order = np.argsort(rank * (int(rank.max()) + 2) + after + 1, kind="stable")
        new = np.append(False, (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        next_rank = np.empty_like(rank)
        next_rank[order] = np.cumsum(new)
        if next_rank[order[-1]] == len(rank) - 1:
            break
        rank = next_rank
        step *= 2
    return order


def _bound(codes: np.ndarray, order: np.ndarray, items: Items, least: int, upper: bool) -> np.ndarray:
    """For each item suffix, the first place in ``order`` whose suffix is not before (``upper``: is after) its first ``least`` words."""
    start = items.starts
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        at, want = order[mid], start[open_]
        sign = np.zeros(len(open_), np.int64)
        same = np.arange(len(open_))
        for k in range(least):
            x, y = codes[np.minimum(at[same] + k, len(codes) - 1)], items.codes[want[same] + k]
            sign[same] = np.sign(x - y)
            same = same[x == y]
            if not len(same):
                break
        before = sign < 0 if not upper else sign <= 0
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)


def search(codes: np.ndarray, text: np.ndarray, place: np.ndarray, items: Items, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, words, place in text) of matches of at least ``least`` words, in portions; several of one pair may come.

    ``codes`` ends in -1; ``text`` and ``place`` tell where each code stands. A match that goes on to the left is a part of a longer one and is left
    out, so a passage is extended once for each place where it begins, not once for each of its words.
    """
    order = suffix_array(codes, least)
    low, high = (_bound(codes, order, items, least, u) for u in (False, True))
    hit = np.flatnonzero(high > low)
    before = np.append(-1, codes[:-1])  # the word before each place, below 0 at the begin of a stretch
    ahead = np.where(items.first[items.starts], -3, items.codes[items.starts - 1])
    for q, lo, hi in _portions(hit, low[hit], high[hit]):
        s = order[np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum())]
        q = np.repeat(q, hi - lo)
        starts = before[s] != ahead[q]
        s, q = s[starts], q[starts]
        start = items.starts[q]
        length = np.full(len(q), least)
        on = np.arange(len(q))
        while len(on):
            k = length[on]
            on = on[(k < items.left[start[on]]) & (codes[np.minimum(s[on] + k, len(codes) - 1)] == items.codes[start[on] + k])]
            length[on] += 1
        if len(q):
            yield text[s], items.item[start], length, place[s]


def _portions(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges [low, high) of the queries, cut so that no portion has more than ``AT_ONCE`` places."""
    n = high - low
    for big in np.flatnonzero(n > AT_ONCE):  # a passage in very many texts
        for at in range(int(low[big]), int(high[big]), AT_ONCE):
            yield query[big : big + 1], np.array([at]), np.array([min(at + AT_ONCE, int(high[big]))])
    rest = np.flatnonzero(n <= AT_ONCE)
    if len(rest):
        for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(n[rest]) // AT_ONCE)) + 1):
            yield query[part], low[part], high[part]


class Longest:
    """The longest match of each (text, item), the first of equal ones; matches are folded in as they come."""

    def __init__(self):
        self.best: tuple[np.ndarray, ...] | None = None
        self.new: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, found: tuple[np.ndarray, ...]) -> None:
        self.new.append(found)
        self.held += len(found[0])
        if self.held >= 2 * AT_ONCE:
            self.result()

    def result(self) -> tuple[np.ndarray, ...] | None:
        if self.new:
            text, item, n, place = (np.concatenate(c) for c in zip(*([self.best] if self.best else []), *self.new))
            order = np.lexsort((place, -n, item, text))
            t, i = text[order], item[order]
            first = order[np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]))]
            self.best, self.new, self.held = (text[first], item[first], n[first], place[first]), [], 0
        return self.best


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, *, least: int = 13) -> DataFrame:
    """``(id, item, words, at)``: the longest run of words that a document shares with an item, if of ``least`` words or more.

    Words are the maximal runs of letters and digits (categories L and N) of the lower-cased text; ``at`` is the number of words before the
    match in the document. Null, empty and short texts on either side match nothing; equal items and equal documents have each their
    own rows. Rows with a null id take no part; rows with equal document ids are one document. ``items`` are searched in blocks of a
    bounded size, a pass over the documents for each block. Ids are integers; other columns are ignored.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    spark = documents.sparkSession
    runtime.prepare(spark)
    asked = items.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    texts = documents.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(Items.of([(r["item"], r["text"]) for r in part.collect()], least))
        one = texts.mapInArrow(_searching(held, least), "id bigint, item bigint, words int, at bigint")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("id", "item").agg(F.max(F.struct("words", (-F.col("at")).alias("a"))).alias("m"))
    kind, item_kind = dict(documents.dtypes)[id_col], dict(items.dtypes)[item_col]
    return best.select(F.col("id").cast(kind).alias(id_col), F.col("item").cast(item_kind).alias(item_col), F.col("m.words").alias("words"), (-F.col("m.a")).alias("at"))


def _searching(held, least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        shard: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            codes, ids, places = [], [], []
            for i, own in shard:
                new = np.diff(np.concatenate([[False], own >= 0, [False]]).astype(np.int8))
                for a, b in zip(np.flatnonzero(new == 1).tolist(), np.flatnonzero(new == -1).tolist()):
                    if b - a >= least:
                        codes += [own[a:b], _NO]
                        ids.append(np.full(b - a + 1, i))
                        places.append(np.arange(a, b + 1))
            if codes:
                longest = Longest()
                for found in search(np.concatenate(codes), np.concatenate(ids), np.concatenate(places), items, least):
                    longest.add(found)
                if longest.result():
                    t, i, n, p = longest.best
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(i), pa.array(n.astype(np.int32)), pa.array(p)], names=["id", "item", "words", "at"])

        code = items.vocabulary.get
        for batch in it:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = [np.fromiter((code(w, -1) for w in part), np.int64, len(part)) for part in words(text.decode("utf-8", "replace"))]
                if own:
                    own = own[0] if len(own) == 1 else np.concatenate(own)
                    if len(own) >= least:
                        shard.append((i, own))
                        size += len(own)
                if size >= SHARD:
                    yield from flush()
                    shard, size = [], 0
        yield from flush()

    return run


_NO = np.array([-1])
