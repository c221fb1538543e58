"""Per-document text statistics, and the documents that are not natural prose.

Every text is cut into chunks of code points. A chunk gives counts and the state of its open ends (the word and the line that may go on in its
neighbours), and the states of a text are merged in order by a tree of fixed fan-in, whose root is closed. The merge is associative, so any cutting
gives the same counts. A text is one value of one row, so the task that reads it has it whole: states are made and merged there, chunks bound
the memory that counting takes, and nothing moves between tasks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Code points of a chunk, states that one merge takes, and texts whose chunks are counted together.
CHUNK, FAN, TOGETHER = 1 << 12, 16, 1000
#: White space, and the marks that end a line of prose (fixed values).
WHITE, ENDS = " \t\r\n", ".!?…"
_IS_WHITE, _IS_WORD, _IS_END, _IS_LF = 1, 2, 4, 8


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Flags of every code point: white space, letter or digit (categories L and N), end mark, line feed."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LN"]] = _IS_WORD
    for marks, flag in ((WHITE, _IS_WHITE), (ENDS, _IS_END), ("\n", _IS_LF)):
        kinds[[ord(c) for c in marks]] |= flag
    return kinds


def _text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def counts(texts: list[str], common: frozenset[str], longest: int) -> np.ndarray:
    """For each text: characters that aren't white, symbols among them, words, common words, lines, lines that end in a mark."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    out = np.zeros((len(texts), 6), np.int64)
    if not whole:
        return out
    kind = _kinds()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), size)
    n = len(kind)
    solid, wordy = (kind & _IS_WHITE) == 0, (kind & _IS_WORD) > 0
    total = lambda rows: np.bincount(owner[rows], minlength=len(texts))
    out[:, 0], out[:, 1] = total(solid), total(solid & ~wordy)
    edge = np.zeros(n, bool)
    edge[(np.cumsum(size) - size)[size > 0]] = True
    start = np.flatnonzero(solid & (edge | ~np.append(False, solid[:-1])))
    end = np.flatnonzero(solid & np.append(edge[1:] | ~solid[1:], True)) + 1
    out[:, 2] = total(start)
    at = np.arange(n)
    first = np.minimum.accumulate(np.where(wordy, at, n)[::-1])[::-1][start]
    last = np.maximum.accumulate(np.where(wordy, at, -1))[end - 1] + 1
    likely = np.flatnonzero((first < end) & (last - first <= longest))
    hit = [whole[a:b].lower() in common for a, b in zip(first[likely].tolist(), last[likely].tolist())]
    out[:, 3] = total(start[likely[np.asarray(hit, bool)]])
    # the last solid character of each line: the next solid one is in another line or text
    row = np.cumsum(edge | np.append(False, (kind[:-1] & _IS_LF) > 0))
    solids = np.flatnonzero(solid)
    ending = solids[np.append(row[solids[1:]] != row[solids[:-1]], True)[: len(solids)]] if len(solids) else solids
    out[:, 4], out[:, 5] = total(ending), total(ending[(kind[ending] & _IS_END) > 0])
    return out


@dataclass
class Piece:
    """A part of a word: symbols before, from first to last letter or digit, symbols after; strings beyond a common word's length are cut, as they can't become one."""

    lead: str = ""
    core: str = ""
    tail: str = ""

    @staticmethod
    def of(text: str, longest: int) -> "Piece":
        kind = _kinds()
        word = [i for i, c in enumerate(text) if kind[ord(c)] & _IS_WORD] if len(text) <= 4 * longest else None
        if word is None:
            flags = np.flatnonzero(kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] & _IS_WORD)
            word = flags[[0, -1]].tolist() if len(flags) else []
        if not word:
            return Piece(text[: longest + 1])
        a, b = word[0], word[-1] + 1
        return Piece(text[: min(a, longest + 1)], text[a : min(b, a + longest + 1)], text[b : b + longest + 1])

    def then(self, other: "Piece", longest: int) -> "Piece":
        if not self.core:
            return Piece((self.lead + other.lead)[: longest + 1], other.core, other.tail)
        if not other.core:
            return Piece(self.lead, self.core, (self.tail + other.lead)[: longest + 1])
        return Piece(self.lead, (self.core + self.tail + other.lead + other.core)[: longest + 1], other.tail)

    def empty(self) -> bool:
        return not (self.lead or self.core)


@dataclass
class State:
    """Counts of a stretch of text and its open ends. ``words`` counts the open ones too, ``common``, ``lines`` and ``marked`` only closed ones.

    ``head`` and ``tail`` are the words at its ends, up to the nearest white space (equal without any); ``head_line`` and ``tail_line``
    tell of the lines at its ends: 0 blank, 1 not blank, 2 ending in a mark.
    """

    solid: int
    symbols: int
    words: int
    common: int
    lines: int
    marked: int
    white: bool
    feed: bool
    head: Piece
    tail: Piece
    head_line: int
    tail_line: int

    @staticmethod
    def of(text: str, common: frozenset[str], longest: int) -> "State":
        kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        white, feed = np.flatnonzero(kind & _IS_WHITE), np.flatnonzero(kind & _IS_LF)
        solid, symbols, words = (int(x) for x in counts([text], common, longest)[0][:3])

        def line(part: str) -> int:
            part = part.rstrip(WHITE)
            return 0 if not part else 2 if part[-1] in ENDS else 1

        if len(white):
            i, j = int(white[0]), int(white[-1]) + 1
            head, tail, closed = Piece.of(text[:i], longest), Piece.of(text[j:], longest), int(counts([text[i:j]], common, longest)[0][3])
        else:
            head = tail = Piece.of(text, longest)
            closed = 0
        if len(feed):
            i, j = int(feed[0]), int(feed[-1]) + 1
            lines, marked = (int(x) for x in counts([text[i:j]], common, longest)[0][4:])
            head_line, tail_line = line(text[:i]), line(text[j:])
        else:
            lines = marked = 0
            head_line = tail_line = line(text)
        return State(solid, symbols, words, closed, lines, marked, len(white) > 0, len(feed) > 0, head, tail, head_line, tail_line)

    def then(self, other: "State", common: frozenset[str], longest: int) -> "State":
        joined, line = self.tail.then(other.head, longest), other.head_line or self.tail_line
        met = not self.tail.empty() and not other.head.empty()
        both_white, both_feed = self.white and other.white, self.feed and other.feed
        return State(
            self.solid + other.solid,
            self.symbols + other.symbols,
            self.words + other.words - met,
            self.common + other.common + (both_white and joined.core.lower() in common),
            self.lines + other.lines + (both_feed and line > 0),
            self.marked + other.marked + (both_feed and line == 2),
            self.white or other.white,
            self.feed or other.feed,
            self.head if self.white else joined,
            other.tail if other.white else joined,
            self.head_line if self.feed else line,
            other.tail_line if other.feed else line,
        )

    def closed(self, common: frozenset[str]) -> tuple[int, ...]:
        """The six counts of ``counts``, with the open ends closed."""
        pieces = [self.head, self.tail] if self.white else [self.head]
        lines = [self.head_line, self.tail_line] if self.feed else [self.head_line]
        return (self.solid, self.symbols, self.words, self.common + sum(p.core.lower() in common for p in pieces), self.lines + sum(x > 0 for x in lines), self.marked + sum(x == 2 for x in lines))


def merged(states: list[State], common: frozenset[str], longest: int) -> State:
    """The state of a text from those of its chunks, by a tree of fan-in ``FAN``."""
    while len(states) > 1:
        above = []
        for lo in range(0, len(states), FAN):
            got = states[lo]
            for s in states[lo + 1 : lo + FAN]:
                got = got.then(s, common, longest)
            above.append(got)
        states = above
    return states[0]


_COUNTS = ["solid", "symbols", "words", "common", "lines", "marked"]


def quality(documents: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str, *, chunk: int = CHUNK, most_words: int = 1_000_000) -> DataFrame:
    """``(id, words, mean_word_length, symbol_ratio, punctuated_share, common_share)``, a row for each row of ``documents``.

    Words are maximal runs of characters other than space, tab, CR and LF; other characters, such as a no-break space, are not white.
    Null, empty and white texts have 0 words and null ratios. ``common_words`` is a small fixed list: it goes to every task and raises above
    ``most_words`` rows. Null words in it are ignored. Other columns are ignored; rows with equal or null ids stay rows of their own.
    """
    runtime.prepare(documents.sparkSession)
    listed = [r[0] for r in common_words.select(word_col).filter(F.col(word_col).isNotNull()).distinct().limit(most_words + 1).collect()]
    if len(listed) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common = frozenset(listed) - {""}
    longest = max(map(len, common), default=0)
    kind = dict(documents.dtypes)[id_col]
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, len(whole), TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                texts = [_text(v) for v in batch.column("text").cast(pa.binary()).to_pylist()]
                # the state of a text of one chunk is closed at once: its counts are those of the chunk
                n = counts([t if len(t) <= chunk else "" for t in texts], common, longest)
                for k, t in enumerate(texts):
                    if len(t) > chunk:
                        n[k] = merged([State.of(t[at : at + chunk], common, longest) for at in range(0, len(t), chunk)], common, longest).closed(common)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(n[:, k]) for k in range(6))], names=["id", *_COUNTS])

    n = rows.mapInArrow(counted, f"id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    share = lambda a, b: F.when(F.col("words") > 0, F.col(a) / F.col(b))
    return n.select(F.col("id").alias(id_col), "words", share("solid", "words").alias("mean_word_length"), share("symbols", "solid").alias("symbol_ratio"), share("marked", "lines").alias("punctuated_share"), share("common", "words").alias("common_share"))


def not_prose(stats: DataFrame, *, word_length: tuple[float, float] = (3.5, 8.5), symbols: float = 0.15, punctuated: float = 0.5, common: float = 0.15, rules: int = 2) -> DataFrame:
    """The rows of ``quality`` with a word for which at least ``rules`` of the four rules hold."""
    length = F.col("mean_word_length")
    held = [(length < word_length[0]) | (length > word_length[1]), F.col("symbol_ratio") > symbols, F.col("punctuated_share") < punctuated, F.col("common_share") < common]
    return stats.filter("words > 0").filter(sum((h.cast("int") for h in held[1:]), held[0].cast("int")) >= rules)
