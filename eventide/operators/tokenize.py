"""Texts to terms, and term vectors.

A term vector is ``ARRAY<STRUCT<lexeme STRING, n INT>>``, sorted by lexeme and without repeats; ``n`` is the number of occurrences, 0
once positions are stripped. Terms are the maximal runs of [0-9a-z] in the lower-cased text ("simple"), and for "english" those without
stop words, stemmed.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem

CONFIGS = ("simple", "english")


@lru_cache(1)
def stop_words() -> frozenset[str]:
    """The Snowball list: Spark's English list without contractions and four later additions (fixed values)."""
    return frozenset(w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w) - {"cannot", "could", "ought", "would"}


def simple_terms(text: Column) -> Column:
    """ARRAY of the terms in order, with repeats; NULL for a null text."""
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(lists: pa.Array) -> pa.Array:
    """Stems of lists of words; a batch stems each of its distinct words once."""
    code = pc.dictionary_encode(lists.flatten())
    stems = pa.array([None if w is None else stem(w) for w in code.dictionary.to_pylist()], pa.string())
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(code.indices), mask=lists.is_null() if lists.null_count else None)


def terms(text: Column, config: str = "simple") -> Column:
    """ARRAY of the terms of a text, with repeats. Only stemming leaves the JVM, with stop words removed before."""
    if config not in CONFIGS:
        raise ValueError(f"config is one of {CONFIGS}")
    words = simple_terms(text)
    if config == "simple":
        return words
    return stemmed(F.filter(words, lambda w: ~w.isin(*sorted(stop_words()))))


def terms_of(c: Column, kind: str, config: str) -> Column:
    """Terms of a text column, or an array column as it is."""
    return terms(c, config) if kind == "string" else c


def keyword_terms(keywords: str | list[str] | None, config: str = "simple") -> list[str] | None:
    """Keywords as distinct terms, processed once where the query is written."""
    if keywords is None:
        return None
    import re

    text = keywords if isinstance(keywords, str) else " ".join(k for k in keywords if k is not None)
    words = [w for w in re.split("[^0-9a-z]+", text.lower()) if w]
    if config == "english":
        words = [stem(w) for w in words if w not in stop_words()]
    return sorted(set(words))


def term_vector(words: Column) -> Column:
    """Term vector of an array of terms; null terms are dropped."""
    clean = F.array_compact(words)
    return F.transform(F.array_sort(F.array_distinct(clean)), lambda w: F.struct(w.alias("lexeme"), F.size(F.filter(clean, lambda x: x == w)).alias("n")))


def lexemes(vector: Column) -> Column:
    return F.transform(vector, lambda s: s["lexeme"])


def strip(vector: Column) -> Column:
    """Without positions: every lexeme then counts once."""
    return F.transform(vector, lambda s: F.struct(s["lexeme"].alias("lexeme"), F.lit(0).alias("n")))


def length(vector: Column) -> Column:
    return F.size(vector)


def delete(vector: Column, words: list[str]) -> Column:
    """Without the given lexemes."""
    return F.filter(vector, lambda s: ~s["lexeme"].isin(*words)) if words else vector


def matches(vector: Column, words: list[str]) -> Column:
    """Whether any of the lexemes is in the vector."""
    return F.exists(vector, lambda s: s["lexeme"].isin(*words)) if words else F.lit(False)


def process_text(df: DataFrame, text: str, keys: list[str], config: str = "simple") -> DataFrame:
    """``(keys, term, count)``: a row for each distinct term of each row's text; null and empty texts give none.

    Rows of equal keys are counted together.
    """
    rows = df.select(*keys, F.explode(terms(F.col(text), config)).alias("__term")).groupBy(*keys, "__term")
    return rows.agg(F.count("*").cast("int").alias("__count")).toDF(*keys, "term", "count")


def distinct_terms(df: DataFrame, text: str, keys: list[str], config: str = "simple") -> DataFrame:
    """``(keys, term, count)`` with a count of 1 for each distinct term of a row, however often it occurs; null texts give none."""
    return df.select(*keys, F.explode(F.array_distinct(terms(F.col(text), config))).alias("__term"), F.lit(1).alias("__count")).toDF(*keys, "term", "count")


def term_frequency(words: Column, term: str) -> Column:
    """Occurrences of a term in an array of terms; NULL for a null array."""
    return F.size(F.filter(words, lambda w: w == term))


def tokenize(text: str | list | dict | None, output: str = "dict", config: str = "english", dropped: frozenset[str] | None = None):
    """Term counts of one text on the driver: a dict, or a list of (term, count). Also takes a list of terms, of (term, count) or a dict.

    ``dropped`` are the stop words of "english" where no session can be asked for them.
    """
    if output not in ("dict", "list"):
        raise ValueError("output is 'dict' or 'list'")
    if isinstance(text, dict):
        counts = Counter(text)
    elif isinstance(text, list):
        counts = Counter()
        for t in text:
            counts.update({t[0]: t[1]} if isinstance(t, tuple) else {t: 1})
    else:
        import re

        words = [w for w in re.split("[^0-9a-z]+", (text or "").lower()) if w]
        dropped = stop_words() if config == "english" and dropped is None else dropped
        counts = Counter(stem(w) for w in words if w not in dropped) if config == "english" else Counter(words)
    return dict(counts) if output == "dict" else sorted(counts.items())


def tokenizer_differences(df: DataFrame, id_col: str, text_col: str, config: str = "english") -> DataFrame:
    """``(id, term, table_count, driver_count)``: where the distributed tokenizer and the one of the driver disagree; no rows mean they agree.

    Both count the terms of each row's text; a term that one of them hasn't counts 0 there. Null and empty texts have no terms. Rows of equal ids
    are counted together.
    """
    from .. import runtime

    runtime.prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dropped = stop_words()

    @F.arrow_udf("array<struct<term:string,n:int>>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([[{"term": t, "n": n} for t, n in tokenize(v, "list", config, dropped)] for v in texts.to_pylist()], pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])))

    ours = rows.select("id", F.explode(terms(F.col("text"), config)).alias("term"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    theirs = rows.select("id", F.explode(counted("text")).alias("t")).select("id", "t.term", F.lit(0).alias("a"), F.col("t.n").alias("b"))
    both = ours.unionByName(theirs).groupBy("id", "term").agg(F.sum("a").alias("table_count"), F.sum("b").alias("driver_count"))
    return both.filter("table_count <> driver_count").withColumnRenamed("id", id_col)
