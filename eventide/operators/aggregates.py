"""Entropy and shared terms of groups of texts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenize import terms_of


def _counted(df: DataFrame, col: str, config: str, cap: int | None) -> Column:
    """ARRAY<STRUCT<lexeme, n>> of the column's row: texts and term arrays are counted, term vectors taken as they are (n at least 1)."""
    kind = dict(df.dtypes)[col]
    most = (lambda n: F.least(n, F.lit(cap))) if cap else (lambda n: n)
    if kind.startswith("array<struct"):
        return F.transform(F.col(col), lambda s: F.struct(s["lexeme"].alias("lexeme"), most(F.greatest(s["n"], F.lit(1))).alias("n")))
    words = F.array_compact(terms_of(F.col(col), kind, config))
    if not cap:
        return F.transform(words, lambda w: F.struct(w.alias("lexeme"), F.lit(1).alias("n")))
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("lexeme"), most(F.size(F.filter(words, lambda x: x == w))).alias("n")))


def entropy(df: DataFrame, keys: list[str], col: str, config: str = "simple", max_occurrences: int | None = None, name: str = "entropy") -> DataFrame:
    """``(keys, entropy)``: sum of p x log2(1 / p) over the pooled terms of each group; 0 for a group without terms.

    Null and empty texts add nothing but keep their group; without keys an empty input gives one row with 0.
    ``max_occurrences`` caps what a term counts within one row. Counts are partial before they move, so a hot group is no hot task.
    """
    rows = df.select(*keys, F.explode_outer(_counted(df, col, config, max_occurrences)).alias("__t")).select(*keys, F.col("__t.lexeme").alias("__lexeme"), F.col("__t.n").alias("__n"))
    pooled = rows.groupBy(*keys, "__lexeme").agg(F.sum("__n").cast("double").alias("__n"))
    n = F.col("__n")
    # H = log2 T - sum(n log2 n) / T needs no second look at the total
    sums = pooled.groupBy(*keys).agg(F.sum(n).alias("__total"), F.sum(n * F.log2(n)).alias("__s"), F.count(n).alias("__k"))
    h = F.when(F.col("__k") <= 1, F.lit(0.0)).otherwise(F.greatest(F.log2("__total") - F.col("__s") / F.col("__total"), F.lit(0.0)))
    return sums.select(*keys, F.coalesce(h, F.lit(0.0)).alias(name))


def shared_terms(df: DataFrame, keys: list[str], col: str, minimum: int | None, config: str = "simple", name: str = "shared_terms") -> DataFrame:
    """``(keys, shared_terms)``: how many terms are in at least ``minimum`` rows of the group (0 for a null minimum or a group without terms)."""
    words = F.array_distinct(F.transform(_counted(df, col, config, None), lambda s: s["lexeme"]))
    rows = df.select(*keys, F.explode_outer(words).alias("__term")).groupBy(*keys, "__term").agg(F.count("__term").alias("__n"))
    enough = F.lit(False) if minimum is None else (F.col("__n") >= minimum) & F.col("__term").isNotNull()
    return rows.groupBy(*keys).agg(F.count_if(enough).cast("int").alias(name))


def group_metrics(df: DataFrame, keys: list[str], col: str, minimum: int = 2, users: str | None = None, config: str = "simple") -> DataFrame:
    """``(keys, docs[, users], shared_terms, entropy)``: rows, distinct users, shared terms and entropy of each group; null keys are a group."""
    base = df.groupBy(*keys).agg(F.count("*").alias("docs"), *([F.count_distinct(users).alias("users")] if users else []))
    parts = [base, shared_terms(df, keys, col, minimum, config), entropy(df, keys, col, config)]
    names = base.columns[len(keys) :] + ["shared_terms", "entropy"]
    # each part has one row for each group: lay them side by side and merge, which keeps null keys without a null-safe join
    wide = None
    for p in parts:
        own = p.columns[len(keys) :]
        side = p.toDF(*(f"__k{i}" for i in range(len(keys))), *own)
        side = side.select(*side.columns[: len(keys)], *(F.col(c) if c in own else F.lit(None).cast("double" if c == "entropy" else "bigint").alias(c) for c in names))
        wide = side if wide is None else wide.unionByName(side)
    merged = wide.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(*(F.max(c).alias(c) for c in names))
    return merged.withColumn("shared_terms", F.col("shared_terms").cast("int")).toDF(*keys, *names)


def terms_in(value) -> list[str]:
    """Terms of a value that SQL hands over: a text's own, or an array's without nulls."""
    return re.findall("[0-9a-z]+", value.lower()) if isinstance(value, str) else [w for w in value if w is not None]


def entropy_of(rows) -> float:
    counts = Counter(w for r in rows if r is not None for w in terms_in(r))
    total = sum(counts.values())
    return sum(n / total * math.log2(total / n) for n in counts.values()) if len(counts) > 1 else 0.0


def shared_of(rows, minimum: int | None) -> int:
    counts = Counter(w for r in rows if r is not None for w in set(terms_in(r)))
    return 0 if minimum is None else sum(n >= minimum for n in counts.values())


@F.pandas_udf(T.DoubleType())
def entropy_udaf(terms: pd.Series) -> float:
    """Grouped aggregate for SQL over texts or arrays of terms; it holds a group in one task, the DataFrame form doesn't."""
    return entropy_of(terms)


@F.pandas_udf(T.IntegerType())
def shared_terms_udaf(terms: pd.Series, minimum: pd.Series) -> int:
    """As ``shared_terms`` for SQL; the first minimum of the group counts."""
    m = minimum.iloc[0] if len(minimum) else None
    return shared_of(terms, None if m is None or pd.isna(m) else int(m))
