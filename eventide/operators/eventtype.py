"""Keyword match, and a trainable naive-Bayes classifier of event types."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from .tokenize import keyword_terms, terms_of

#: Models of at most this many terms are looked up in a literal map, larger ones are joined.
LITERAL_TERMS = 20_000


def overlap(df: DataFrame, col: str, keywords: str | list[str] | None, config: str = "simple") -> Column:
    """Number of distinct keywords in the text or terms; NULL for a null text or null keywords, 0 without keywords."""
    words = keyword_terms(keywords, config)
    if words is None:
        return F.lit(None).cast("int")
    have = terms_of(F.col(col), dict(df.dtypes)[col], config)
    if not words:
        return F.when(have.isNotNull(), F.lit(0))
    return F.when(have.isNotNull(), F.size(F.array_intersect(have, F.array(*map(F.lit, words)))))


def has_keyword(df: DataFrame, col: str, keywords: str | list[str] | None, config: str = "simple") -> Column:
    """Whether any keyword is there; false without keywords (or null ones), NULL for a null text."""
    words = keyword_terms(keywords, config)
    if not words:
        return F.lit(False)
    return F.exists(F.array_compact(terms_of(F.col(col), dict(df.dtypes)[col], config)), lambda w: w.isin(*words))


class EventTypeModel:
    """``(event_type, term, weight)`` rows; the bias has the term ''. Other linear models can be put in the same shape."""

    SCHEMA = "event_type string, term string, weight double"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @staticmethod
    def train(name: str, df: DataFrame, text_col: str, label_col: str, config: str = "simple") -> "EventTypeModel":
        """Weights ln((pos + 1) / (P + V)) - ln((neg + 1) / (Q + V)) of each term and bias ln(n_pos / n_neg).

        pos and neg count the labelled rows with the term, P and Q are their sums, V is the number of terms. Rows with a null label don't
        count; rows with a null text count in the bias. An empty name, or labels of one kind only, raise.
        """
        if not name:
            raise ValueError("the event type must have a name")
        rows = df.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("boolean").alias("y"), F.array_distinct(F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config))).alias("w"))
        n = rows.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q")).first()
        if not n["p"] or not n["q"]:
            raise ValueError("training needs rows with the label true and rows with the label false")
        # the texts are taken apart once; what is left has a row for each term
        per = runtime.cut(rows.select("y", F.explode("w").alias("term")).groupBy("term").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))
        P, Q, V = (x or 0 for x in per.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first())
        weight = F.log((F.col("pos") + 1) / F.lit(P + V)) - F.log((F.col("neg") + 1) / F.lit(Q + V))
        terms = per.select(F.lit(name).alias("event_type"), "term", weight.alias("weight"))
        bias = df.sparkSession.range(1).select(F.lit(name).alias("event_type"), F.lit("").alias("term"), F.log(F.lit(n["p"] / n["q"])).alias("weight"))
        return EventTypeModel(terms.unionByName(bias))

    def replaced(self, other: "EventTypeModel") -> "EventTypeModel":
        """This store with the event types of ``other`` in place of its own of the same names."""
        return EventTypeModel(self.rows.join(other.rows.select("event_type").distinct(), "event_type", "left_anti").unionByName(other.rows))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EventTypeModel":
        return EventTypeModel(spark.read.schema(EventTypeModel.SCHEMA).parquet(path))

    def predict(self, df: DataFrame, name: str, text_col: str, config: str = "simple", keywords: str | list[str] | None = None, out: str = "is_event", score: str | None = None) -> DataFrame:
        """``df`` with the column ``out``: whether the weights of the distinct terms and the bias sum to more than 0; NULL for a null text.

        Terms that the model hasn't weigh 0; an unknown event type raises. With ``keywords`` a row must also have one of them, and
        only those rows are scored.
        """
        model = self.rows.filter((F.col("event_type") == name))
        held = model.limit(LITERAL_TERMS + 1).collect()
        if not held:
            raise ValueError(f"unknown event type {name!r}")
        words = F.array_distinct(F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config)))
        hit = has_keyword(df, text_col, keywords, config) if keywords is not None else None
        if len(held) <= LITERAL_TERMS:
            asked = words if hit is None else F.when(hit, words)  # only these rows' terms leave the JVM
            total = self._by_map(df, asked, {r["term"]: r["weight"] for r in held})
            verdict = total > 0
            if hit is not None:
                verdict = F.when(hit.isNull(), F.lit(None).cast("boolean")).when(hit, verdict).otherwise(False)
            return df.withColumns({**({score: total} if score else {}), out: verdict})
        return self._by_join(df, words, model, hit, out, score)

    @staticmethod
    def _by_map(df: DataFrame, words: Column, weights: dict[str, float]) -> Column:
        """Sum over the row's terms, in one projection."""
        spark = df.sparkSession
        held = spark.sparkContext.broadcast(weights)  # bounded by LITERAL_TERMS

        @F.arrow_udf("double")
        def scored(lists: pa.Array) -> pa.Array:
            w = held.value
            code = pc.dictionary_encode(lists.flatten())
            known = np.array([w.get(t, 0.0) for t in code.dictionary.to_pylist()] + [0.0])
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            total = np.bincount(np.repeat(np.arange(len(size)), size), known[code.indices.to_numpy(zero_copy_only=False)], minlength=len(size))
            return pa.array(total + w.get("", 0.0), mask=lists.is_null().to_numpy(zero_copy_only=False))

        return scored(words)

    @staticmethod
    def _by_join(df: DataFrame, words: Column, model: DataFrame, hit: Column | None, out: str, score: str | None) -> DataFrame:
        """Sums by join, for each distinct set of terms; rows find theirs by a 128-bit key of the set, so only terms and keys move twice."""
        keyed = df.withColumns({"__hit": F.lit(True) if hit is None else hit, "__w": F.array_sort(words)})
        keyed = keyed.withColumns({"__k": F.xxhash64("__w"), "__l": F.xxhash64(F.lit(1), "__w")})
        bias = model.filter("term = ''").select("weight").scalar()
        sets = keyed.filter("__hit").select("__k", "__l", "__w").groupBy("__k", "__l").agg(F.first("__w").alias("__w"))
        hits = sets.select("__k", "__l", F.explode("__w").alias("term")).join(model.filter("term <> ''").select("term", "weight"), "term")
        sums = hits.groupBy("__k", "__l").agg(F.sum("weight").alias("__s"))
        got = keyed.join(sums, ["__k", "__l"], "left")
        total = F.when(F.col("__w").isNotNull(), F.coalesce("__s", F.lit(0.0)) + bias)
        verdict = F.when(F.col("__hit").isNull(), F.lit(None).cast("boolean")).when(F.col("__hit"), total > 0).otherwise(False)
        return got.select(*(F.col(c) for c in df.columns if c not in (score, out)), *([total.alias(score)] if score else []), verdict.alias(out))
