"""TF-IDF tables and an incremental model that keeps only document frequencies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import save_table
from .tokenize import terms_of, tokenize


def tfidf(df: DataFrame, id_col: str, text_col: str, config: str = "simple", save_as: str | None = None, overwrite: bool = False) -> DataFrame:
    """``(id, term, weight)``: (count / terms of the document) x log10(N / df).

    ``text_col`` is a text, or an array of terms that is used as it is. N is the number of rows of the input, also those with null or
    term-less texts, which give no rows themselves. A term of every document weighs 0. Rows of one id are one document for the counts,
    but each counts in N. Null terms in an array are dropped. The table is saved under ``save_as`` if given.
    """
    words = F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config))
    # texts are taken apart once: lengths and document frequencies come from the counted terms
    tc = df.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tc"))
    size = tc.groupBy("id").agg(F.sum("tc").alias("size"))
    dfs = tc.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").cast("double").alias("n")).scalar()
    out = tc.join(size, "id").join(dfs, "term").select(F.col("id").alias(id_col), "term", (F.col("tc") / F.col("size") * F.log10(n / F.col("df"))).alias("weight"))
    if save_as:
        save_table({save_as: out}, overwrite)
    return out


def document_frequencies(df: DataFrame, text_col: str, config: str = "simple") -> DataFrame:
    """``(term, document_count)``."""
    words = F.array_distinct(F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config)))
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("document_count"))


class TfIdfModel:
    """Document frequencies and the number of documents; new documents only add to them.

    ``base`` 10 gives the table's weights, ``base`` None the natural logarithm of the row-at-a-time form. Terms never seen have an idf of 0.
    """

    def __init__(self, frequencies: DataFrame, total: int):
        self.frequencies, self.total = frequencies, total

    @staticmethod
    def fit(df: DataFrame, text_col: str, config: str = "simple", count_empty: bool = True) -> "TfIdfModel":
        """``count_empty`` False leaves documents without terms out of N."""
        counted = df
        if not count_empty:
            counted = df.filter(F.coalesce(F.size(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config)), F.lit(0)) > 0)
        return TfIdfModel(document_frequencies(df, text_col, config), counted.count())

    def insert(self, df: DataFrame, text_col: str, config: str = "simple") -> "TfIdfModel":
        more = document_frequencies(df, text_col, config)
        both = self.frequencies.unionByName(more).groupBy("term").agg(F.sum("document_count").alias("document_count"))
        return TfIdfModel(both, self.total + df.count())

    def insert_counts(self, counts: DataFrame, id_col: str) -> "TfIdfModel":
        """As ``insert``, for documents given as rows (id, term, count); rows with a count under 1 or a null term don't count."""
        fit = counts.filter("term IS NOT NULL AND count >= 1")
        more = fit.groupBy("term").agg(F.count_distinct(id_col).alias("document_count"))
        both = self.frequencies.unionByName(more).groupBy("term").agg(F.sum("document_count").alias("document_count"))
        return TfIdfModel(both, self.total + counts.select(id_col).distinct().count())

    def listed(self) -> DataFrame:
        """``(term, document_count)``, the most frequent first; ties by term."""
        return self.frequencies.select("term", "document_count").orderBy(F.desc("document_count"), "term")

    def df_of(self, term: str) -> int:
        """Documents with the term."""
        row = self.frequencies.filter(F.col("term") == term).first()
        return row["document_count"] if row else 0

    def idf_of(self, term: str, base: int | None = 10) -> float:
        """0 for a term never seen."""
        n = self.df_of(term)
        if not n or not self.total:
            return 0.0
        return math.log10(self.total / n) if base == 10 else math.log(self.total / n)

    @staticmethod
    def tf_of(text: str | None, term: str, config: str = "simple") -> float:
        """Share of the term among the terms of a text; 0 for a text without terms."""
        counts = tokenize(text, "dict", config)
        total = sum(counts.values())
        return counts.get(term, 0) / total if total else 0.0

    def tfidf_of(self, text: str | None, term: str, config: str = "simple") -> float:
        return self.tf_of(text, term, config) * self.idf_of(term)

    def vector_of(self, text: str | list | dict | None, config: str = "simple") -> dict[str, float]:
        """Weights of one text, or of its term counts."""
        counts = tokenize(text, "dict", config)
        total = sum(counts.values())
        known = {r["term"]: r["idf"] for r in self.idf().filter(F.col("term").isin(*counts)).collect()} if counts else {}
        return {t: n / total * known.get(t, 0.0) for t, n in counts.items()}

    def idf(self, base: int | None = 10) -> DataFrame:
        ratio = F.lit(float(self.total)) / F.col("document_count")
        value = F.log10(ratio) if base == 10 else F.log(ratio)
        return self.frequencies.select("term", (value if self.total else F.lit(0.0)).alias("idf"))

    def stats(self) -> dict[str, int]:
        return {"total_documents": self.total, "distinct_terms": self.frequencies.count()}

    def weights(self, df: DataFrame, id_col: str, text_col: str, config: str = "simple", base: int | None = 10, normalised: bool = True) -> DataFrame:
        """``(id, term, weight)`` of documents by this model; ``normalised`` divides occurrences by the document's terms."""
        words = F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config))
        rows = df.select(F.col(id_col).alias("id"), F.size(words).alias("size"), F.explode(words).alias("term"))
        tf = rows.groupBy("id", "size", "term").agg(F.count("*").alias("tf")).join(self.idf(base), "term", "left")
        part = F.col("tf") / F.col("size") if normalised else F.col("tf")
        return tf.select(F.col("id").alias(id_col), "term", (part * F.coalesce("idf", F.lit(0.0))).alias("weight"))

    def vectorize(self, df: DataFrame, id_col: str, text_col: str, config: str = "simple") -> DataFrame:
        """``(id, vector)``: the natural-logarithm weights of each row's distinct terms as a sorted array of (term, weight); empty without terms."""
        words = F.array_distinct(F.array_compact(terms_of(F.col(text_col), dict(df.dtypes)[text_col], config)))
        rows = df.select(F.col(id_col), F.explode_outer(words).alias("term")).join(self.idf(None), "term", "left")
        pair = F.when(F.col("term").isNotNull(), F.struct("term", F.coalesce("idf", F.lit(0.0)).alias("weight")))
        return rows.groupBy(id_col).agg(F.array_sort(F.collect_list(pair)).alias("vector"))
