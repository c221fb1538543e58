"""Inputs of any size for trials and timings; the same seed gives the same rows, however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(below: int, *seeds) -> Column:
    """A number from 0 to ``below`` - 1 that depends on the seeds only."""
    return F.pmod(F.xxhash64(*(s if isinstance(s, Column) else F.lit(s) for s in seeds)), F.lit(below))


def _share(*seeds) -> Column:
    return _draw(1 << 30, *seeds) / float(1 << 30)


def synthetic_posts(spark: SparkSession, n: int, topics: int = 50, topic_words: int = 8, background_words: int = 4, topic_vocabulary: int = 12, background_vocabulary: int = 2000, seed: int = 1) -> DataFrame:
    """``(doc_id, txt, ts)``: each post has words of its topic and words of all; one post a second."""
    i = F.col("doc_id")
    topic = _draw(topics, seed, i)
    own = F.transform(F.sequence(F.lit(1), F.lit(topic_words)), lambda k: F.concat(F.lit("t"), topic, F.lit("w"), _draw(topic_vocabulary, seed, 1, i, k)))
    more = F.transform(F.sequence(F.lit(1), F.lit(background_words)), lambda k: F.concat(F.lit("b"), _draw(background_vocabulary, seed, 2, i, k)))
    start = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    return spark.range(1, n + 1).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(F.concat(own, more), " ").alias("txt"), F.timestamp_add("SECOND", i, start).alias("ts"))


def synthetic_labels(spark: SparkSession, n: int, keyword_share: float = 0.1, seed: int = 1) -> DataFrame:
    """``(id, txt, is_earthquake)``: a share of texts has the keyword, half of those in the sense that the label means."""
    i = F.col("id")
    keyword, meant = _share(seed, 1, i) < keyword_share, _share(seed, 2, i) < 0.5
    lead = F.when(keyword & meant, F.lit("earthquake shaking felt damage")).when(keyword, F.lit("earthquake movie song game")).otherwise(F.lit("ordinary news today"))
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.lit("w"), _draw(3000, seed, 3, i, k)))
    return spark.range(n).select("id", F.concat_ws(" ", lead, F.array_join(words, " ")).alias("txt"), (keyword & meant).alias("is_earthquake"))


def synthetic_points(spark: SparkSession, n: int, towns: int = 0, side: float = 1.0e6, spread: float = 5.0e3, seed: int = 1) -> DataFrame:
    """``(id, x, y)`` in a square around (0, 0): even, or around that many towns."""
    i = F.col("id")
    x, y = (_share(seed, k, i) * side - side / 2 for k in (1, 2))
    if towns:
        t = _draw(towns, seed, 3, i)
        x, y = ((_share(seed, 4 + k, t) - 0.5) * side + (_share(seed, 6 + k, i) + _share(seed, 8 + k, i) - 1) * spread for k in (0, 1))
    return spark.range(n).select("id", x.alias("x"), y.alias("y"))


def synthetic_times(spark: SparkSession, n: int, days: int = 30, seed: int = 1) -> DataFrame:
    """``(id, ts)`` over that many days."""
    start = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    return spark.range(n).select("id", F.timestamp_add("SECOND", _draw(days * 86400, seed, F.col("id")), start).alias("ts"))
