"""How distinctive each term of a record is, compared with the whole collection.

One operator weighs by the probabilistic relevance formula, idf x tf x (k1 + 1) / (tf + k1 x (1 - b + b x length /
average)). Saturation ends at ``k1 = None`` (the limit for large k1): tf / (1 - b + b x length / average), which with b = 1
and the length counted in terms (average 1) is the plain share of the term in its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Terms that are looked up by broadcast hold at least this share of all (record, term) rows each, so there are at most its inverse of them.
HOT_SHARE = 1 / 50_000


def _idf(kind: str, n: Column, df: Column) -> Column:
    if kind == "probabilistic":
        return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return F.log10(n / df)


def relevance(records: DataFrame, id_col: str, text_col: str, *, k1: float | None = 1.2, b: float = 0.75, idf: str = "probabilistic", average_length: float | None = None, min_df: int = 1, min_score: float | None = None) -> DataFrame:
    """``(id, term, tf, df, score)`` of each term of each record.

    Terms are the maximal runs of [0-9a-z] in the lower-cased text. A record id counts once, with the greatest of its texts (resent
    rows don't add); rows with a null id don't count. Records with null, empty or term-less texts count in the number of records
    and in the average length and give no rows. ``idf`` is "probabilistic" (ln(1 + (N - df + 0.5) / (df + 0.5))) or "log10"
    (log10(N / df)). ``average_length`` replaces the collection's own. Rows with a df under ``min_df`` or a score under
    ``min_score`` are left out. Other columns are ignored, an empty input gives an empty result.
    """
    if idf not in ("probabilistic", "log10"):
        raise ValueError("idf is 'probabilistic' or 'log10'")
    if k1 is not None and (k1 < 0 or not 0 <= b <= 1):
        raise ValueError("k1 must be 0 or more and b between 0 and 1")
    runtime.prepare(records.sparkSession)
    known = records.filter(F.col(id_col).isNotNull())
    once = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(text_col).cast("string")).alias("text"))
    words = F.filter(F.split(F.lower("text"), "[^0-9a-z]+"), lambda w: w != "")
    held = once.select("id", words.alias("words")).select("id", F.size("words").cast("double").alias("length"), F.explode("words").alias("term"))
    # the texts are taken apart once; lengths, document frequencies and scores come from the counted terms
    tf = runtime.cut(held.groupBy("id", "term", "length").agg(F.count("*").cast("int").alias("tf")))
    n = known.select(F.col(id_col).alias("id")).distinct().agg(F.count("*").cast("double")).scalar()
    average = F.lit(float(average_length)) if average_length is not None else tf.agg(F.sum("tf").cast("double")).scalar() / n

    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    norm = F.lit(1.0 - b) + F.lit(float(b)) * F.col("length") / average
    part = F.col("tf") / norm if k1 is None else F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(float(k1)) * norm)
    if min_score is not None and min_score > 0:
        # no term of a df of min_df or more can score higher than this
        tf = tf.filter(part * _idf(idf, n, F.lit(float(min_df))) * (1 + 1e-9) >= min_score)
    rows = _joined(tf, df)
    rows = rows.filter(F.col("df") >= min_df).select("id", "term", "tf", F.col("df").cast("bigint").alias("df"), (part * _idf(idf, n, F.col("df").cast("double"))).alias("score"))
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    return rows.withColumnRenamed("id", id_col)


def _joined(tf: DataFrame, df: DataFrame) -> DataFrame:
    """Adds each term's df. Hot terms are looked up where their rows are, so no task gathers the rows of one of them."""
    least = df.agg(F.greatest(F.ceil(F.sum("df") * F.lit(HOT_SHARE)), F.lit(2))).scalar()
    hot = df.filter(F.col("df") >= least)
    looked = tf.join(F.broadcast(hot.withColumnRenamed("df", "hot_df")), "term", "left")
    known = looked.filter("hot_df IS NOT NULL").withColumnRenamed("hot_df", "df")
    rest = looked.filter("hot_df IS NULL").drop("hot_df").join(df.filter(F.col("df") < least), "term")
    return known.unionByName(rest)
