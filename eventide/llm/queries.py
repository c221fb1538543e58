"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load
from .bitmaps import frequencies, marked
from .condense import clusters, described
from .density import vectors
from .encode import encode
from .hierarchy_sql import CLUSTERS, MEMBERS
from .leaks import leaks
from .quality import not_prose, quality
from .relevance import relevance
from .sets import expanded, similar_sets
from .topn import top_n

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(load(spark, sf, "tfidf_from_python"), "doc_id", "term", "weight", 3).select("doc_id", "term")


ORACLES["p6_found"] = """
WITH clean AS (
  SELECT doc_id, term, max(weight) AS w FROM tfidf_from_python
  WHERE doc_id IS NOT NULL AND trim(term, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND isfinite(weight)
  GROUP BY doc_id, term)
SELECT doc_id, term FROM clean
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, encode(term)) <= 3
"""


def _clean_term(c):
    return F.lower(F.trim(c))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "df_tbl").filter("df >= 1").filter(F.length(F.translate("term", " \t\r\n", "")) > 0)
    return marked(frequencies(rows, "batch_id", "term", "df", _clean_term), 2, 1 / 200).withColumnRenamed("value", "term")


@query
def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "df_tbl").filter("df >= 1").filter(F.length(F.translate("term", " \t\r\n", "")) > 0)
    return frequencies(rows, "batch_id", "term", "df", _clean_term).select(F.col("value").alias("term"), F.col("occurrences").alias("df"), "records")


_P5 = """
WITH clean AS (
  SELECT DISTINCT batch_id, term, df FROM df_tbl
  WHERE df >= 1 AND trim(term, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
total AS (SELECT lower(trim(term)) AS term, sum(df)::BIGINT AS df, count(DISTINCT batch_id) + max((batch_id IS NULL)::INT) AS records FROM clean GROUP BY 1)
"""
ORACLES["p5_terms"] = _P5 + "SELECT term, df, records FROM total"
ORACLES["p5_found"] = (
    _P5
    + """
SELECT term, 'rare' AS mark FROM total WHERE df <= 2
UNION ALL
SELECT term, 'common' AS mark FROM total WHERE df * 200 > (SELECT sum(df) FROM total)
"""
)


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The plain share of a term is the relevance weight without saturation (k1 unbounded), at full length normalisation (b = 1)."""
    rows = relevance(load(spark, sf, "test_data"), "doc_id", "txt", k1=None, b=1.0, idf="log10", average_length=1.0, min_df=2, min_score=0.31)
    return rows.select("doc_id", "term")


@query
def p4_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = relevance(load(spark, sf, "test_data"), "doc_id", "txt")
    return rows.select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"))


_P4 = """
WITH once AS (SELECT doc_id, max(txt) AS txt FROM test_data WHERE doc_id IS NOT NULL GROUP BY doc_id),
terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(txt), '[0-9a-z]+')) AS term FROM once),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT count(*) AS n, (SELECT sum(len) FROM len) / count(*) AS average FROM once)
"""
ORACLES["p4_found"] = _P4 + "SELECT doc_id, term FROM tf JOIN len USING (doc_id) JOIN df USING (term), n WHERE df >= 2 AND tf / len * log10(n / df) >= 0.31"
ORACLES["p4_relevance"] = (
    _P4
    + """
SELECT doc_id, term, tf::INT AS tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average)), 6) AS score
FROM tf JOIN len USING (doc_id) JOIN df USING (term), n
"""
)


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = [(load(spark, sf, name), "did", "terms") for name in ("docs", "cte_docs_arr")]
    pairs = expanded(*similar_sets(tables, 0.6))
    return pairs.select(F.col("a").cast("int").alias("did_a"), F.col("b").cast("int").alias("did_b"))


def _cluster_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "centroid_tbl").join(load(spark, sf, "output_tbl").select("cid"), "cid", "left_semi")
    return vectors(rows, "cid", "term", "weight")


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = clusters(_cluster_vectors(spark, sf), 0.7)
    return groups.filter("id <> group").select(F.col("group").cast("int").alias("lead"), F.col("id").cast("int").alias("cid"))


def _item_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "eval_items"), "item_id", "text", least=13)


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _item_leaks(spark, sf).select("doc_id", "item_id")


@query
def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _item_leaks(spark, sf)


@query
def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of the documents that remain once affected ones are removed."""
    return load(spark, sf, "documents").select("doc_id").join(_item_leaks(spark, sf).select("doc_id").distinct(), "doc_id", "left_anti")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(load(spark, sf, "documents"), "doc_id", "text", load(spark, sf, "common_words"), "word")


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(_quality(spark, sf)).select("doc_id")


@query
def p9_quality(spark: SparkSession, sf: str) -> DataFrame:
    ratios = ("mean_word_length", "symbol_ratio", "punctuated_share", "common_share")
    return _quality(spark, sf).select("doc_id", "words", *(F.round(c, 6).alias(c) for c in ratios))


_P9 = """
WITH white AS (SELECT ' ' || chr(9) || chr(10) || chr(13) AS w),
listed AS (SELECT DISTINCT word FROM common_words WHERE word <> ''),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, count(*) AS words, avg(length(word)) AS mean_word_length,
         avg((regexp_replace(lower(word), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') IN (SELECT word FROM listed))::INT) AS common_share
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS word FROM d) GROUP BY doc_id),
l AS (
  SELECT doc_id, avg((right(line, 1) IN ('.', '!', '?', '…'))::INT) AS punctuated_share
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), (SELECT w FROM white)) AS line FROM d) WHERE line <> '' GROUP BY doc_id),
s AS (
  SELECT doc_id, (solid - length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) / nullif(solid, 0) AS symbol_ratio
  FROM (SELECT *, length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) AS solid FROM d)),
q AS (SELECT d.doc_id, coalesce(words, 0)::BIGINT AS words, mean_word_length, CASE WHEN words > 0 THEN symbol_ratio END AS symbol_ratio, punctuated_share, common_share
  FROM d LEFT JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id))
"""
ORACLES["p9_quality"] = _P9 + "SELECT doc_id, words, round(mean_word_length, 6) AS mean_word_length, round(symbol_ratio, 6) AS symbol_ratio, round(punctuated_share, 6) AS punctuated_share, round(common_share, 6) AS common_share FROM q"
ORACLES["p9_found"] = (
    _P9
    + """
SELECT doc_id FROM q
WHERE words > 0 AND (mean_word_length < 3.5 OR mean_word_length > 8.5)::INT + (symbol_ratio > 0.15)::INT + (punctuated_share < 0.5)::INT + (common_share < 0.15)::INT >= 2
"""
)

_P8 = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items WHERE item_id IS NOT NULL),
a AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w)),
b AS (SELECT item_id, k, array_to_string(ws[k : k + 12], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM v)),
f AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s))
"""
ORACLES["p8_leaks"] = (
    _P8
    + """, m AS (SELECT doc_id, item_id, a.k AS k, a.k - b.k AS diagonal FROM a JOIN b USING (s)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS island FROM m),
r AS (SELECT doc_id, item_id, (count(*) + 12)::INT AS words, (min(k) - 1)::BIGINT AS "at" FROM g GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, words, "at" FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, "at") = 1
"""
)
ORACLES["p8_found"] = _P8 + "SELECT doc_id, item_id FROM f"
ORACLES["p8_kept"] = _P8 + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)"


@query
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(load(spark, sf, "documents"), "doc_id", "text", vocabulary="byte_bpe_50k")

_P2 = """
WITH r AS (SELECT did, terms FROM docs UNION ALL SELECT did, terms FROM cte_docs_arr),
t AS (SELECT DISTINCT did, lower(trim(term)) AS term FROM (SELECT did, unnest(terms) AS term FROM r) WHERE trim(term) <> ''),
n AS (SELECT did, count(*) AS n FROM t GROUP BY did),
o AS (SELECT a.did AS did_a, b.did AS did_b, count(*) AS o FROM t a JOIN t b ON a.term = b.term AND a.did < b.did GROUP BY ALL)
"""
ORACLES["p2_found"] = _P2 + "SELECT did_a, did_b FROM o JOIN n a ON a.did = did_a JOIN n b ON b.did = did_b WHERE o * 10 >= 6 * (a.n + b.n - o)"
ORACLES["p3_found"] = """
WITH RECURSIVE c AS (
  SELECT DISTINCT cid, lower(trim(term)) AS term, weight AS w FROM centroid_tbl
  WHERE isfinite(weight) AND weight > 0 AND trim(term) <> '' AND cid IN (SELECT cid FROM output_tbl)),
v AS (SELECT cid, term, w / sqrt(sum(w * w) OVER (PARTITION BY cid)) AS w FROM (SELECT cid, term, sum(w) AS w FROM c GROUP BY ALL)),
e AS (SELECT a.cid AS a, b.cid AS b FROM v a JOIN v b ON a.term = b.term AND a.cid <> b.cid GROUP BY ALL HAVING sum(a.w * b.w) >= 0.7),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT min(b) AS lead, a AS cid FROM reach GROUP BY a HAVING min(b) < a
"""


@query
def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(_cluster_vectors(spark, sf), 0.7).select("lead", "id", F.round("persistence", 6).alias("persistence"))


@query
def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    got = described(clusters(_cluster_vectors(spark, sf), 0.7), load(spark, sf, "output_tbl"), "cid", "doc_count")
    return got.withColumn("exemplars", F.array_join("exemplars", " "))


ORACLES["p3_members"], ORACLES["p3_clusters"] = MEMBERS, CLUSTERS
