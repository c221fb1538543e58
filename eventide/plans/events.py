"""Queries of the event operators, over the whole of their tables."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..functions import register, register_model
from ..operators import aggregates, cluster, eventtype, grid, tfidf, tokenize
from ..sources import lines, load, save_files
from .passes import ASSIGNED, bucket_pass, cosine_pass, distance_pass, jaccard_pass
from .stems import english_terms

QUERIES, ORACLES = {}, {}
KEYWORDS = ["flood", "fire", "water", "police"]


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# --- time and space ---------------------------------------------------------------------------------------------------


def _periods(name: str, length: timedelta, shift: timedelta | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = grid.time_partition(F.col("ts"), length, shift)
        return load(spark, sf, "events").select(p.alias("p"), "user_id").groupBy("p.start_timestamp", "p.end_timestamp").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))

    micro, moved = length // timedelta(microseconds=1), (shift or timedelta()) // timedelta(microseconds=1)
    start = f"(floor((epoch_us(ts) - ({moved}))::DOUBLE / {micro})::BIGINT * {micro} + ({moved}))"
    sql = f"SELECT make_timestamp({start}) AS start_timestamp, make_timestamp({start} + {micro}) AS end_timestamp, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"
    query(sql, name)(run)


for _name, _args in {
    "time_15m": (timedelta(minutes=15),),
    "time_30m": (timedelta(minutes=30),),
    "time_1h": (timedelta(hours=1),),
    "time_6h": (timedelta(hours=6),),
    "time_24h": (timedelta(hours=24),),
    "time_15m_plus": (timedelta(minutes=15), timedelta(minutes=10)),
    "time_15m_minus": (timedelta(minutes=15), timedelta(minutes=-10)),
    "time_12h_plus": (timedelta(hours=12), timedelta(hours=5)),
}.items():
    _periods(_name, *_args)

_PLACES = "spatial_partition_eval_results WHERE abs(x) <= 20037508.35 AND abs(y) <= 20037508.35 AND isfinite(x) AND isfinite(y)"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "spatial_partition_eval_results").filter("abs(x) <= 20037508.35 AND abs(y) <= 20037508.35 AND NOT isnan(x) AND NOT isnan(y)")


def _cells(name: str, cell: float, s_x: float = 0.0, s_y: float = 0.0) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = grid.spatial_partition(F.col("x"), F.col("y"), cell, s_x, s_y)
        return _places(spark, sf).select(c.alias("c")).groupBy(F.col("c.x").alias("cell_x"), F.col("c.y").alias("cell_y")).agg(F.count("*").alias("n"))

    query(f"SELECT floor((x - ({s_x})) / {cell})::INT AS cell_x, floor((y - ({s_y})) / {cell})::INT AS cell_y, count(*) AS n FROM {_PLACES} GROUP BY ALL", name)(run)


_cells("space_1km", 1000.0)
_cells("space_10km", 10000.0)
_cells("space_shifted", 1000.0, 500.0, -500.0)
_cells("space_odd", 1500.5)


@query("SELECT id, CASE WHEN isfinite(cell_length) AND cell_length > 0 AND isfinite(x) AND abs(floor(x / cell_length)) < 2147483648 THEN floor(x / cell_length)::INT END AS cell_x, CASE WHEN isfinite(cell_length) AND cell_length > 0 AND isfinite(y) AND abs(floor(y / cell_length)) < 2147483648 THEN floor(y / cell_length)::INT END AS cell_y FROM spatial_partition_eval_results")
def space_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of each row's own length; unusable lengths and coordinates give null."""
    c = grid.spatial_partition(F.col("x"), F.col("y"), F.col("cell_length"), on_invalid="null")
    return load(spark, sf, "spatial_partition_eval_results").select("id", c.alias("c")).select("id", F.col("c.x").alias("cell_x"), F.col("c.y").alias("cell_y"))


@query(f"""WITH p AS (SELECT x, y FROM {_PLACES}),
  a AS (SELECT x, y, unnest(CASE WHEN floor(x / 100) * 100 = x THEN [floor(x / 100) - 1, floor(x / 100)] ELSE [floor(x / 100)] END) AS cx FROM p),
  b AS (SELECT cx, unnest(CASE WHEN floor(y / 100) * 100 = y THEN [floor(y / 100) - 1, floor(y / 100)] ELSE [floor(y / 100)] END) AS cy FROM a)
  SELECT cx::BIGINT AS cell_x, cy::BIGINT AS cell_y, count(*) AS n FROM b GROUP BY ALL""")
def space_squares(spark: SparkSession, sf: str) -> DataFrame:
    return grid.grid_join(_places(spark, sf), "x", "y", 100.0).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(6378137 * radians(lon), 4) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y
  FROM (SELECT event_id, (user_id % 360 - 180)::DOUBLE AS lon, (value % 160 - 80)::DOUBLE AS lat FROM events)""")
def mercator(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees made of the event columns, as the events have no place."""
    lon, lat = (F.col("user_id") % 360 - 180).cast("double"), (F.col("value") % 160 - 80).cast("double")
    m = grid.to_web_mercator(lon, lat)
    return load(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


@query("""SELECT make_timestamp((floor(epoch_us(ts)::DOUBLE / 21600000000) * 21600000000)::BIGINT) AS start_timestamp, floor(x / 100000)::INT AS cell_x, floor(y / 100000)::INT AS cell_y,
    count(*) AS docs, count(DISTINCT username) AS users
  FROM documents WHERE isfinite(x) AND isfinite(y) GROUP BY ALL""")
def spacetime_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('infinity') AND abs(y) < double('infinity')")
    p, c = grid.time_partition(F.col("ts"), timedelta(hours=6)), grid.spatial_partition(F.col("x"), F.col("y"), 100000.0)
    rows = docs.select(p.alias("p"), c.alias("c"), "username")
    return rows.groupBy("p.start_timestamp", F.col("c.x").alias("cell_x"), F.col("c.y").alias("cell_y")).agg(F.count("*").alias("docs"), F.count_distinct("username").alias("users"))


@query("SELECT make_timestamp((floor(epoch_us(ts)::DOUBLE / 3600000000) * 3600000000)::BIGINT) AS start_timestamp, count(*) AS n FROM test_data GROUP BY ALL")
def time_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of rows of which some have no time."""
    return load(spark, sf, "test_data").groupBy(grid.time_partition(F.col("ts"), timedelta(hours=1))["start_timestamp"].alias("start_timestamp")).agg(F.count("*").alias("n"))


@query("SELECT make_timestamp((floor((epoch_us(ts) - 300000000)::DOUBLE / 1800000000) * 1800000000)::BIGINT + 300000000) AS start_timestamp, count(*) AS n FROM test_data GROUP BY ALL")
def sql_periods(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    load(spark, sf, "test_data").createOrReplaceTempView("__test_data")
    return spark.sql("SELECT time_partition(ts, INTERVAL '30' MINUTE, INTERVAL '5' MINUTE).start_timestamp AS start_timestamp, count(*) AS n FROM __test_data GROUP BY 1")


@query("SELECT floor(x / cell_length)::INT AS cell_x, floor(y / cell_length)::INT AS cell_y, count(*) AS n FROM spatial_partition_eval_results WHERE isfinite(cell_length) AND cell_length > 0 AND abs(floor(x / cell_length)) < 2147483648 AND abs(floor(y / cell_length)) < 2147483648 AND isfinite(x) AND isfinite(y) GROUP BY ALL")
def space_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The set-returning form: rows whose length or place is unusable have no cell."""
    return grid.cell_rows(load(spark, sf, "spatial_partition_eval_results"), "x", "y", "cell_length").groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


@query(f"SELECT floor(x / 2500)::INT AS cell_x, floor(y / 2500)::INT AS cell_y, count(*) AS n FROM {_PLACES} GROUP BY ALL")
def sql_space_rows(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    _places(spark, sf).createOrReplaceTempView("__places")
    return spark.sql("SELECT c.cell_x, c.cell_y, count(*) AS n FROM __places, LATERAL spatial_partition_rows(x, y, 2500D) AS c GROUP BY 1, 2")


# --- terms and weights ------------------------------------------------------------------------------------------------

_TERMS = "regexp_extract_all(lower(text), '[0-9a-z]+')"
_POSTS = "posts AS (SELECT doc_id, max(txt) AS txt, min(ts) AS ts FROM test_data WHERE doc_id IS NOT NULL GROUP BY doc_id)"


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """The short posts, a post sent again counted once (its earliest time)."""
    return load(spark, sf, "test_data").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("txt").alias("txt"), F.min("ts").alias("ts"))


@query(f"SELECT doc_id, term, count(*)::INT AS count FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.process_text(load(spark, sf, "documents"), "text", ["doc_id"])


@query("WITH " + english_terms("documents", "doc_id", "text") + " SELECT doc_id, term, count(*)::INT AS count FROM et GROUP BY ALL")
def term_counts_english(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.process_text(load(spark, sf, "documents"), "text", ["doc_id"], "english")


@query(f"SELECT doc_id, len({_TERMS})::INT AS terms, len(list_distinct({_TERMS}))::INT AS distinct_terms FROM documents")
def vector_sizes(spark: SparkSession, sf: str) -> DataFrame:
    words = tokenize.simple_terms(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(words).alias("terms"), F.size(F.array_distinct(words)).alias("distinct_terms"))


def _weights_sql(source: str, text: str) -> str:
    return f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower({text}), '[0-9a-z]+')) AS term FROM {source}),
  tc AS (SELECT doc_id, term, count(*) AS tc FROM t GROUP BY ALL),
  size AS (SELECT doc_id, sum(tc) AS size FROM tc GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tc GROUP BY ALL),
  w AS (SELECT doc_id, term, tc, df, tc / size * log10((SELECT count(*) FROM {source}) / df) AS weight FROM tc JOIN size USING (doc_id) JOIN df USING (term))"""


@query(f"WITH {_weights_sql('documents', 'text')} SELECT doc_id, term, round(weight, 8) AS weight FROM w")
def tfidf_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.tfidf(load(spark, sf, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 8))


@query(f"WITH {_POSTS}, {_weights_sql('posts', 'txt')} SELECT doc_id, term, round(weight, 8) AS weight FROM w")
def tfidf_posts(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.tfidf(posts(spark, sf), "doc_id", "txt").withColumn("weight", F.round("weight", 8))


@query(f"""WITH {_POSTS}, {english_terms("posts", "doc_id", "txt")},
  tc AS (SELECT doc_id, term, count(*) AS tc FROM et GROUP BY ALL), size AS (SELECT doc_id, sum(tc) AS size FROM tc GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tc GROUP BY ALL)
  SELECT doc_id, term, round(tc / size * log10((SELECT count(*) FROM posts) / df), 8) AS weight FROM tc JOIN size USING (doc_id) JOIN df USING (term)""")
def tfidf_english(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.tfidf(posts(spark, sf), "doc_id", "txt", "english").withColumn("weight", F.round("weight", 8))


@query(f"""WITH {_POSTS}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(txt), '[0-9a-z]+')) AS term FROM posts)
  SELECT term, count(*) AS document_count, round(log10((SELECT count(*) FROM posts) / count(*)), 8) AS idf FROM t GROUP BY term""")
def idf_model(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on even ids, then given the odd ones: the same as at once."""
    p = posts(spark, sf)
    model = tfidf.TfIdfModel.fit(p.filter("doc_id % 2 = 0"), "txt").insert(p.filter("doc_id % 2 <> 0"), "txt")
    return model.frequencies.join(model.idf(), "term").select("term", "document_count", F.round("idf", 8).alias("idf"))


@query(f"""WITH {_POSTS}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(txt), '[0-9a-z]+')) AS term FROM posts),
  f AS (SELECT term, ln((SELECT count(*) FROM posts) / count(*)) AS w FROM t GROUP BY term)
  SELECT doc_id, coalesce(string_agg(term || ':' || round(w, 6)::DECIMAL(12, 6), ' ' ORDER BY term), '') AS vector FROM posts LEFT JOIN t USING (doc_id) LEFT JOIN f USING (term) GROUP BY doc_id""")
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    v = tfidf.TfIdfModel.fit(p, "txt").vectorize(p, "doc_id", "txt")
    text = F.array_join(F.transform("vector", lambda s: F.concat(s["term"], F.lit(":"), F.round(s["weight"], 6).cast("decimal(12,6)").cast("string"))), " ")
    return v.select("doc_id", text.alias("vector"))


@query(f"""WITH {_POSTS}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(txt), '[0-9a-z]+')) AS term FROM posts)
  SELECT term, count(*) AS n FROM t GROUP BY term""")
def sql_process_text(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    posts(spark, sf).createOrReplaceTempView("__posts")
    return spark.sql("SELECT t.term, sum(t.count) AS n FROM __posts, LATERAL process_text(txt) AS t GROUP BY t.term")


# --- files ------------------------------------------------------------------------------------------------------------


@query("SELECT txt, count(*) AS n, count(DISTINCT txt) AS ids FROM (SELECT source AS txt FROM documents WHERE source IS NOT NULL) GROUP BY txt")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A text file with a document per line, written and read again."""
    path = f"{runtime.work_folder(spark)}/lines-{uuid.uuid4().hex}"
    load(spark, sf, "documents").filter("source IS NOT NULL").select("source").write.text(path)
    got = lines(spark, path)
    return got.groupBy("txt").agg(F.count("*").alias("n"), (F.count_distinct("doc_id") / F.count("*")).cast("bigint").alias("ids"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV and as JSON; what both give back."""
    path = f"{runtime.work_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for kind in ("csv", "json"):
        save_files(rows, f"{path}/{kind}", kind)
    shape = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return spark.read.schema(shape).option("header", True).csv(f"{path}/csv").intersect(spark.read.schema(shape).json(f"{path}/json"))


# --- groups -----------------------------------------------------------------------------------------------------------


def _entropy_sql(keys: str, config: str = "documents", text: str = "text") -> str:
    return f"""WITH d AS (SELECT {keys}, {text} AS text FROM {config}), g AS (SELECT DISTINCT {keys} FROM d),
  n AS (SELECT {keys}, term, count(*) AS n FROM (SELECT {keys}, unnest({_TERMS}) AS term FROM d) GROUP BY ALL),
  t AS (SELECT {keys}, sum(n) AS t FROM n GROUP BY ALL),
  h AS (SELECT n.{keys}, sum(n / t * log2(t / n)) AS h FROM n JOIN t ON n.{keys} IS NOT DISTINCT FROM t.{keys} GROUP BY ALL)
  SELECT g.{keys}, round(coalesce(h, 0), 6) AS entropy FROM g LEFT JOIN h ON g.{keys} IS NOT DISTINCT FROM h.{keys}"""


def _grouped(key: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return aggregates.entropy(load(spark, sf, "documents"), [key], "text").withColumn("entropy", F.round("entropy", 6))

    query(_entropy_sql(key), f"entropy_{key}")(run)
    for least in (2, 3):

        def count(spark: SparkSession, sf: str, least: int = least) -> DataFrame:
            return aggregates.shared_terms(load(spark, sf, "documents"), [key], "text", least)

        query(
            f"""WITH n AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY ALL),
  c AS (SELECT {key}, count(*) FILTER (n >= {least}) AS c FROM n GROUP BY ALL), g AS (SELECT DISTINCT {key} FROM documents)
  SELECT g.{key}, coalesce(c, 0)::INT AS shared_terms FROM g LEFT JOIN c ON g.{key} IS NOT DISTINCT FROM c.{key}""",
            f"shared_{least}_{key}",
        )(count)


_grouped("source")
_grouped("lang")


@query(f"""WITH {english_terms("documents", "source", "text")}, g AS (SELECT DISTINCT source FROM documents),
  n AS (SELECT source, term, count(*) AS n FROM et GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM n GROUP BY ALL),
  h AS (SELECT n.source, sum(n / t * log2(t / n)) AS h FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
  SELECT g.source, round(coalesce(h, 0), 6) AS entropy FROM g LEFT JOIN h ON g.source IS NOT DISTINCT FROM h.source""")
def entropy_english(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.entropy(load(spark, sf, "documents"), ["source"], "text", "english").withColumn("entropy", F.round("entropy", 6))


@query(_entropy_sql("source").replace("AS entropy", "AS entropy, coalesce((SELECT count(*) FROM documents d2 WHERE d2.source IS NOT DISTINCT FROM g.source), 0) AS docs"))
def sql_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregate in SQL text, next to others."""
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT source, round(term_entropy(text_terms(text)), 6) AS entropy, n AS docs FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM __documents) GROUP BY source, n")


@query(f"WITH n AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY ALL), c AS (SELECT source, count(*) FILTER (n >= 2) AS c FROM n GROUP BY ALL) SELECT g.source, coalesce(c, 0)::INT AS shared FROM (SELECT DISTINCT source FROM documents) g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source")
def sql_shared_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregate in SQL text, over term arrays."""
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT source, shared_terms(text_terms(text), 2) AS shared FROM __documents GROUP BY source")


@query(f"""WITH k AS (SELECT lang, unnest({_TERMS}) AS term FROM documents), n AS (SELECT lang, term, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT lang, sum(n) AS t FROM n GROUP BY ALL),
  h AS (SELECT n.lang, sum(n / t * log2(t / n)) AS h FROM n JOIN t ON n.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL),
  d AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY ALL), c AS (SELECT lang, count(*) FILTER (n >= 3) AS c FROM d GROUP BY ALL)
  SELECT g.lang, round(coalesce(h, 0), 6) AS entropy, coalesce(c, 0)::INT AS shared FROM (SELECT DISTINCT lang FROM documents) g LEFT JOIN h ON g.lang IS NOT DISTINCT FROM h.lang LEFT JOIN c ON g.lang IS NOT DISTINCT FROM c.lang""")
def sql_text_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Both aggregates straight from texts."""
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT lang, round(term_entropy(text), 6) AS entropy, shared_terms(text, 3) AS shared FROM __documents GROUP BY lang")


@query(_entropy_sql("source"))
def entropy_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy over stored term vectors."""
    d = load(spark, sf, "documents").select("source", tokenize.term_vector(tokenize.simple_terms(F.col("text"))).alias("v"))
    return aggregates.entropy(d, ["source"], "v").withColumn("entropy", F.round("entropy", 6))


@query(ORACLES["shared_2_source"])
def shared_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Shared terms over stored term vectors."""
    d = load(spark, sf, "documents").select("source", tokenize.term_vector(tokenize.simple_terms(F.col("text"))).alias("v"))
    return aggregates.shared_terms(d, ["source"], "v", 2)


@query(f"""WITH {_POSTS}, d AS (SELECT *, list_distinct({_TERMS.replace('text', 'txt')}) AS w FROM posts)
  SELECT doc_id, len(w)::INT AS n, len(list_filter(w, lambda x: x NOT IN ('flood', 'fire')))::INT AS without, CASE WHEN w IS NOT NULL THEN list_has_any(w, ['flood', 'fire']) END AS hit,
    array_to_string(list_sort(list_filter(w, lambda x: x NOT IN ('flood', 'fire'))), ' ') AS stripped, len(list_filter({_TERMS.replace('text', 'txt')}, lambda x: x = 'flood'))::INT AS flood FROM d""")
def vector_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Length, deletion, match, stripping and the frequency of a term, on term vectors of the posts."""
    words = tokenize.simple_terms(F.col("txt"))
    v = tokenize.term_vector(words)
    rest = tokenize.strip(tokenize.delete(v, ["flood", "fire"]))
    text = F.array_join(F.transform(rest, lambda s: F.concat(s["lexeme"], F.when(s["n"] > 0, F.lit("!")).otherwise(F.lit("")))), " ")
    return posts(spark, sf).select("doc_id", tokenize.length(v).alias("n"), tokenize.length(rest).alias("without"), tokenize.matches(v, ["flood", "fire"]).alias("hit"), text.alias("stripped"), tokenize.term_frequency(words, "flood").alias("flood"))


@query(f"WITH {_POSTS} SELECT DISTINCT doc_id, unnest({_TERMS.replace('text', 'txt')}) AS term, 1 AS count FROM posts")
def distinct_terms(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.distinct_terms(posts(spark, sf), "txt", ["doc_id"])


@query("SELECT NULL::INT AS doc_id, NULL::VARCHAR AS term, 0::BIGINT AS table_count, 0::BIGINT AS driver_count WHERE false")
def tokenizer_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose terms differ between the distributed tokenizer and the driver's: none."""
    return tokenize.tokenizer_differences(posts(spark, sf), "doc_id", "txt")


@query(f"WITH {_POSTS}, t AS (SELECT DISTINCT doc_id, unnest({_TERMS.replace('text', 'txt')}) AS term FROM posts) SELECT term, count(*) AS document_count FROM t GROUP BY term")
def model_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of a model that leaves term-less texts out of its number of documents."""
    return tfidf.TfIdfModel.fit(posts(spark, sf), "txt", count_empty=False).listed()


@query("WITH " + english_terms("documents", "doc_id", "text") + " SELECT doc_id, count(*) AS terms, count(DISTINCT term) AS stems FROM et GROUP BY ALL")
def sql_process_english(spark: SparkSession, sf: str) -> DataFrame:
    """The table function in SQL text with the config "english"."""
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, CAST(sum(t.count) AS BIGINT) AS terms, count(*) AS stems FROM __documents, LATERAL process_text(text, 'english') AS t GROUP BY doc_id")


# --- event types ------------------------------------------------------------------------------------------------------

_KW = "['fire', 'flood', 'police', 'water']"


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(list_intersect(list_distinct({_TERMS}), {_KW}))::INT END AS overlap, CASE WHEN text IS NOT NULL THEN list_has_any({_TERMS}, {_KW}) END AS hit FROM documents")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select("doc_id", eventtype.overlap(d, "text", KEYWORDS).alias("overlap"), eventtype.has_keyword(d, "text", KEYWORDS).alias("hit"))


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(list_intersect(list_distinct({_TERMS}), {_KW}))::INT END AS overlap FROM documents WHERE list_has_any({_TERMS}, {_KW})")
def sql_keywords(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, keyword_overlap(text, 'fire flood police water') AS overlap FROM __documents WHERE has_keyword(text, 'fire flood police water')")


@query("WITH " + english_terms("documents", "doc_id", "text") + """, k AS (SELECT DISTINCT stem FROM stemmed WHERE word IN ('fires', 'flooding', 'police', 'waters')),
  n AS (SELECT doc_id, count(DISTINCT term) AS n FROM et WHERE term IN ('fire', 'flood', 'polic', 'water') GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0)::INT AS overlap, coalesce(n, 0) > 0 AS hit FROM documents LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL""")
def sql_keywords_english(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords in other forms of their words, by stems."""
    register(spark)
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    words = "'fires flooding police waters', 'english'"
    return spark.sql(f"SELECT doc_id, keyword_overlap(text, {words}) AS overlap, has_keyword(text, {words}) AS hit FROM __documents WHERE text IS NOT NULL")


@query("SELECT did, min(CASE WHEN terms IS NOT NULL THEN len(list_intersect(list_distinct(list_filter(terms, lambda x: x IS NOT NULL)), ['fire', 'flood', 'storm', 'water']))::INT END) AS overlap, min(CASE WHEN terms IS NOT NULL THEN list_has_any(list_filter(terms, lambda x: x IS NOT NULL), ['fire', 'flood', 'storm', 'water'])::INT END) AS hit FROM docs GROUP BY did")
def sql_terms_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords in stored term arrays, as stored."""
    register(spark)
    load(spark, sf, "docs").createOrReplaceTempView("__docs")
    words = "'fire flood storm water'"
    return spark.sql(f"SELECT did, min(terms_overlap(terms, {words})) AS overlap, min(CAST(terms_have_keyword(terms, {words}) AS INT)) AS hit FROM __docs GROUP BY did")


# a label that the data have: whether a document says it is in English; a missing language is no label
_LABEL = "CASE WHEN lang IS NOT NULL THEN lower(lang) LIKE 'en%' END"
_MODEL = f"""WITH d AS (SELECT doc_id, list_distinct({_TERMS}) AS w, {_LABEL} AS y FROM documents),
  n AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM d),
  per AS (SELECT term, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM (SELECT y, unnest(w) AS term FROM d WHERE y IS NOT NULL) GROUP BY term),
  s AS (SELECT sum(pos) AS p, sum(neg) AS q, count(*) AS v FROM per),
  m AS (SELECT term, ln((pos + 1) / (s.p + v)) - ln((neg + 1) / (s.q + v)) AS weight FROM per, s UNION ALL SELECT '', ln(p / q) FROM n)"""


def _model(spark: SparkSession, sf: str) -> eventtype.EventTypeModel:
    return eventtype.EventTypeModel.train("english", load(spark, sf, "documents").withColumn("y", F.expr(_LABEL)), "text", "y")


@query(_MODEL + " SELECT 'english' AS event_type, term, round(weight, 8) AS weight FROM m")
def event_model(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).rows.withColumn("weight", F.round("weight", 8))


_SCORE = _MODEL + ", k AS (SELECT doc_id, sum(weight) AS s FROM (SELECT doc_id, unnest(w) AS term FROM d) JOIN m USING (term) GROUP BY doc_id), b AS (SELECT weight AS bias FROM m WHERE term = '')"


@query(_SCORE + " SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(s, 0) + bias > 0 END AS is_event FROM documents LEFT JOIN k USING (doc_id), b")
def event_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).predict(load(spark, sf, "documents"), "english", "text").select("doc_id", "is_event")


@query(_SCORE + f" SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(s, 0) + bias > 0 AND list_has_any({_TERMS}, {_KW}) END AS is_event FROM documents LEFT JOIN k USING (doc_id), b")
def event_verdicts_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).predict(load(spark, sf, "documents"), "english", "text", keywords=KEYWORDS).select("doc_id", "is_event")


@query(_SCORE + " SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(s, 0) + bias > 0 END AS is_event FROM documents LEFT JOIN k USING (doc_id), b")
def sql_event_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    register_model(spark, _model(spark, sf))
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, event_type(text_terms(text), 'english') AS is_event FROM __documents")


@query(ORACLES["sql_event_verdicts"])
def sql_text_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The classifier in SQL text, straight from texts."""
    register(spark)
    register_model(spark, _model(spark, sf))
    load(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, event_type(text, 'english') AS is_event FROM __documents")


@query(ORACLES["event_verdicts"])
def stored_model_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """As ``event_verdicts``, with a model that was saved and loaded again."""
    path = f"{runtime.work_folder(spark)}/model-{uuid.uuid4().hex}"
    _model(spark, sf).save(path)
    return eventtype.EventTypeModel.load(spark, path).predict(load(spark, sf, "documents"), "english", "text").select("doc_id", "is_event")


# --- clusters ---------------------------------------------------------------------------------------------------------


def _post_clusters(spark: SparkSession, sf: str, threshold: float = 0.3, **more) -> cluster.Clusters:
    return cluster.single_pass(posts(spark, sf), "doc_id", "txt", "ts", threshold, **more)


_WEIGHTS = f"{_POSTS}, {_weights_sql('posts', 'txt')}"
_PASS = cosine_pass(_WEIGHTS, "posts", 0.3)
_MEANS = """c AS (SELECT id, cids[o.i] AS cid FROM s JOIN o ON s.k IS NOT DISTINCT FROM o.k), z AS (SELECT cid, count(*)::INT AS size FROM c GROUP BY ALL)"""


@query(_PASS + ASSIGNED.format(columns="id AS doc_id, cids[o.i] AS cid"))
def single_pass(spark: SparkSession, sf: str) -> DataFrame:
    return _post_clusters(spark, sf).assignments


@query(_PASS + f", {_MEANS} SELECT cid, z.size AS doc_count, round(sqrt(s.size[cid]) / z.size, 8) AS norm FROM z, s")
def single_pass_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _post_clusters(spark, sf).clusters.withColumn("norm", F.round("norm", 8))


@query(_PASS + f""", {_MEANS}, m AS (SELECT cid, term, round(sum(weight) / any_value(z.size), 12) AS m FROM c JOIN z USING (cid) JOIN w ON doc_id = id WHERE weight > 0 GROUP BY cid, term),
  b AS (SELECT cid, string_agg(term, ' ' ORDER BY m DESC, term) AS top_terms FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cid ORDER BY m DESC, term) <= 5) GROUP BY cid)
  SELECT cid, size, coalesce(top_terms, '') AS top_terms FROM z LEFT JOIN b USING (cid)""")
def single_pass_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = _post_clusters(spark, sf)
    return cluster.cluster_summary(c.assignments, c.centroids).withColumn("top_terms", F.array_join("top_terms", " "))


@query(cosine_pass(_WEIGHTS, "posts", 0.3, "ts::DATE") + ASSIGNED.format(columns="o.k AS day, id AS doc_id, cids[o.i] AS cid"))
def single_pass_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A pass per day: the form that scales."""
    p = posts(spark, sf).withColumn("day", F.to_date("ts"))
    return cluster.single_pass(p, "doc_id", "txt", "ts", 0.3, partition_by=["day"]).assignments


@query(bucket_pass(_WEIGHTS, "posts", 0.3, 8) + ASSIGNED.format(columns="id AS doc_id, cids[o.i] AS cid"))
def lsh_single_pass(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.lsh_single_pass(posts(spark, sf), "doc_id", "txt", "ts", 0.3, 8).assignments


_SETS = "sets AS (SELECT did, min(rn) AS rn, max(terms) AS terms FROM docs GROUP BY did)"


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "docs").groupBy("did").agg(F.min("rn").alias("rn"), F.max("terms").alias("terms"))


@query(jaccard_pass(_SETS, "sets", 0.3) + ASSIGNED.format(columns="id AS did, cids[o.i] AS cid"))
def jaccard_single_pass(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.jaccard_single_pass(_sets(spark, sf), "rn", "did", "terms", 0.3)


@query(jaccard_pass(_SETS, "sets", 0.3, "len(terms)") + ASSIGNED.format(columns="o.k AS n, id AS did, cids[o.i] AS cid"))
def jaccard_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """A pass for each length of the stored list."""
    d = _sets(spark, sf).withColumn("n", F.when(F.col("terms").isNotNull(), F.size("terms")).cast("bigint"))
    return cluster.jaccard_single_pass(d, "rn", "did", "terms", 0.3, partition_by=["n"])


@query(distance_pass(_WEIGHTS, "posts", 0.7) + ASSIGNED.format(columns="id AS doc_id, 'cluster_' || (cids[o.i] - 1) AS cluster, round(coalesce(ds[o.i], 0), 8) AS distance, CASE WHEN ds[o.i] IS NULL THEN 'created' ELSE 'attached' END AS action"))
def incremental_cluster(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    return cluster.incremental_cluster(p, "doc_id", "ts", tfidf.tfidf(p, "doc_id", "txt")).withColumn("distance", F.round("distance", 8))


@query(f"""WITH {_POSTS}, {_weights_sql('posts', 'txt')},
  n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY ALL),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (term) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL),
  s AS (SELECT a, b, round(CASE WHEN x.n > 0 AND y.n > 0 THEN dot / (x.n * y.n) ELSE 0 END, 8) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)
  SELECT a, b, similarity FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 5""")
def most_similar(spark: SparkSession, sf: str) -> DataFrame:
    """For each post whose id is divisible by 50, the five nearest of all posts."""
    w = tfidf.tfidf(posts(spark, sf), "doc_id", "txt")
    return cluster.most_similar(w.filter("doc_id % 50 = 0"), w, "doc_id", 5, digits=8).select("a", "b", "similarity")


@query(f"""WITH {_POSTS}, {_weights_sql('posts', 'txt')}, n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY ALL),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (term) WHERE a.doc_id % 50 = 0 GROUP BY ALL)
  SELECT a, b, round(CASE WHEN x.n > 0 AND y.n > 0 THEN dot / (x.n * y.n) ELSE 0 END, 8) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b""")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each post whose id is divisible by 50 with all posts that share a term."""
    w = tfidf.tfidf(posts(spark, sf), "doc_id", "txt")
    return cluster.cosine_pairs(w.filter("doc_id % 50 = 0"), w, "doc_id", digits=8)


@query(f"""WITH {_POSTS}, {_weights_sql('posts', 'txt')}, d AS (SELECT doc_id, datediff('day', DATE '2020-01-01', ts::DATE)::INT AS cid FROM posts WHERE ts IS NOT NULL),
  z AS (SELECT cid, count(*) AS z FROM d GROUP BY cid), m AS (SELECT cid, term, avg(weight) AS having_, sum(weight) / any_value(z) AS all_ FROM d JOIN w USING (doc_id) JOIN z USING (cid) GROUP BY cid, term)
  SELECT cid, term, round(having_, 8) AS having_mean, round(all_, 8) AS all_mean FROM m""")
def member_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the posts of each day: the mean over the members with the term, and over all members."""
    p = posts(spark, sf)
    w = tfidf.tfidf(p, "doc_id", "txt")
    days = p.filter("ts IS NOT NULL").select("doc_id", F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("cid"))
    one, two = (cluster.member_centroids(days, w, "doc_id", over).withColumnRenamed("weight", name) for over, name in (("having", "having_mean"), ("all", "all_mean")))
    return one.join(two, ["cid", "term"]).select("cid", "term", F.round("having_mean", 8).alias("having_mean"), F.round("all_mean", 8).alias("all_mean"))


@query(f"""WITH {_POSTS}, {_weights_sql('posts', 'txt')}, d AS (SELECT doc_id, datediff('day', DATE '2020-01-01', ts::DATE)::INT AS cid FROM posts WHERE ts IS NOT NULL),
  c AS (SELECT cid, term, avg(weight) AS m FROM d JOIN w USING (doc_id) GROUP BY cid, term),
  nw AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY ALL), nc AS (SELECT cid, sqrt(sum(m * m)) AS n FROM c GROUP BY ALL),
  p AS (SELECT doc_id, cid, round(1 - CASE WHEN any_value(nw.n) > 0 AND any_value(nc.n) > 0 THEN sum(weight * m) / (any_value(nw.n) * any_value(nc.n)) ELSE 0 END, 8) AS distance FROM w JOIN c USING (term) JOIN nw USING (doc_id) JOIN nc USING (cid) GROUP BY doc_id, cid)
  SELECT doc_id, cid, distance FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cid) = 1""")
def nearest_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """The day whose centroid is nearest to each post."""
    p = posts(spark, sf)
    w = tfidf.tfidf(p, "doc_id", "txt")
    days = p.filter("ts IS NOT NULL").select("doc_id", F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("cid"))
    return cluster.nearest_cluster(w, cluster.member_centroids(days, w, "doc_id"), "doc_id", digits=8)


# --- candidate events -------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT *, make_timestamp((floor(epoch_us(ts)::DOUBLE / 86400000000) * 86400000000)::BIGINT) AS start_timestamp, floor(x / 10000)::INT AS cell_x, floor(y / 10000)::INT AS cell_y
    FROM documents WHERE isfinite(x) AND isfinite(y) AND ts IS NOT NULL AND list_has_any({_TERMS}, {_KW})),
  g AS (SELECT start_timestamp, cell_x, cell_y, count(*) AS docs, count(DISTINCT username) AS users FROM d GROUP BY ALL),
  n AS (SELECT start_timestamp, cell_x, cell_y, term, count(*) AS n, count(DISTINCT doc_id) AS rows_ FROM (SELECT start_timestamp, cell_x, cell_y, doc_id, unnest({_TERMS}) AS term FROM d) GROUP BY ALL),
  t AS (SELECT *, sum(n) OVER (PARTITION BY start_timestamp, cell_x, cell_y) AS t FROM n),
  h AS (SELECT start_timestamp, cell_x, cell_y, sum(n / t * log2(t / n)) AS h, count(*) FILTER (rows_ >= 2) AS shared FROM t GROUP BY ALL)
  SELECT start_timestamp, cell_x, cell_y, docs, users, shared::INT AS shared_terms, round(h, 6) AS entropy FROM g JOIN h USING (start_timestamp, cell_x, cell_y) WHERE users >= 2 AND shared >= 3""")
def candidate_events(spark: SparkSession, sf: str, users: int = 2, shared: int = 3, cell: float = 10_000.0) -> DataFrame:
    """Flagship: documents with keywords, by day and grid cell of ``cell`` metres, as candidates with users, shared terms and entropy."""
    d = load(spark, sf, "documents").filter("ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('infinity') AND abs(y) < double('infinity')")
    d = d.filter(eventtype.has_keyword(d, "text", KEYWORDS))
    p, c = grid.time_partition(F.col("ts"), timedelta(hours=24)), grid.spatial_partition(F.col("x"), F.col("y"), cell)
    d = d.select(p.alias("p"), c.alias("c"), "username", "text").select("p.start_timestamp", F.col("c.x").alias("cell_x"), F.col("c.y").alias("cell_y"), "username", "text")
    m = aggregates.group_metrics(d, ["start_timestamp", "cell_x", "cell_y"], "text", 2, "username")
    return m.filter((F.col("users") >= users) & (F.col("shared_terms") >= shared)).withColumn("entropy", F.round("entropy", 6))


@query(f"""WITH d AS (SELECT *, make_timestamp((floor(epoch_us(ts)::DOUBLE / 86400000000) * 86400000000)::BIGINT) AS start_timestamp, floor(x / 10000)::INT AS cell_x, floor(y / 10000)::INT AS cell_y
    FROM documents WHERE isfinite(x) AND isfinite(y) AND ts IS NOT NULL AND list_has_any({_TERMS}, {_KW}))
  SELECT start_timestamp, cell_x, cell_y, count(*) AS docs, count(DISTINCT username) AS users FROM d GROUP BY ALL""")
def candidate_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The groups that ``candidate_events`` chooses from, before its conditions."""
    return candidate_events(spark, sf, users=0, shared=0).select("start_timestamp", "cell_x", "cell_y", "docs", "users")
