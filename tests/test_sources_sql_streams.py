import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from eventide.functions import register
from eventide.operators.tfidf import TfIdfModel
from eventide.sources import lines, load, save_table, table_exists
from eventide.streaming import live_counts, live_document_frequencies, live_single_pass

T0 = datetime(2025, 1, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n\nthird\n")
    got = lines(spark, str(tmp_path / "a.txt")).collect()
    assert sorted(r["txt"] for r in got) == ["", "first", "third"] and len({r["doc_id"] for r in got}) == 3
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert load(spark, str(tmp_path), "t").count() == 3


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS some_table")
    assert not table_exists(spark, "some_table")
    save_table({"Some_Table ": spark.range(2)})
    assert table_exists(spark, " SOME_table ") and table_exists(spark, "default.some_table")
    with pytest.raises(ValueError):
        save_table({"some_table": spark.range(1)})
    save_table({"some_table": spark.range(1)}, overwrite=True)
    save_table({})
    assert spark.table("some_table").count() == 1
    spark.sql("DROP TABLE some_table")


def test_sql_text(spark, rows):
    register(spark)
    spark.createDataFrame([(1, "Fire fire in town"), (2, None), (3, "")], "id int, txt string").createOrReplaceTempView("posts")
    assert rows(spark.sql("SELECT id, t.term, t.count FROM posts, LATERAL process_text(txt) AS t")) == [(1, "fire", 2), (1, "in", 1), (1, "town", 1)]
    assert rows(spark.sql("SELECT id, keyword_overlap(txt, 'fire, town'), has_keyword(txt, 'fire'), has_keyword(txt, NULL) FROM posts")) == [(1, 2, True, False), (2, None, None, False), (3, 0, False, False)]
    plan = spark.sql("SELECT spatial_partition(double(id), 1D, 10D) AS c, count(*) FROM posts GROUP BY 1")._jdf.queryExecution().toString()
    assert "Python" not in plan
    with pytest.raises(PySparkException, match="cell length"):
        spark.sql("SELECT spatial_partition(1D, 1D, double('NaN'))").collect()


def fed(spark, tmp_path, batches, schema):
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_live_counts(spark, tmp_path, rows):
    schema = "doc_id int, ts timestamp_ntz, kind string"
    stream = fed(spark, tmp_path, [[(1, T0, "a"), (2, T0 + timedelta(minutes=1), "a"), (3, None, "a")], [(4, T0 + timedelta(hours=5), "b")]], schema)
    q = live_counts(stream, "ts", timedelta(minutes=15), timedelta(minutes=10), ["kind"]).writeStream.format("memory").queryName("periods").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("periods")) == sorted([(T0 - timedelta(minutes=5), T0 + timedelta(minutes=10), "a", 2), (T0 + timedelta(hours=4, minutes=55), T0 + timedelta(hours=5, minutes=10), "b", 1)], key=repr)
    with pytest.raises(ValueError):
        live_counts(stream, "ts", timedelta(minutes=7))


def test_live_frequencies_and_clusters(spark, tmp_path, rows):
    schema = "doc_id int, ts timestamp_ntz, txt string, town string"
    data = [(1, T0, "fire north", "x"), (2, T0, "fire south", "x"), (3, T0, "river high", "x"), (4, T0, None, "y")]
    stream = fed(spark, tmp_path, [data[:2], data[2:]], schema)
    q = live_document_frequencies(stream, "txt").writeStream.format("memory").queryName("dfs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("dfs")) == [("fire", 2), ("high", 1), ("north", 1), ("river", 1), ("south", 1)]
    idf = TfIdfModel.fit(spark.createDataFrame(data, schema), "txt").idf()
    q = live_single_pass(stream, "doc_id", "ts", "txt", idf, 0.1, "town").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("live")) == [("x", 1, 1), ("x", 2, 1), ("x", 3, 2), ("y", 4, 1)]


def test_entry_has_every_name():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len([q for q in e.queries() if not q.startswith("p")]) > 40


def test_generators(spark):
    from eventide.sources import synthetic_labels, synthetic_points, synthetic_posts, synthetic_times

    a = synthetic_posts(spark, 50, topics=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, synthetic_posts(spark, 50, topics=3).repartition(7).collect()))
    assert all(len(r["txt"].split()) == 12 for r in a.collect()) and len({r["ts"] for r in a.collect()}) == 50
    assert synthetic_posts(spark, 50, seed=2).exceptAll(synthetic_posts(spark, 50)).count() > 0
    labels = synthetic_labels(spark, 2000, 0.2)
    assert 250 < labels.filter("txt LIKE '%earthquake%'").count() < 550 and 0 < labels.filter("is_earthquake").count() < 300
    assert synthetic_points(spark, 100).filter("abs(x) > 500000 OR abs(y) > 500000").count() == 0
    assert synthetic_points(spark, 100, towns=2).selectExpr("floor(x / 40000) c").distinct().count() <= 4
    assert synthetic_times(spark, 100, 2).filter("ts >= TIMESTAMP_NTZ '2025-01-03 00:00:00'").count() == 0


def test_file_sinks(spark, tmp_path):
    from eventide.sources import save_files

    save_files(spark.range(3), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3
    with pytest.raises(PySparkException):
        save_files(spark.range(3), f"{tmp_path}/c")
    save_files(spark.range(2), f"{tmp_path}/c", "json", overwrite=True)
    assert spark.read.json(f"{tmp_path}/c").count() == 2
    with pytest.raises(ValueError):
        save_files(spark.range(3), f"{tmp_path}/x", "orc")


def test_sql_configs_and_term_arrays(spark, rows):
    register(spark)
    spark.createDataFrame([(1, "The runners were running", ["run", None]), (2, None, None), (3, "", [])], "id int, t string, w array<string>").createOrReplaceTempView("words")
    got = rows(spark.sql("SELECT id, text_terms(t) AS a, text_terms(t, 'english') AS b, keyword_overlap(t, 'running', 'english') AS c, has_keyword(t, 'runs', 'english') AS d FROM words"))
    assert got == [(1, ["the", "runners", "were", "running"], ["runner", "run"], 1, True), (2, None, None, None, None), (3, [], [], 0, False)]
    got = rows(spark.sql("SELECT id, terms_overlap(w, 'run walk') AS a, terms_have_keyword(w, 'run') AS b, terms_have_keyword(w, ' ') AS c FROM words"))
    assert got == [(1, 1, True, False), (2, None, None, False), (3, 0, False, False)]
    assert rows(spark.sql("SELECT term_entropy(t) AS a, term_entropy(w) AS b, shared_terms(t, 1) AS c, shared_terms(w, 2) AS d FROM words")) == [(2.0, 0.0, 4, 0)]
    assert "Python" not in spark.sql("SELECT has_keyword(t, 'run') FROM words")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(PySparkException, match="config is"):
        spark.sql("SELECT text_terms(t, 'german') FROM words").collect()


@pytest.mark.parametrize("config", ["simple", "english"])
def test_process_text_is_a_generator_of_its_row(spark, rows, config):
    register(spark)
    texts = [(1, "fires Fire! fire in town"), (2, "fires Fire! fire in town"), (3, None), (4, ""), (5, "... the"), (6, "b a b a b")]
    spark.createDataFrame(texts, "id int, txt string").createOrReplaceTempView("posts")
    df = spark.sql(f"SELECT id, t.term, t.count FROM posts, LATERAL process_text(txt, '{config}') AS t")
    assert "Join" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    simple = [("fire", 2), ("fires", 1), ("in", 1), ("town", 1)]
    want = [(i, *t) for i in (1, 2) for t in (simple if config == "simple" else [("fire", 3), ("town", 1)])]
    want += [(5, "the", 1), (6, "a", 2), (6, "b", 3)] if config == "simple" else [(6, "b", 3)]
    assert rows(df) == sorted(want, key=repr) and dict(df.dtypes)["count"] == "bigint"


def test_workers_of_the_sql_functions_find_the_package(tmp_path):
    """In a session whose workers don't have the package's folder in their path."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from eventide.functions import register
register(spark)
print(spark.sql("SELECT term FROM process_text('two fires', 'english')").collect())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "Row(term='fire')" in run.stdout, run.stderr[-2000:]


def test_jdbc_writer_asks_spark(spark):
    from eventide.sources import save_jdbc

    with pytest.raises(Exception, match="(?i)driver"):
        save_jdbc(spark.range(1), "jdbc:none://nowhere", "t")
