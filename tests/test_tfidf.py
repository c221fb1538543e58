import math

import pytest
from pyspark.sql import functions as F

from eventide.operators.tfidf import TfIdfModel, tfidf

DOCS = [(1, "cat kitten pet a b"), (2, "pet c d e f"), (3, "cat kitten pet sofa sleep"), (4, "query index g h i j"), (5, "query index k l m")]


def brute(docs):
    bags = {i: (t or "").lower().split() for i, t in docs}
    n = len(docs)
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    return {(i, w): b.count(w) / len(b) * math.log10(n / df[w]) for i, b in bags.items() for w in set(b)}


def test_weights(spark):
    got = {(r[0], r[1]): r[2] for r in tfidf(spark.createDataFrame(DOCS, "doc_id int, txt string"), "doc_id", "txt").collect()}
    want = brute(DOCS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert got[1, "cat"] == pytest.approx(0.079588002, abs=1e-9) and got[4, "query"] == pytest.approx(0.066323335, abs=1e-9)


def test_empty_rows_count(spark):
    rows = [(1, "fire fire"), (2, None), (3, ""), (4, "fire x")]
    got = {(r[0], r[1]): r[2] for r in tfidf(spark.createDataFrame(rows, "weight int, t string"), "weight", "t").collect()}
    assert got == pytest.approx({(1, "fire"): math.log10(2), (4, "fire"): 0.5 * math.log10(2), (4, "x"): 0.5 * math.log10(4)})
    assert tfidf(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0
    assert tfidf(spark.createDataFrame([(1, ["a", None, "a"])], "id int, t array<string>"), "id", "t").first()["weight"] == 0


def test_model(spark):
    df = spark.createDataFrame(DOCS, "doc_id int, txt string")
    half = TfIdfModel.fit(df.filter("doc_id < 3"), "txt").insert(df.filter("doc_id >= 3"), "txt")
    whole = {(r[0], r[1]): r[2] for r in tfidf(df, "doc_id", "txt").collect()}
    assert {(r[0], r[1]): r[2] for r in half.weights(df, "doc_id", "txt").collect()} == pytest.approx(whole)
    assert half.stats() == {"total_documents": 5, "distinct_terms": len({k[1] for k in whole})}
    v = {r[0]: r[1] for r in half.vectorize(spark.createDataFrame([(9, "cat zebra cat"), (10, None)], "doc_id int, txt string"), "doc_id", "txt").collect()}
    assert [(t, w) for t, w in v[9]] == [("cat", pytest.approx(math.log(5 / 2))), ("zebra", 0.0)] and v[10] == []
    more = spark.createDataFrame([(1, "a"), (2, "")], "doc_id int, txt string")
    assert TfIdfModel.fit(more, "txt").total == 2 and TfIdfModel.fit(more, "txt", count_empty=False).total == 1


def test_saved_table_is_guarded(spark):
    df = spark.createDataFrame(DOCS, "doc_id int, txt string")
    spark.sql("DROP TABLE IF EXISTS tfidf_saved")
    tfidf(df, "doc_id", "txt", save_as="tfidf_saved")
    with pytest.raises(ValueError):
        tfidf(df, "doc_id", "txt", save_as="tfidf_saved")
    tfidf(df.filter("doc_id = 1"), "doc_id", "txt", save_as="tfidf_saved", overwrite=True)
    assert spark.table("tfidf_saved").count() == 5
    spark.sql("DROP TABLE tfidf_saved")


def test_english(spark):
    df = spark.createDataFrame([(1, "Fires and a fire downtown"), (2, "x")], "id int, t string")
    assert {r["term"] for r in tfidf(df, "id", "t", "english").filter(F.col("id") == 1).collect()} == {"fire", "downtown"}


def test_model_look_ups(spark):
    model = TfIdfModel.fit(spark.createDataFrame(DOCS, "doc_id int, txt string"), "txt")
    assert model.df_of("cat") == 2 and model.df_of("zebra") == 0
    assert model.idf_of("cat") == pytest.approx(math.log10(2.5)) and model.idf_of("cat", None) == pytest.approx(math.log(2.5)) and model.idf_of("zebra") == 0
    assert model.tf_of("cat cat x", "cat") == pytest.approx(2 / 3) and model.tf_of(None, "cat") == 0
    assert model.tfidf_of("cat x", "cat") == pytest.approx(0.5 * math.log10(2.5))
    assert model.vector_of("cat zebra") == pytest.approx({"cat": 0.5 * math.log10(2.5), "zebra": 0}) and model.vector_of("") == {}
    assert model.vector_of({"cat": 3, "zebra": 1})["cat"] == pytest.approx(0.75 * math.log10(2.5))
    more = model.insert_counts(spark.createDataFrame([(6, "cat", 4), (6, "dog", 1), (7, None, 1), (8, "x", 0)], "id int, term string, count int"), "id")
    assert more.total == 8 and more.df_of("cat") == 3 and more.df_of("dog") == 1 and more.df_of("x") == 0
    assert TfIdfModel(model.frequencies, 0).idf().first()["idf"] == 0
