import pytest
from pyspark.sql import functions as F

from eventide.operators import tokenize as T
from eventide.operators.stemmer import stem


@pytest.mark.parametrize("word, want", [("earthquake", "earthquak"), ("shaking", "shake"), ("shakes", "shake"), ("fires", "fire"), ("consistency", "consist"), ("knightly", "knight"), ("generate", "generat"), ("communities", "communiti"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("national", "nation"), ("happily", "happili"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("cries", "cri"), ("ties", "tie"), ("relational", "relat"), ("sensational", "sensat"), ("electrical", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controlling", "control"), ("yes", "yes"), ("a", "a"), ("by", "by"), ("gas", "gas"), ("kiwis", "kiwi"), ("proceed", "proceed"), ("outing", "outing"), ("fluently", "fluentli"), ("geology", "geolog")])
def test_stems(word, want):
    assert stem(word) == want


def test_terms_by_config(spark):
    df = spark.createDataFrame([(1, "Fires and a fire downtown"), (2, "The the cat"), (3, None), (4, ""), (5, "été-3.5 a/b")], "id int, t string")
    got = {r["id"]: (r["s"], r["e"]) for r in df.select("id", T.terms(F.col("t")).alias("s"), T.terms(F.col("t"), "english").alias("e")).collect()}
    assert got[1] == (["fires", "and", "a", "fire", "downtown"], ["fire", "fire", "downtown"])
    assert got[2] == (["the", "the", "cat"], ["cat"])
    assert got[3] == (None, None) and got[4] == ([], [])
    assert got[5][0] == ["t", "3", "5", "a", "b"]
    with pytest.raises(ValueError):
        T.terms(F.col("t"), "french")


def test_vectors(spark):
    df = spark.createDataFrame([(["b", "a", "b", None],), ([],), (None,)], "w array<string>")
    v = T.term_vector(F.col("w"))
    got = [r[0] for r in df.select(v).collect()]
    assert [tuple(x) for x in got[0]] == [("a", 1), ("b", 2)] and got[1] == [] and got[2] is None
    one = df.limit(1)
    r = one.select(T.lexemes(v).alias("l"), T.strip(v).alias("s"), T.length(v).alias("n"), T.delete(v, ["a"]).alias("d"), T.matches(v, ["x", "b"]).alias("m"), T.matches(v, []).alias("z")).first()
    assert r["l"] == ["a", "b"] and [tuple(x) for x in r["s"]] == [("a", 0), ("b", 0)] and r["n"] == 2 and [tuple(x) for x in r["d"]] == [("b", 2)] and r["m"] and not r["z"]


def test_process_text_keeps_clashing_keys(spark, rows):
    df = spark.createDataFrame([(1, 5, "fire fire a"), (2, 5, None), (3, 5, "x")], "term int, count int, txt string")
    assert rows(T.process_text(df, "txt", ["term"])) == [(1, "a", 1), (1, "fire", 2), (3, "x", 1)]


def test_driver_tokenizer():
    assert T.tokenize("Fires and a fire downtown") == {"fire": 2, "downtown": 1}
    assert T.tokenize(["a", ("b", 2), "a"], "list") == [("a", 2), ("b", 2)]
    assert T.tokenize({"x": 3}) == {"x": 3} and T.tokenize(None) == {}
    with pytest.raises(ValueError):
        T.tokenize("x", "set")


def test_keywords():
    assert T.keyword_terms("earthquake, shaking", "english") == ["earthquak", "shake"]
    assert T.keyword_terms(None) is None and T.keyword_terms(" ") == []


def test_distinct_terms_and_frequency(spark, rows):
    df = spark.createDataFrame([(1, "fire fire a"), (2, None)], "term int, txt string")
    assert rows(T.distinct_terms(df, "txt", ["term"])) == [(1, "a", 1), (1, "fire", 1)]
    assert [r[0] for r in df.select(T.term_frequency(T.simple_terms(F.col("txt")), "fire")).collect()] == [2, None]
    assert len(T.stop_words()) == 127


def test_tokenizers_agree(spark):
    from eventide.operators import tokenize as T

    texts = [(1, "Running runners ran, the DAYS!"), (2, None), (3, ""), (4, "naïve naïve 3ds"), (4, "skies skies")]
    df = spark.createDataFrame(texts, "id int, text string")
    for config in T.CONFIGS:
        assert T.tokenizer_differences(df, "id", "text", config).count() == 0


def test_stems_of_batches(spark):
    from eventide.operators import tokenize as T

    df = spark.createDataFrame([(["running", None, "ran"],), (None,), ([],), (["running"],)], "w array<string>")
    assert [r[0] for r in df.select(T.stemmed("w")).collect()] == [["run", None, "ran"], None, [], ["run"]]
