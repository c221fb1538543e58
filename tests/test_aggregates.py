import pytest
from pyspark.sql import functions as F

from eventide.operators import aggregates as A
from eventide.operators.tokenize import strip, term_vector, simple_terms

ENTROPY = [
    (["cat hat cat bat"], "english", 1.5),
    (["cat hat", "cat bat"], "english", 1.5),
    (["red blue", "green yellow"], "english", 2),
    (["fire fire", "fire"], "english", 0),
    (["Fire fire fires"], "english", 0),
    (["the cat and a dog"], "english", 1),
    (["cat", None, "", "dog"], "english", 1),
    ([None, ""], "english", 0),
    (["cat cat dog", "cat"], "english", 0.8112781244591328),
    (["The the cat"], "simple", 0.9182958340544896),
    (["cat " * 300 + "dog " * 100], "simple", 0.8112781244591328),
    (["Fire fire fires and the cat"], "english", 0.8112781244591328),
]
SHARED = [
    (["apple banana cherry"] * 3, 3, 3),
    (["apple banana cherry"] * 2, 3, 0),
    (["apple banana cherry"] * 2 + ["dog elephant"], 2, 3),
    (["apple apple apple", "apple apple"], 2, 1),
    (["apple apple apple", "banana"], 2, 0),
    (["apple apple apple", "apple banana", "apple cherry"], 2, 1),
    (["The Fire", "the fires", "fire the"], 3, 1),
    (["apple banana", "apple cherry"], 1, 3),
    (["apple", None, "", "apple"], 2, 1),
    ([None, ""], 1, 0),
    (["apple"], None, 0),
]


def grouped(spark, cases):
    return spark.createDataFrame([(k, t) for k, c in enumerate(cases) for t in c[0]], "g int, t string")


@pytest.mark.parametrize("config", ["english", "simple"])
def test_entropy(spark, config):
    cases = [c for c in ENTROPY if c[1] == config]
    got = {r[0]: r[1] for r in A.entropy(grouped(spark, cases), ["g"], "t", config).collect()}
    assert got == pytest.approx({k: c[2] for k, c in enumerate(cases)}, abs=1e-9)
    assert all(str(v) != "-0.0" for v in got.values())


def test_entropy_of_nothing_and_of_vectors(spark):
    empty = spark.createDataFrame([], "g int, t string")
    assert A.entropy(empty, [], "t").collect()[0][0] == 0 and A.entropy(empty, ["g"], "t").count() == 0
    v = spark.createDataFrame([("cat hat cat bat",)], "t string").select(term_vector(simple_terms(F.col("t"))).alias("v"))
    assert A.entropy(v, [], "v").first()[0] == pytest.approx(1.5)
    assert A.entropy(v.select(strip("v").alias("v")), [], "v").first()[0] == pytest.approx(1.584962500721156)
    capped = spark.createDataFrame([("cat " * 300 + "dog " * 100,)], "t string")
    assert A.entropy(capped, [], "t", max_occurrences=100).first()[0] == pytest.approx(1)


def test_shared_terms(spark):
    for minimum in (1, 2, 3, None):
        cases = [c for c in SHARED if c[1] == minimum]
        got = {r[0]: r[1] for r in A.shared_terms(grouped(spark, cases), ["g"], "t", minimum, "english").collect()}
        assert got == {k: c[2] for k, c in enumerate(cases)}
    assert A.shared_terms(spark.createDataFrame([], "g int, t string"), [], "t", 3).first()[0] == 0
    assert A.shared_terms(grouped(spark, [(["the cat", "the dog"],)]), ["g"], "t", 2).first()[1] == 1


def test_group_metrics_with_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1, "a b", "u"), (None, 1, "a c", "v"), ("x", 1, None, None)], "n string, lexeme int, t string, docs string")
    got = {r["n"]: tuple(r)[1:] for r in A.group_metrics(df, ["n"], "t", 2, "docs").collect()}
    assert got == {None: (2, 2, 1, pytest.approx(1.5)), "x": (1, 0, 0, 0.0)}


def test_sql_aggregates_agree(spark):
    from eventide.functions import register

    register(spark)
    data = [(k % 20, f"w{k % 7} w{k % 11} fire") for k in range(2000)]
    df = spark.createDataFrame(data, "g int, t string")
    df.createOrReplaceTempView("grouped")
    a = {r[0]: r[1] for r in A.entropy(df, ["g"], "t").collect()}
    b = {r[0]: r[1] for r in spark.sql("SELECT g, term_entropy(text_terms(t)) FROM grouped GROUP BY g").collect()}
    assert a == pytest.approx(b, abs=1e-9)
    c = {r[0]: r[1] for r in spark.sql("SELECT g, shared_terms(text_terms(t), 5) AS s FROM grouped GROUP BY g HAVING s > 0").collect()}
    assert c == {r[0]: r[1] for r in A.shared_terms(df, ["g"], "t", 5).collect()}


def test_counts_are_partial(spark):
    df = spark.createDataFrame([(1, "a b")], "g int, t string")
    plan = A.entropy(df, ["g"], "t")._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "Python" not in plan


def test_candidates_of_local_cells(spark, tmp_path):
    from datetime import datetime

    from eventide.plans.events import candidate_events

    day, next_day = datetime(2024, 5, 1, 9), datetime(2024, 5, 2, 9)
    data = [
        (day, 100.0, 100.0, "a", "fire at mill"), (day, 900.0, 900.0, "b", "fire at mill"),  # a candidate
        (day, 5100.0, 100.0, "a", "flood near river"), (day, 5900.0, 1.0, "c", "flood near river"),  # another, 5 km away
        (day, 9100.0, 100.0, "d", "water over road"), (day, 9200.0, 100.0, "d", "water over road"),  # one user
        (day, -100.0, 100.0, "a", "police here now"), (day, -200.0, 100.0, "b", "police here later"),  # two shared terms
        (day, 3100.0, 100.0, "a", "nice calm sea"), (day, 3200.0, 100.0, "b", "nice calm sea"),  # no keyword
        (next_day, 100.0, 100.0, "e", "fire at mill"),  # alone on its day
        (day, None, 100.0, "e", "fire at mill"), (day, float("nan"), 100.0, "f", "fire at mill"),
    ]
    rows_ = [(k, *d) for k, d in enumerate(data)]
    spark.createDataFrame(rows_, "doc_id long, ts timestamp_ntz, x double, y double, username string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def found(**more):
        return sorted((r["start_timestamp"], r["cell_x"], r["cell_y"], r["docs"], r["users"], r["shared_terms"]) for r in candidate_events(spark, str(tmp_path), **more).collect())

    midnight = datetime(2024, 5, 1)
    assert found(cell=1000.0) == [(midnight, 0, 0, 2, 2, 3), (midnight, 5, 0, 2, 2, 3)]
    # wide cells take both, and the documents of one user, for one event
    assert found(cell=20_000_000.0) == [(midnight, 0, 0, 6, 4, 9)]
