import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventide.functions import register, register_model
from eventide.operators import eventtype as E

TRAIN = [("earthquake shaking felt strong", True), ("strong earthquake damage", True), ("the ground shakes earthquake now", True), ("earthquake felt in town", True), ("football match tonight", False), ("great football game won", False), ("new phone released today", False), ("weather is nice today", False), ("ignored text earthquake", None), (None, False)]
SCORED = [(1, "felt an earthquake here"), (2, "strong shaking"), (3, "football today"), (4, "phone game"), (5, "nothing known"), (6, None)]


@pytest.fixture
def model(spark):
    return E.EventTypeModel.train("quake", spark.createDataFrame(TRAIN, "txt string, y boolean"), "txt", "y", "english")


def test_overlap_and_keyword(spark):
    cases = [("earthquake and fire", 2), ("earthquake", 1), ("calm", 0), ("fire fire", 1), (None, None), ("", 0)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id int, t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", E.overlap(df, "t", ["earthquake", "fire"]), E.has_keyword(df, "t", "earthquake fire")).collect()}
    assert got == {k: (n, None if n is None else n > 0) for k, (_, n) in enumerate(cases)}
    one = spark.createDataFrame([("The ground shakes", "see a/b and o'brien")], "t string, u string")
    assert one.select(E.overlap(one, "t", "shaking", "english")).first()[0] == 1
    assert one.select(E.has_keyword(one, "u", "a/b")).first()[0]
    nulls = spark.createDataFrame([(None,), ("x",)], "t string")
    assert [tuple(r) for r in nulls.select(E.overlap(nulls, "t", None), E.has_keyword(nulls, "t", None), E.overlap(nulls, "t", []), E.has_keyword(nulls, "t", [])).collect()] == [(None, False, None, False), (None, False, 0, False)]


def test_training_and_verdicts(spark, model):
    df = spark.createDataFrame(SCORED, "id int, is_event string")
    got = {r["id"]: r["is_event"] for r in model.predict(df, "quake", "is_event", "english").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: None}
    # the same by a join, as for large models
    E.LITERAL_TERMS, kept = 1, E.LITERAL_TERMS
    try:
        joined = {r["id"]: (r["ok"], r["s"]) for r in model.predict(df, "quake", "is_event", "english", out="ok", score="s").collect()}
    finally:
        E.LITERAL_TERMS = kept
    mapped = {r["id"]: (r["ok"], r["s"]) for r in model.predict(df, "quake", "is_event", "english", out="ok", score="s").collect()}
    assert {k: v[0] for k, v in joined.items()} == {k: v[0] for k, v in mapped.items()}
    assert all(a[1] == pytest.approx(b[1]) for a, b in zip(joined.values(), (mapped[k] for k in joined)) if b[1] is not None)
    register_model(spark, model)
    register(spark)
    df.createOrReplaceTempView("scored")
    sql = spark.createDataFrame([(["felt", "earthquak"],), (None,)], "w array<string>")
    sql.createOrReplaceTempView("words")
    assert [r[0] for r in spark.sql("SELECT event_type(w, 'quake') FROM words").collect()] == [True, None]


def test_keywords_go_first(spark, model):
    df = spark.createDataFrame([(1, "felt it strong now"), (2, "earthquake felt")], "id int, t string")
    assert [r["is_event"] for r in model.predict(df, "quake", "t", "english").orderBy("id").collect()] == [True, True]
    assert [r["is_event"] for r in model.predict(df, "quake", "t", "english", keywords="earthquake").orderBy("id").collect()] == [False, True]


def test_model_store(spark, model, tmp_path):
    again = E.EventTypeModel.train("quake", spark.createDataFrame(TRAIN[:6], "txt string, y boolean"), "txt", "y", "english")
    both = model.replaced(again)
    assert both.rows.count() == again.rows.count()
    both.save(f"{tmp_path}/m")
    assert E.EventTypeModel.load(spark, f"{tmp_path}/m").rows.count() == again.rows.count()
    bias = again.rows.filter("term = ''").first()["weight"]
    assert bias == pytest.approx(0.6931471805599453)


def test_errors(spark, model):
    df = spark.createDataFrame(TRAIN, "txt string, y boolean")
    with pytest.raises(ValueError):
        E.EventTypeModel.train("", df, "txt", "y")
    with pytest.raises(ValueError):
        E.EventTypeModel.train("x", df.filter("y"), "txt", "y")
    with pytest.raises(ValueError):
        model.predict(df, "unknown", "txt")
    register_model(spark, model)
    with pytest.raises(PySparkException):
        spark.sql("SELECT event_type(array('a'), 'unknown')").collect()


def test_keyword_filter_needs_no_python(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert "Python" not in df.filter(E.has_keyword(df, "t", "fire"))._jdf.queryExecution().toString()
    assert isinstance(F.lit(1), type(E.overlap(df, "t", "x")))
