import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm.bitmaps import BITS, _union, bitmaps, encode, frequencies, marked
from eventide.llm.relevance import relevance
from eventide.llm.topn import LoserTree, merge_runs, top_n


def test_loser_tree_sorts():
    r = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(6))) + [None] for _ in range(k)]
        at, tree, out = [0] * k, LoserTree([x[0] for x in runs]), []
        run = tree.winner
        while tree.heads[run] is not None:
            out.append(tree.heads[run])
            at[run] += 1
            tree.heads[run] = runs[run][at[run]]
            run = tree.replay(run)
        assert out == sorted(x for x_ in runs for x in x_ if x is not None)


def test_merge_seeks_the_next_group():
    a = ([1, 1, 1, 2], [-9.0, -8.0, -1.0, -5.0], [b"a", b"b", b"c", b"z"], [3, 3, 3, 4])
    b = ([1, 2, 2], [-8.5, -5.0, -4.0], [b"a", b"a", b"b"], [1, 3, 3])
    assert [(k[0], k[2]) for k in merge_runs([a, b, ([], [], [], [])], 2)] == [(1, b"a"), (1, b"b"), (2, b"a"), (2, b"z")]


def best(rows, n):
    w = {}
    for g, t, s in rows:
        if g is not None and t is not None and t.strip(" \t\r\n") and s is not None and math.isfinite(s):
            w[g, t] = max(w.get((g, t), -math.inf), s)
    out = []
    for g in {k[0] for k in w}:
        own = sorted(((-s, t.encode()), t) for (q, t), s in w.items() if q == g)[:n]
        out += [(g, t, -k[0], i + 1) for i, (k, t) in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_top_n(spark, rows, n):
    r = random.Random(2)
    words = ["alpha", "Beta", "éa", "zz", "a", "", " ", "\t", "ab", "😀", "￿", None]
    data = [(r.choice([7, 7, 7, 1, 2, 3, -5, None]), r.choice(words), r.choice([0.5, 0.5, 1.5, -2.0, 0.0, -0.0, math.nan, math.inf, None, 3.25])) for _ in range(3000)]
    df = spark.createDataFrame(data, "rank int, term string, weight double").repartition(7).selectExpr("*", "'x' AS g", "1 AS b")
    assert rows(top_n(df, "rank", "term", "weight", n).toDF("a", "b", "c", "d")) == best(data, n)


def test_top_n_edges(spark):
    none = spark.createDataFrame([], "g bigint, t string, w double")
    assert top_n(none, "g", "t", "w", 3).count() == 0
    one = spark.createDataFrame([(1, None, 1.0), (2, " ", 2.0)], "g bigint, t string, w double")
    assert top_n(one, "g", "t", "w", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(none, "g", "t", "w", 0)
    long = spark.createDataFrame([(1, "x" * 2_000_000, 1.0), (1, "y", 1.0)], "g bigint, t string, w double")
    assert [len(r["t"]) for r in top_n(long, "g", "t", "w", 1).collect()] == [2_000_000]


def unions(pieces):
    """Runs the merge over (value, high, entries) pieces, some of them in each batch."""
    out = {}
    batches = []
    for k in range(0, len(pieces), 3):
        part = pieces[k : k + 3]
        group = np.repeat(np.arange(len(part)), [len(p[2]) for p in part])
        low, n, spelling = np.array([e for p in part for e in sorted(p[2])], np.int64).reshape(-1, 3).T
        form, data = encode(group, low, n, spelling, len(part))
        batches.append(pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part]), pa.array(form), data], names=["value", "high", "form", "data"]))
    for b in _union(iter(batches)):
        for r in b.to_pylist():
            assert (r["value"], r["high"]) not in out
            ids = np.flatnonzero(np.unpackbits(np.frombuffer(r["ids"], np.uint8))) if r["card"] > 4096 else np.frombuffer(r["ids"], "<u2")
            out[r["value"], r["high"]] = dict(zip(ids.tolist(), np.frombuffer(r["counters"], "<i8").tolist()))
            assert r["card"] == len(ids) and r["occurrences"] == sum(out[r["value"], r["high"]].values())
    return out, [f for b in batches for f in b.column("form").to_pylist()]


def test_unions_of_all_forms():
    r = np.random.default_rng(3)
    pieces, want, forms = [], {}, set()
    for value, high, count in [("a", 0, 3), ("a", 1, 40), ("b", 0, 9000), ("c", 0, 30_000), ("d", 5, 6000), ("e", 0, 1)]:
        for k in range(7):
            low = np.unique(r.integers(0, 65536, count))
            n = np.ones(len(low), int) if value == "b" or k == 2 else r.integers(1, 3, len(low)) if value != "d" else r.integers(1, 1 << 40, len(low))
            spelling = np.zeros(len(low), int) if k % 2 or value != "a" else r.integers(0, 2, len(low))
            pieces.append((value, high, set(zip(low.tolist(), n.tolist(), spelling.tolist()))))
            want.setdefault((value, high), set()).update(pieces[-1][2])
    got, forms = unions(pieces)
    assert set(forms) == {0, 1, 2, 3}
    for key, entries in want.items():
        sums = {}
        for low, n, _ in entries:
            sums[low] = sums.get(low, 0) + n
        assert got[key] == dict(sorted(sums.items())), key


def test_many_dense_containers_are_merged_one_by_one():
    import time
    import tracemalloc

    r = np.random.default_rng(1)
    data = [np.packbits(r.random(65536) < 0.125).tobytes() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["hot"] * 400), pa.array(np.zeros(400, np.int64)), pa.array(np.full(400, BITS, np.int8)), pa.array(data)], names=["value", "high", "form", "data"])
    tracemalloc.start()
    began = time.time()
    (got,) = list(_union(iter([batch])))
    assert time.time() - began < 2 and tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    assert got.column("card")[0].as_py() == 65536


def test_frequencies(spark, rows):
    r = random.Random(4)
    data = [(r.choice([0, 1, 5, 70_000, -3, 1 << 40, None]), r.choice(["fire", "Fire", " fire ", "x", None]), r.choice([1, 2, None])) for _ in range(2000)]
    df = spark.createDataFrame(data, "record bigint, value string, n int").repartition(5)
    want = {}
    for i, v, n in {d for d in data if d[1] is not None and d[2] is not None}:
        a, b = want.get(k := v.strip().lower(), (0, set()))
        want[k] = a + n, b | {i}
    want = {k: (a, len(b)) for k, (a, b) in want.items()}
    from pyspark.sql import functions as F

    got = frequencies(df, "record", "value", "n", lambda c: F.lower(F.trim(c)))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert bitmaps(df.limit(0), "record", "value").count() == 0


def test_hot_value_is_dense_and_spread(spark):
    df = spark.range(150_000).selectExpr("id AS record", "'hot' AS value").union(spark.range(2).selectExpr("id", "'cold'"))
    got = bitmaps(df.union(df), "record", "value").collect()
    assert sum(r["card"] for r in got if r["value"] == "hot") == 150_000 and len([r for r in got if r["value"] == "hot"]) == 3
    assert sum(r["card"] for r in got if r["value"] == "cold") == 2


def test_marks(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 1000)], "value string, occurrences bigint")
    assert rows(marked(df, 2, 1 / 4)) == [("a", "rare"), ("b", "rare"), ("d", "common")]
    assert rows(marked(df.filter("value = 'a'"), 2, 1 / 4)) == [("a", "common"), ("a", "rare")]
    assert rows(marked(df.limit(0), 2, 1 / 4)) == []


def weigh(docs, k1, b, idf, average=None):
    bags = {}
    for i, t in docs:
        if i is not None:
            bags[i] = max(bags.get(i, ""), t or "")
    bags = {i: re.findall("[0-9a-z]+", t.lower()) for i, t in bags.items()}
    n = len(bags)
    avg = average or (sum(map(len, bags.values())) / n if n else 0)
    df = {}
    for x in bags.values():
        for w in set(x):
            df[w] = df.get(w, 0) + 1
    out = {}
    for i, x in bags.items():
        for w in set(x):
            norm, tf = 1 - b + b * len(x) / avg, x.count(w)
            i_ = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if idf == "probabilistic" else math.log10(n / df[w])
            out[i, w] = i_ * (tf / norm if k1 is None else tf * (k1 + 1) / (tf + k1 * norm))
    return out


@pytest.mark.parametrize("k1, b, idf, average", [(1.2, 0.75, "probabilistic", None), (None, 1.0, "log10", 1.0), (0.0, 0.0, "log10", None)])
def test_relevance(spark, k1, b, idf, average):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["the", "fire", "Fire!", "x1", "été", f"w{r.randrange(40)}"]) for _ in range(r.randrange(9)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "!!"), (None, "fire"), *docs[:20]]
    df = spark.createDataFrame(docs, "term int, text string").selectExpr("*", "1 AS id", "2 AS tf", "3 AS df")
    got = {(x[0], x[1]): x[4] for x in relevance(df.toDF("doc", "text", "id2", "tf", "df"), "doc", "text", k1=k1, b=b, idf=idf, average_length=average).collect()}
    want = weigh(docs, k1, b, idf, average)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    few = relevance(df, "term", "text", k1=k1, b=b, idf=idf, average_length=average, min_df=2, min_score=0.2)
    n = {}
    for _, w in want:
        n[w] = n.get(w, 0) + 1
    assert few.count() == sum(v >= 0.2 and n[k[1]] >= 2 for k, v in want.items())


def test_relevance_edges(spark):
    none = spark.createDataFrame([], "id int, t string")
    assert relevance(none, "id", "t").count() == 0
    assert relevance(spark.createDataFrame([(1, None), (2, "")], "id int, t string"), "id", "t").count() == 0
    for bad in ({"k1": -1}, {"b": 2}, {"idf": "x"}):
        with pytest.raises(ValueError):
            relevance(none, "id", "t", **bad)
    long = spark.createDataFrame([(1, "ab " * 300_000), (2, "ab c")], "id int, t string")
    assert {(r["id"], r["term"]): r["tf"] for r in relevance(long, "id", "t").collect()} == {(1, "ab"): 300_000, (2, "ab"): 1, (2, "c"): 1}
