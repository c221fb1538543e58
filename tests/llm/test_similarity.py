import math
import random

import numpy as np
import pytest

from eventide.llm import forest as FO
from eventide.llm.cells import similar
from eventide.llm.condense import Condenser, Part, clusters, described
from eventide.llm.density import neighbour_graph, vectors
from eventide.llm.forest import forest, spanning_forest
from eventide.llm.prefix import similar_pairs
from eventide.llm.sets import classes, expanded, similar_sets, term_sets


def sets(n, seed=1):
    r = random.Random(seed)
    base = [[f"t{r.randrange(400)}" for _ in range(r.randrange(3, 14))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            s[r.randrange(len(s))] = r.choice(["hot", "warm", f"t{r.randrange(400)}"])
        out.append((i, [w.upper() if r.random() < 0.2 else f" {w} " if r.random() < 0.2 else w for w in s] + r.choice([[], [None], [" "], s[:1]])))
    return out


def clean(terms):
    return {t.strip(" ").lower() for t in terms or [] if t is not None and t.strip(" \t\r\n")}


def jaccard_pairs(records, threshold):
    s = {}
    for i, t in records:
        if clean(t):
            s[i] = clean(t)
    ids = sorted(s)
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-12)


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8, 1.0])
def test_similar_sets(spark, threshold):
    a, b = sets(220), [(1000 + i, t) for i, t in sets(150)]
    extra = [(5000, None), (5001, []), (5002, [None, " "]), (5003, ["x"]), (5004, ["X ", "x"]), *a[:9]]
    left = spark.createDataFrame(a + extra, "did int, terms array<string>").selectExpr("*", "'c' AS id", "1 AS cell", "2 AS weights")
    right = spark.createDataFrame(b, "key long, words array<string>")
    pairs, members = similar_sets([(left, "did", "terms"), (right, "key", "words")], threshold)
    got = sorted(map(tuple, expanded(pairs, members).collect()))
    assert got == jaccard_pairs(a + extra + b, threshold)
    reps = {r["id"]: r["rep"] for r in members.collect()}
    assert all(reps[reps[i]] == reps[i] <= i for i in reps) and 5000 not in reps


@pytest.mark.parametrize("block, entries", [(20_000, 200_000), (40, 50), (7, 200_000)])
def test_large_cells_are_dealt_in_blocks(spark, monkeypatch, block, entries):
    import eventide.llm.prefix as P

    monkeypatch.setattr(P, "ENTRIES", entries)
    monkeypatch.setattr(P, "PAIRS", 4 * entries)
    r = random.Random(9)
    records = [(i, sorted({"common", *(f"w{r.randrange(30)}" for _ in range(6))})) for i in range(400)]
    held, _ = classes(term_sets(spark.createDataFrame(records, "id long, t array<string>"), "id", "t"))
    kept = {r["id"] for r in held.collect()}
    want = jaccard_pairs([x for x in records if x[0] in kept], 0.6)
    got = similar_pairs(held, 0.6, block=block).collect()  # with 30 terms every cell is larger than 40 records
    assert sorted((x["a"], x["b"]) for x in got) == want
    sets_ = dict(records)
    assert all(x["distance"] == pytest.approx(1 - len({*sets_[x["a"]]} & {*sets_[x["b"]]}) / len({*sets_[x["a"]]} | {*sets_[x["b"]]})) for x in got)


def test_any_order_of_terms_is_right(spark, monkeypatch):
    import eventide.llm.order as O

    monkeypatch.setattr(O, "STEPS", 1)  # a coarse table
    a = sets(150, seed=5)
    pairs, members = similar_sets([(spark.createDataFrame(a, "id int, t array<string>"), "id", "t")], 0.5)
    assert sorted(map(tuple, expanded(pairs, members).collect())) == jaccard_pairs(a, 0.5)


def test_an_id_with_several_sets_counts_once(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c", "d"]), (2, ["a", "b"]), (3, ["c", "d"])], "id int, t array<string>")
    pairs, members = similar_sets([(df, "id", "t")], 0.6)
    assert len(expanded(pairs, members).collect()) == 1 and members.filter("id = 1").count() == 1


def test_many_copies(spark):
    df = spark.createDataFrame([(i, ["a", "b"]) for i in range(60)] + [(100 + i, ["a", "b", "c"]) for i in range(3)], "id int, t array<string>")
    import eventide.llm.sets as S

    kept, S.COPIES = S.COPIES, 7
    try:
        got = sorted(map(tuple, expanded(*similar_sets([(df, "id", "t")], 0.6)).collect()))
    finally:
        S.COPIES = kept
    assert got == jaccard_pairs([tuple(r) for r in df.collect()], 0.6)


def test_empty(spark):
    none = spark.createDataFrame([], "id int, t array<string>")
    pairs, members = similar_sets([(none, "id", "t")], 0.6)
    assert expanded(pairs, members).count() == 0
    v = spark.createDataFrame([], "cid int, term string, weight double")
    assert clusters(vectors(v, "cid", "term", "weight"), 0.7).count() == 0
    with pytest.raises(ValueError):
        similar(none, 0)


def weighted(n, seed=2):
    r = random.Random(seed)
    base = [{f"t{r.randrange(300)}": r.random() + 0.2 for _ in range(r.randrange(3, 12))} for _ in range(n // 5)]
    out = {}
    for i in range(n):
        v = dict(r.choice(base))
        v["hot"] = r.random() * 0.3
        for _ in range(r.randrange(3)):
            v[f"t{r.randrange(300)}"] = r.random()
        scale = r.choice([1.0, 1.0, 7.0])
        out[i] = {t: w * scale for t, w in v.items()}
    out[n], out[n + 1] = dict(out[0]), dict(out[0])
    return out


def cosine(a, b):
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def groups(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def rows_of(v):
    return [(i, t, w) for i, x in v.items() for t, w in x.items()]


def test_linked_groups(spark):
    v = weighted(150)
    bad = [(1, "t1", float("nan")), (1, "t2", float("inf")), (2, "zz", 0.0), (2, "zz", -1.0), (None, "a", 1.0), (3, None, 1.0), (3, " ", 1.0), (900, "t1", None)]
    data = rows_of(v) + rows_of(v)[:40] + bad
    data = [(i, t.upper() if t and k % 5 == 0 else t, w) for k, (i, t, w) in enumerate(data)]
    df = spark.createDataFrame(data, "id int, term string, weight double")
    got = {r["id"]: r["group"] for r in clusters(vectors(df, "id", "term", "weight"), 0.7).collect()}
    pairs = [(a, b) for a in v for b in v if a < b and cosine(v[a], v[b]) >= 0.7]
    assert got == groups(v, pairs) and len(set(got.values())) < len(v)


def test_mutual_reachability(spark):
    v = weighted(80)
    df = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    edges, member = neighbour_graph(vectors(df, "id", "term", "weight"), 0.5, 3)
    reps = {r["id"]: r["rep"] for r in member.collect()}
    assert reps[81] == reps[80] == 0
    own = sorted(set(reps.values()))
    copies = {i: sum(x == i for x in reps.values()) for i in own}
    d = {(a, b): 1 - cosine(v[a], v[b]) for a in own for b in own if a != b and cosine(v[a], v[b]) >= 0.5}
    core = {}
    for a in own:
        near = sorted([(0.0, a)] + [(x, b) for (q, b), x in d.items() if q == a])
        n = 0
        for x, b in near:
            n += copies[b]
            if n >= 3:
                core[a] = x
                break
    want = {(a, b): max(x, core[a], core[b]) for (a, b), x in d.items() if a < b and a in core and b in core}
    got = {(r["a"], r["b"]): r["distance"] for r in edges.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def kruskal(edges):
    up, out = {}, []

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for d, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            out.append((a, b, d))
    return sorted(out), {x: find(x) for x in list(up)}


@pytest.mark.parametrize("finish", [1_000_000, 5])
def test_spanning_forest(spark, finish):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60) + 60 * (k % 2), r.choice([0.1, 0.2, 0.2, 0.3])) for k in range(150)] + [(500, 501, 0.5), (7, 7, 0.0)]
    edges += [(b, a, d) for a, b, d in edges[:20]] + [(600 + k, 601 + k, 0.1) for k in range(25)]
    tree, root = spanning_forest(spark.createDataFrame(edges, "a long, b long, distance double").repartition(3), finish)
    want, label = kruskal([e for e in edges if e[0] != e[1]])
    assert sorted(map(tuple, tree.collect())) == want
    got = {x["id"]: x["root"] for x in root.collect()}
    assert got.keys() == label.keys()
    assert {frozenset(k for k in got if got[k] == x) for x in got.values()} == {frozenset(k for k in label if label[k] == x) for x in label.values()}


def test_forest_in_a_task_is_kruskal():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 80, 400), r.integers(0, 80, 400)
    d = r.integers(1, 6, 400) / 10
    keep, nodes, roots = forest(np.minimum(a, b), np.maximum(a, b), d, np.minimum(a, b), np.maximum(a, b))
    got = sorted((int(min(a[k], b[k])), int(max(a[k], b[k])), float(d[k])) for k in keep)
    assert got == kruskal([(int(x), int(y), float(z)) for x, y, z in zip(a, b, d) if x != y])[0]
    assert FO.GATHER > 0 and len(nodes) == len(roots)


def condense(copies, edges, least, furthest, bands=1):
    """(cluster, density) of each node, by the classes that a task uses; the edges in some bands."""
    edges = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    parts = [Part(k, n, None, 0.0, 0.0, False, [k], 1000.0) for k, n in enumerate(copies)]
    rows, at, size = [], list(range(len(copies))), -(-len(edges) // bands)
    for band in range(bands):
        c = Condenser(0, band, least)
        for p in parts:
            c.add(p)
        for a, b, d in edges[band * size : (band + 1) * size]:
            c.edge(at[a], at[b], d)
        got = c.end(band == bands - 1, furthest)
        parts = [Part(*r[2:]) for r in got if r[0] == 3]
        moved = {r[2]: r[3] for r in got if r[0] == 2}
        at = [moved.get(x, x) for x in at]
        rows += [r for r in got if r[0] < 2]
    way = {r[4].split()[0]: r[4].split()[1:] for r in rows if r[0] == 1}
    out = [(None, 0.0)] * len(copies)
    for r in rows:
        if r[0] == 0:
            best, c = "-", r[4]
            while c != "-":
                c, widest = way[c]
                best = widest if widest != "-" else best
            out[r[2]] = (None if best == "-" else best, r[5])
    return out


def test_condense_keeps_the_stable_clusters():
    # two tight triples, joined far away, and a loose point
    pairs = list(zip([0, 1, 3, 4, 2, 5], [1, 2, 4, 5, 3, 6]))
    got = condense([1] * 7, [(*p, d) for p, d in zip(pairs, [0.05, 0.05, 0.04, 0.04, 0.29, 0.3])], 3, 0.3)
    label = [c for c, _ in got]
    assert len({*label[:3]}) == len({*label[3:6]}) == 1 and label[0] != label[3] and label[6] is None
    assert got[0][1] == pytest.approx(20) and got[3][1] == pytest.approx(25)
    # hardly apart: one cluster
    got = condense([1] * 7, [(*p, d) for p, d in zip(pairs, [0.05, 0.05, 0.05, 0.05, 0.051, 0.3])], 3, 0.3)
    assert len({c for c, _ in got[:6]}) == 1
    # copies are a cluster of their own
    assert condense([5, 1], [(0, 1, 0.2)], 3, 0.3)[0][0] is not None


def test_bands_give_the_same_hierarchy():
    r = random.Random(3)
    for least in (2, 3, 5):
        n = 120
        copies = [r.choice([1, 1, 1, 2, 6]) for _ in range(n)]
        edges = [(r.randrange(k), k, r.choice([0.0, 0.01, 0.05, 0.1, 0.1, 0.2, 0.25])) for k in range(1, n)]
        want = condense(copies, edges, least, 0.3)
        for bands in (2, 7, 30):
            got = condense(copies, edges, least, 0.3, bands)
            assert [d for _, d in got] == [d for _, d in want]
            names = {}
            assert all(names.setdefault(a, b) == b for (a, _), (b, _) in zip(got, want)) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("band", [9, 60])
def test_clusters_in_bands(spark, monkeypatch, band):
    import eventide.llm.condense as O

    v = {i: {f"g{i % 3}": 2.0, f"h{i % 12}": 1.0, f"w{i}": 0.1 + 0.01 * (i % 7)} for i in range(70)}
    df = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    held = vectors(df, "id", "term", "weight").cache()
    want = sorted(map(tuple, clusters(held, 0.7).collect()), key=repr)
    monkeypatch.setattr(O, "BAND", band)
    assert sorted(map(tuple, clusters(held, 0.7).collect()), key=repr) == want and len({x[1] for x in want}) > 3


def test_clusters_described(spark):
    v = {i: {"a": 1.0, "b": 1.0, f"x{i}": 0.1 + 0.02 * i} for i in range(4)} | {10 + i: {"q": 1.0, "r": 2.0, f"y{i}": 0.2} for i in range(3)} | {20: {"z": 1.0}, 21: {"a": 1.0, "b": 1.0, "x0": 0.1}}
    df = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    members = clusters(vectors(df, "id", "term", "weight"), 0.7)
    lead = {r["id"]: r["lead"] for r in members.collect()}
    assert lead == {0: 0, 1: 0, 2: 0, 3: 0, 21: 0, 10: 10, 11: 10, 12: 10, 20: None}
    sizes = spark.createDataFrame([(0, 5), (1, None), (10, 2), (10, 2), (11, 0)], "id int, n int")
    got = {r["lead"]: (r["members"], r["doc_count"], r["exemplars"]) for r in described(members, sizes, "id", "n").collect()}
    assert got[10][:2] == (3, 2) and got[0][:2] == (5, 5) and got[0][2] == [0, 1, 21]


def test_small_groups_are_described(spark):
    # a pair, a pair of equal vectors, a group of four and a vector alone
    v = {1: {"a": 1.0, "b": 0.9}, 2: {"a": 1.0, "b": 1.1}, 5: {"c": 1.0}, 6: {"c": 2.0, "d": 0.1}, 7: {"e": 1.0}, 8: {"e": 1.0}, 9: {"f": 1.0}}
    v |= {10 + i: {"q": 1.0, "r": 2.0, f"y{i}": 0.2} for i in range(4)}
    df = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    sizes = spark.createDataFrame([(i, i) for i in v], "id int, n int")
    for least in (3, 4, 5):
        members = clusters(vectors(df, "id", "term", "weight"), 0.7, least_size=least).cache()
        assert {r["id"]: r["lead"] for r in members.collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: None, 10: 10, 11: 10, 12: 10, 13: 10}
        got = {r["lead"]: (r["members"], r["doc_count"], r["exemplars"]) for r in described(members, sizes, "id", "n").collect()}
        assert got == {1: (2, 3, [1, 2]), 5: (2, 11, [5, 6]), 7: (2, 15, [7, 8]), 10: (4, 46, got[10][2])} and len(got[10][2]) == 3
        kept = {r["id"]: r["persistence"] for r in members.collect()}
        assert kept[1] == kept[2] == pytest.approx(1 / (1 - cosine(v[1], v[2])), rel=1e-4)
        assert kept[7] == kept[8] == 1000


@pytest.mark.parametrize("block", [20_000, 15])
def test_dense_cells(spark, block):
    r = random.Random(11)
    v = {}
    for i in range(160):  # dense groups around a few words, and records between them
        k = r.randrange(4)
        v[i] = {f"hot{k}": 3.0, f"hot{(k + r.randrange(2)) % 4}": r.choice([0.1, 2.5]), f"n{r.randrange(60)}": r.random(), "all": 0.2}
    df = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    every = similar(vectors(df, "id", "term", "weight").cache(), 0.8, block=block).collect()
    assert sorted((x["a"], x["b"]) for x in every) == sorted((a, b) for a in v for b in v if a < b and cosine(v[a], v[b]) >= 0.8)


@pytest.mark.parametrize("longest", [1, 7, 10])
def test_long_records(spark, monkeypatch, longest):
    import eventide.llm.cells as cells

    monkeypatch.setattr(cells, "LONG", longest)
    v = weighted(100)
    w = spark.createDataFrame(rows_of(v), "id int, term string, weight double")
    got = clusters(vectors(w, "id", "term", "weight"), 0.7).collect()
    assert {r["id"]: r["group"] for r in got} == groups(v, [(x, y) for x in v for y in v if x < y and cosine(v[x], v[y]) >= 0.7])


def test_very_long_sets(spark):
    big = spark.range(1, 4).selectExpr("id", "transform(sequence(1L, 60000L), x -> concat('t', x + id * 5000)) AS t").union(spark.createDataFrame([(9, ["t1", "t2"])], "id long, t array<string>"))
    pairs, members = similar_sets([(big, "id", "t")], 0.6)
    assert sorted(map(tuple, expanded(pairs, members).collect())) == [(1, 2), (1, 3), (2, 3)]
