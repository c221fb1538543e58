import base64
import os
import random
import unicodedata

import numpy as np
import pytest
import regex

from eventide.llm import quality as Q
from eventide.llm.bpe import Merger, ranks_of, split
from eventide.llm.encode import VOCABULARIES, encode
from eventide.llm.leaks import Items, leaks, suffix_array, words
from eventide.llm.lexicon import Lexicon
from eventide.llm.quality import State, counts, not_prose, quality

COMMON = frozenset({"the", "of", "été", "a", "und"})


def slow_counts(text):
    ln = lambda c: unicodedata.category(c)[0] in "LN"
    ws = [w for w in regex.split("[ \t\r\n]+", text) if w]
    lines = [x for x in (s.strip(" \t\r\n") for s in text.split("\n")) if x]

    def core(w):
        k = [i for i, c in enumerate(w) if ln(c)]
        return w[k[0] : k[-1] + 1].lower() if k else ""

    return [sum(map(len, ws)), sum(not ln(c) for w in ws for c in w), len(ws), sum(core(w) in COMMON for w in ws), len(lines), sum(x[-1] in ".!?…" for x in lines)]


def mess(r, n):
    return "".join(r.choice(["the", "The", " ", " ", "\n", "\t", "\r\n", ".", "…", "«", "été", "a", "1", " ", "﻿", "x" * 9, "und!", "😀", "--", "é"]) for _ in range(n))


def test_counts():
    r = random.Random(1)
    texts = [mess(r, r.randrange(60)) for _ in range(400)] + ["", " ", "\n\n", "a", " "]
    assert counts(texts, COMMON, 3).tolist() == [slow_counts(t) for t in texts]
    assert counts([], COMMON, 3).tolist() == [] and counts([""], COMMON, 3).tolist() == [[0] * 6]


def test_any_cutting_gives_the_same():
    r = random.Random(2)
    for _ in range(400):
        t = mess(r, r.randrange(50))
        cuts = sorted(r.randrange(len(t) + 1) for _ in range(r.randrange(7)))
        parts = [State.of(t[a:b], COMMON, 3) for a, b in zip([0, *cuts], [*cuts, len(t)])]
        while len(parts) > 1:  # in any order of merging
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], COMMON, 3)]
        assert list(parts[0].closed(COMMON)) == slow_counts(t), t


def test_quality(spark, monkeypatch):
    r = random.Random(3)
    texts = [mess(r, r.randrange(400)) for _ in range(60)] + [None, "", " \n", "the " * 9, "-" * 700 + "the" + "-" * 700, "ab" * 900]
    df = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "id int, text string").selectExpr("*", "1 AS words", "'x' AS row")
    common = spark.createDataFrame([("en", w) for w in sorted(COMMON)] + [("fr", "a"), ("de", None)], "lang string, word string")
    monkeypatch.setattr(Q, "FAN", 3)  # several levels of the tree
    for chunk in (Q.CHUNK, 40, 7):
        got = {x["id"]: tuple(x)[1:] for x in quality(df, "id", "text", common, "word", chunk=chunk).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            solid, symbols, n, hits, lines, marked = slow_counts(t or "")
            want = (n, solid / n, symbols / solid, marked / lines, hits / n) if n else (0, None, None, None, None)
            assert got[i if i != 5 else None] == pytest.approx(want), (chunk, i)


def test_not_prose(spark):
    df = spark.createDataFrame([(1, 0, None, None, None, None), (2, 9, 4.0, 0.1, 1.0, 0.3), (3, 9, 3.4, 0.1, 0.4, 0.3), (4, 9, 4.0, 0.16, 1.0, 0.14), (5, 9, 3.5, 0.15, 0.5, 0.15)], "id int, words bigint, mean_word_length double, symbol_ratio double, punctuated_share double, common_share double")
    assert sorted(r["id"] for r in not_prose(df).collect()) == [3, 4]
    assert not_prose(df.limit(0)).count() == 0


def test_suffix_array():
    r = random.Random(4)
    for depth in (2, 5, 13):
        c = np.array([r.choice([-1, 0, 1, 2]) for _ in range(300)])
        order = suffix_array(c, depth)
        keys = [tuple(c[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))
    assert len(suffix_array(np.zeros(0, int), 5)) == 0


def slow_leaks(docs, items, least):
    split_ = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = {}
    for d, t in docs:
        a = split_(t)
        for i, u in items:
            b = split_(u)
            best = (0, 0)
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, (n, -x))
            if best[0] >= least and d is not None and i is not None:
                out[d, i] = (best[0], -best[1])
    return out


@pytest.mark.parametrize("least, shard", [(3, 2_000_000), (3, 30), (1, 2_000_000)])
def test_leaks(spark, monkeypatch, least, shard):
    import eventide.llm.leaks as L

    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "PORTION", 11)
    r = random.Random(5)
    vocabulary = ["a", "B", "c", "Été", "x9", "d"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(12)))) for k in range(8)] + [(20, None), (21, ""), (22, "a b"), (None, "a b c d")]
    items += [(23, items[0][1])]
    docs = [(k, "; ".join(r.choice(vocabulary + ["zz"]) for _ in range(r.randrange(25)))) for k in range(40)] + [(90, None), (91, ""), (92, "a " * 500), (None, "a b c d a b c")]
    docs += [(93, docs[0][1])]
    got = leaks(spark.createDataFrame(docs, "item bigint, words string"), "item", "words", spark.createDataFrame(items, "id int, text string").selectExpr("id AS k", "text", "1 AS at"), "k", "text", least=least)
    assert {(x[0], x[1]): (x[2], x[3]) for x in got.collect()} == slow_leaks(docs, items, least)


def test_repeated_words_are_folded():
    import time
    import tracemalloc

    from eventide.llm.leaks import Longest, search

    items = Items.of([(7, "ha " * 200), (8, "ha " * 20 + "ho")], 13)
    ha = items.vocabulary["ha"]
    codes = np.append(np.full(200_000, ha), -1)
    longest = Longest()
    tracemalloc.start()
    began = time.time()
    for found in search(codes, np.full(len(codes), 1), np.arange(len(codes)), items, 13):
        longest.add(found)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert [tuple(x) for x in zip(*longest.result())] == [(1, 7, 200, 0), (1, 8, 20, 0)]


def test_leaks_in_blocks(spark, monkeypatch):
    import eventide.llm.leaks as L

    docs, items = spark.createDataFrame([(1, "a b c d e"), (2, "q r s")], "id int, t string"), spark.createDataFrame([(k, t) for k, t in enumerate(["a b c", "b c d", "q r s", "x y z"])], "k int, t string")
    monkeypatch.setattr(L, "ITEM_BYTES", 6)
    assert sorted((r[0], r[1]) for r in leaks(docs, "id", "t", items, "k", "t", least=3).collect()) == [(1, 0), (1, 1), (2, 2)]
    assert leaks(docs.limit(0), "id", "t", items, "k", "t").count() == 0 and leaks(docs, "id", "t", items.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        leaks(docs, "id", "t", items, "k", "t", least=0)
    assert [w for p in words("Ab-c 1x") for w in p] == ["ab", "c", "1x"] and len(Items.of([], 3).starts) == 0


def test_lexicon():
    r = random.Random(6)
    listed = sorted({bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 7))) for _ in range(300)} | {b" x", "é".encode()})
    ids = [[k, k + 1][: 1 + k % 2] for k in range(len(listed))]
    lex = Lexicon.build(listed, ids)
    assert lex.number(listed).tolist() == list(range(len(listed)))
    others = [b"", b"zzz", *(w + b"q" for w in listed[:20]), *(w[:-1] for w in listed)]
    assert [k >= 0 for k in lex.number(others).tolist()] == [w in set(listed) for w in others]
    assert len(lex.final) < sum(map(len, listed)) / 2  # states are shared
    assert Lexicon.build([], []).number([b"a"]).tolist() == [-1]


def test_mapped_lexicon(tmp_path):
    lex = Lexicon.build([b"a", b"ab", b"b"], [[1], [2, 3], []])
    (tmp_path / "l").write_bytes(lex.to_bytes())
    m = Lexicon.mapped(str(tmp_path / "l"))
    assert m.number([b"ab", b"c", b"b"]).tolist() == [1, -1, 2] and m.ids[m.first[1] : m.first[2]].tolist() == [2, 3]


needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{VOCABULARIES}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
STRANGE = ["", None, " ", "Hello world's end", "<|endoftext|> x", "a b c\u001cd", "a" * 3000, "  \n\n  x  ", "Привет 你好 😀 é", "it's 12345 !!??", "﻿x", "ab" * 40 + " " + "cd" * 90]


@needs_vocabulary
@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_encoding_is_that_of_a_public_library(spark, name):
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{VOCABULARIES}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    from eventide.llm.bpe import PATTERN

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    texts = STRANGE + ["".join(r.choice("ab  \n\t'sté1中😀.- ") for _ in range(200)) for _ in range(150)]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "ids int, word string")
    got = {x[0]: x[1] for x in encode(df.toDF("id", "text"), "id", "text", vocabulary=name).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i if i else None] == own.encode_ordinary(t or ""), repr(t)
    assert encode(df.limit(0), "ids", "word", vocabulary=name).count() == 0


@needs_vocabulary
def test_long_texts_are_cut_safely(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import eventide.llm.bpe as B

    with open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = ranks_of(f.read())
    own, merge = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={}), Merger(ranks)
    monkeypatch.setattr(B, "PORTION", 13)
    r = random.Random(8)
    for _ in range(200):
        t = "".join(r.choice(["a", "it's", " ", "  ", "\n", "1", "!", " x", "é"]) for _ in range(60))
        assert [i for p in split(t) for w in p for i in merge(w.encode())] == own.encode_ordinary(t)


@needs_vocabulary
def test_every_character_of_the_basic_plane():
    tiktoken = pytest.importorskip("tiktoken")
    from eventide.llm.bpe import PATTERN

    with open(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = ranks_of(f.read())
    own, merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Merger(ranks)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}1 {chr(c)} {chr(c)}b"
            assert [i for p in split(t) for w in p for i in merge(w.encode())] == own.encode_ordinary(t), hex(c)
