import random

import duckdb

from eventide.operators.stemmer import stem
from eventide.operators.tokenize import stop_words
from eventide.plans.stems import STOP, stems


def test_sql_stems_are_the_stems(spark):
    r = random.Random(3)
    heads = ["gener", "commun", "arsen", "rel", "hop", "cr", "fil", "happ", "nation", "y", "say", "boy", "electr", "tr", "abil", "succeed", "log"]
    tails = "s es ies ied eed eedly ed ing ingly ational tional ization fulness ousness iveness ative ement ion tion sion al ance e le ll ly li ogi logi er y icate iciti ical ness ful izer alli enci".split()
    words = sorted({h + a + b for h in heads for a in tails for b in r.sample(tails, 8)} | {h + t for h in heads for t in tails} | {"skis", "news", "inning", "proceed", "by", "a", "yy", "3ds"})
    got = dict(duckdb.sql("WITH " + stems(f"SELECT unnest({words!r})") + " SELECT word, stem FROM stemmed").fetchall())
    assert got == {w: stem(w) for w in words}
    assert set(STOP) == stop_words() and len(STOP) == 127
