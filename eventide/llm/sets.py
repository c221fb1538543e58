"""All similar pairs of set-valued records, within and between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .prefix import similar_pairs

#: Copies of a set that one task pairs with each other.
COPIES = 2_000


def term_sets(rows: DataFrame, id_col: str, terms_col: str) -> DataFrame:
    """``(id, terms)`` of each row with an id and a term: the sorted hashes of its distinct terms, trimmed of spaces and lower-cased, without nulls and blanks.

    Two terms of equal 64-bit hash count as one: to be expected once among some billions of distinct terms.
    """
    clean = F.filter(F.transform(F.col(terms_col).cast("array<string>"), lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (F.length(F.translate(t, "\t\r\n ", "")) > 0))
    keys = F.array_sort(F.array_distinct(F.transform(clean, lambda t: F.xxhash64(t))))
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), keys.alias("terms")).filter(F.size("terms") > 0)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, terms)`` of one record of each different set, its smallest id, and ``(id, rep, copies)`` of all records; ``rows`` are ``term_sets``.

    An id counts once; of several sets of one id the one with the greatest key counts. Sets are told apart by a key of 128 bits, so terms move once.
    """
    keyed = rows.withColumns({"k": F.xxhash64("terms"), "l": F.xxhash64(F.lit(1), "terms")})
    one = runtime.cut(keyed.groupBy("id").agg(F.max(F.struct("k", "l")).alias("m")).select("id", "m.k", "m.l"))
    first = one.groupBy("k", "l").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    sets = keyed.groupBy("k", "l").agg(F.first("terms").alias("terms")).join(first, ["k", "l"])
    member = runtime.cut(one.join(first, ["k", "l"]).select("id", "rep", "copies"))
    return runtime.cut(sets.select(F.col("rep").alias("id"), "terms")), member


def similar_sets(tables: list[tuple[DataFrame, str, str]], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Similar pairs between sets, and who has which set: ``(a, b, distance)`` and ``(id, rep, copies)``.

    ``tables`` are (rows, integer id column, array column); ids are one space over all tables. Records with equal sets are a
    class, represented by its smallest id; pairs are between representatives, a < b, with a Jaccard similarity of
    ``threshold`` or more (equality included). Empty sets are similar to nothing and in no class. Ids that come again (in any table) count
    once; other columns are ignored.
    """
    sets = None
    for rows, id_col, terms_col in tables:
        runtime.prepare(rows.sparkSession)
        one = term_sets(rows, id_col, terms_col)
        sets = one if sets is None else sets.unionByName(one)
    records, members = classes(sets)
    return similar_pairs(records, threshold), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All similar pairs of ids ``(a, b)``, a < b, copies of equal sets included.

    A class of many copies is paired in blocks, so that no task holds more than a bounded share of it. The result is as large as the question: a class
    of c copies has c (c - 1) / 2 pairs. Where that is too much, use the pairs of representatives and the members of their classes.
    """
    many = members.filter("copies > 1")
    by = lambda c: many.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"))
    wide = pairs.select("a", "b").join(by("a"), "a", "left").join(by("b"), "b", "left")
    x, y = F.coalesce("a_id", "a"), F.coalesce("b_id", "b")
    between = wide.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    parts = F.ceil(F.col("copies") / COPIES).cast("int")
    left = many.select("rep", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    right = many.select(F.col("rep"), F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    within = left.join(right, ["rep", "part"]).filter("a < b").select("a", "b")
    return between.unionByName(within)
