"""Token ids of a whole corpus by a public byte-level vocabulary.

A first pass counts the words of all texts; the frequent ones, with their ids, become a minimal acyclic transducer in a file of
the shared folder. The second pass splits the texts, looks the different words of a batch up in the mapped
transducer all at once, and merges the unseen ones exactly.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from .bpe import Merger, ranks_of, split
from .lexicon import Lexicon

#: Words in the lexicon hold at least this share of all occurrences, so there are at most its inverse of them; and the longest of them, bytes.
LISTED_SHARE, LISTED_BYTES = 1 / 60_000, 48
#: Where the vocabularies lie, unless told otherwise.
VOCABULARIES = "/opt/tokenizers"


@lru_cache(2)
def _merger(data: bytes) -> Merger:
    return Merger(ranks_of(data))


@lru_cache(4)
def _lexicon(path: str) -> Lexicon:
    return Lexicon.mapped(path)


def _share(spark: SparkSession, data: bytes) -> str:
    """Puts a file where every executor can map it; its path, or its bare name if it was sent to the executors."""
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = runtime.work_folder(spark)
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        os.makedirs(place.path, exist_ok=True)
        path = os.path.join(place.path, name)
        with open(path, "wb") as f:
            f.write(data)
        return path
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if v is None else v.decode("utf-8", "replace") for v in batch.column("text").cast(pa.binary()).to_pylist()]


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in it:
        for text in _texts(batch):
            for words in split(text):
                held.update(words)
            if len(held) > 500_000:
                yield out()
                held = Counter()
    if held:
        yield out()


def frequent_words(documents: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)``: the words of all texts that the lexicon lists."""
    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    n = texts.mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = runtime.cut(n)
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.filter((F.col("n") >= max(2, total * LISTED_SHARE)) & (F.octet_length("word") <= LISTED_BYTES))


def encode(documents: DataFrame, id_col: str, text_col: str, *, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(id, ids)``: the token ids of each row's text, without special tokens (their strings are ordinary text).

    ``vocabulary`` names a file of ranks (``.tiktoken``) in ``folder``, which only the driver reads. Null and empty texts have an empty list.
    Every row of the input gives a row, also those of equal or null ids. Other columns are ignored.
    """
    spark = documents.sparkSession
    runtime.prepare(spark)
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        data = f.read()
    listed = sorted(bytes(r["word"]) for r in frequent_words(documents, text_col).select("word").collect())  # bounded by LISTED_SHARE
    merge = _merger(data)
    path = _share(spark, Lexicon.build(listed, [merge(w) for w in listed]).to_bytes())
    ranks = spark.sparkContext.broadcast(data)  # fixed size
    kind = dict(documents.dtypes)[id_col]

    def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        lexicon = _lexicon(path if path[0] == "/" else SparkFiles.get(path))
        code, distinct = pd.factorize(np.array(words, object))
        raw = [w.encode("utf-8", "replace") for w in distinct]
        number = lexicon.number(raw)
        first, size = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        known = number >= 0
        first[known] = lexicon.first[number[known]]
        size[known] = lexicon.first[number[known] + 1] - first[known]
        unseen = np.flatnonzero(~known)
        merge = _merger(ranks.value)
        merged = [merge(raw[k]) for k in unseen]
        size[unseen] = [len(m) for m in merged]
        first[unseen] = len(lexicon.ids) + np.cumsum(size[unseen]) - size[unseen]
        pool = np.concatenate([lexicon.ids, np.fromiter((i for m in merged for i in m), np.int32)])
        n = size[code]
        return pool[np.repeat(first[code] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, len(whole), 2000):
                batch = whole.slice(lo, 2000)
                size = np.zeros(len(batch), np.int64)
                ids, words, owner = [], [], []

                def flush() -> None:
                    if words:
                        own, n = ids_of(words)
                        ids.append(own)
                        np.add.at(size, np.repeat(*map(np.asarray, zip(*owner))), n)
                        words.clear()
                        owner.clear()

                for k, text in enumerate(_texts(batch)):
                    for part in split(text):
                        words.extend(part)
                        owner.append((k, len(part)))
                        if len(words) > 300_000:
                            flush()
                flush()
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "ids"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
