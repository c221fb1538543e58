"""Table and file sources, and guarded table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; timestamps without zone stay so."""
    runtime.prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """A text file with one document per line as ``(doc_id BIGINT, txt STRING)``.

    Ids follow the order of the lines within a file and are unique, not dense: numbering lines
    densely would need a pass over the whole file before the first id is known.
    """
    return spark.read.text(path).select((F.monotonically_increasing_id() + F.lit(first_id)).alias("doc_id"), F.col("value").alias("txt"))


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a table of that name exists, in any database unless one is given; case and outer blanks are ignored."""
    name = name.strip().lower()
    if "." in name:
        return spark.catalog.tableExists(name)
    return any(spark.catalog.tableExists(f"{d.name}.{name}") for d in spark.catalog.listDatabases())


def save_table(tables: dict[str, DataFrame], overwrite: bool = False) -> None:
    """Save all of ``tables`` (name to rows), or none: an existing name without ``overwrite`` raises first."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    there = [n for n in tables if spark.catalog.tableExists(n.strip().lower())]
    if there and not overwrite:
        raise ValueError(f"table exists already: {', '.join(sorted(there))}; set overwrite to replace it")
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name.strip().lower())


def jdbc(spark: SparkSession, url: str, table: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database by JDBC; with ``split_by`` it is read in ``parts`` ranges of that column at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_by:
        reader = reader.options(partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def save_jdbc(df: DataFrame, url: str, table: str, overwrite: bool = False, parts: int = 8, batch: int = 10_000, **options: str) -> None:
    """Load rows into a table of a database in bulk, ``parts`` connections with batches of ``batch`` rows; an existing table without ``overwrite`` raises."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(parts), batchsize=str(batch), **options)
    writer.mode("overwrite" if overwrite else "errorifexists").save()


def save_files(df: DataFrame, path: str, kind: str = "csv", overwrite: bool = False) -> None:
    """Write "csv" (with a header), "json" or "parquet" files."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError("kind is 'csv', 'json' or 'parquet'")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
