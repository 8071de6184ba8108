"""Registry and helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the same result in DuckDB's SQL, where it can be expressed."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def ordinals(df: DataFrame, groups: list[str], digest: str, ties: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 in each group, in the order of (``digest``, ``ties``); ``digest`` is a hexadecimal text.

    Two levels: rows are numbered inside buckets of the first three digits, and a bucket starts where the counts
    of the buckets before it end. So no group is sorted in one task, and the counts hold at most 4,096 rows a
    group. Reads ``df`` twice: give it a written table. Rows equal in all of these columns may swap numbers.
    """
    # one key column of each side: the join keeps the partitions of the window, and nulls match inside a struct
    group, bucket = F.struct(*[F.col(g) for g in groups]), F.substring(digest, 1, 3)
    cut = df.withColumn("__key", F.struct(group.alias("g"), bucket.alias("b")))
    counts = cut.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__key.g").orderBy("__key.b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__key", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("__key").orderBy(digest, *ties)) - 1
    numbered = cut.withColumn("__inside", inside).join(starts, "__key")
    return numbered.select(*df.columns, (F.col("__start") + F.col("__inside")).cast("long").alias(out))


def written_order(docs: DataFrame, out: str) -> DataFrame:
    """``docs``, a written table as it was read, with the gapless number from 0 of each row in the order it was written.

    Spark numbers a table's part files in the order of the partitions and reads them in any order.
    """
    file = F.col("_metadata.file_name")
    part = F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")
    counts = docs.groupBy(file.alias("__file")).agg(F.count(F.lit(1)).alias("__n"), F.first(part).alias("__part"))
    before = W.orderBy("__part", "__file").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = docs.select("*", file.alias("__name"), F.col("_metadata.row_index").alias("__row"))
    # bounded: a row for each file
    placed = rows.join(F.broadcast(starts), F.col("__name") == F.col("__file"))
    return placed.select(*docs.columns, (F.col("__start") + F.col("__row")).alias(out))


def batches_of(batch, rows: int) -> Iterable:
    """Slices of an Arrow batch with at most ``rows`` rows each."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files behind tables that have been written: it acts when the driver collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
