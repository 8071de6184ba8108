"""Readers of labelled vectors, gridded data and their masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.functions.vectors import as_double
from cumulus.session import materialise


def read_delimited_points(spark: SparkSession, path: str, features: int, label_offset: int = 1, split: str | None = None) -> DataFrame:
    """Space-padded, comma-separated features with the class in the last column: (id, x, label[, split]).

    Text rows carry no key, so ids are given once at load and written with the rows; they do not change when
    a lost task is run again. A line that is malformed or has an empty field is an error.
    """
    schema = T.StructType([*[T.StructField(f"f{i}", T.DoubleType()) for i in range(features)], T.StructField("class", T.IntegerType())])
    raw = spark.read.csv(path, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")
    # FAILFAST lets empty fields pass as nulls
    whole = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"empty field {c}"))).otherwise(F.col(c)).alias(c) for c in raw.columns]
    rows = raw.select(*whole).select(
        F.monotonically_increasing_id().alias("id"), F.array(*[F.col(f"f{i}") for i in range(features)]).alias("x"),
        (F.col("class") + label_offset).alias("label"), *([F.lit(split).alias("split")] if split else []),
    )
    return materialise(rows, "points")


def write_vectors(points: DataFrame, path: str) -> None:
    """Labelled vectors by part (train, test), one folder each."""
    points.write.mode("overwrite").partitionBy("split").parquet(path)


def read_vectors(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(id, x, label, split), vectors in double precision; a part asked for prunes the other folders."""
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    return rows.select("id", as_double("x").alias("x"), "label", "split")


def read_masked_matrix(spark: SparkSession, points_path: str, mask_path: str) -> tuple[DataFrame, DataFrame]:
    """Observations (id, x) and the mask (cell_id, id) that places them on a grid."""
    points = spark.read.parquet(points_path).select("id", as_double("x").alias("x"))
    return points, spark.read.parquet(mask_path).select("cell_id", "id")
