"""Reshaping and keyed joins of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.operators.ordering import number_rows


def pivot(df: DataFrame, index: list[str], names: str, value: str, columns: list[str]) -> DataFrame:
    """Long to wide with named columns, so no extra job is spent on finding them."""
    return df.groupBy(*index).pivot(names, columns).agg(F.first(value, ignorenulls=True))


def transpose_summary(df: DataFrame, name: str, stats: list[str], columns: list[str]) -> DataFrame:
    """One row per statistic, one column per name."""
    long = df.select(name, *[F.col(s).cast("double").alias(s) for s in stats]).unpivot([name], stats, "desc", "value")
    return pivot(long, ["desc"], name, "value", columns)


def move_column(df: DataFrame, column: str, position: int) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:position], column, *rest[position:])


def union_modes(parts: list[DataFrame], mode: str = "mode") -> DataFrame:
    """Runs of several experiments in one table, tagged by their position."""
    out = parts[0].withColumn(mode, F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn(mode, F.lit(i)))
    return out


def parameter_grid(spark, **axes: list) -> DataFrame:
    """Every combination of the parameter values; the axes are literal lists."""
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, values in axes.items():
        out = out.select(*out.columns, F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.drop("_one")


def unfinished(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid points without a stored run: what is left to do after a restart."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def join_by_row_number(left: DataFrame, right: DataFrame, order: list[Column | str], keys: list[str] = []) -> DataFrame:
    """Positional join of two sorted tables; names that occur in both get ``_1`` on the right."""
    l = number_rows(left, keys, order, "row_id")
    r = number_rows(right, keys, order, "row_id")
    r = r.select("row_id", *keys, *[F.col(c).alias(f"{c}_1" if c in left.columns else c) for c in right.columns if c not in keys])
    return l.join(r, ["row_id", *keys])


def recode(df: DataFrame, name: str, codes: list[str], out: str) -> DataFrame:
    """Distinct names in sorted order take the codes in order; names beyond the list get none."""
    names = number_rows(df.select(name).distinct(), [], [F.col(name)], "_p")
    return df.join(names.select(name, F.get(F.array(*[F.lit(c) for c in codes]), F.col("_p") - 1).alias(out)), name)


def scatter_on_grid(grid: DataFrame, mask: DataFrame, values: DataFrame, value: str, fill: float = -1e30) -> DataFrame:
    """Grid cells with the value of the observation they carry, ``fill`` elsewhere."""
    placed = grid.join(mask, "cell_id", "left").join(values.select("id", value), "id", "left")
    return placed.select(*grid.columns, F.coalesce(F.col(value).cast("double"), F.lit(fill)).alias(value))


def names_missing(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    return left.select(name).distinct().join(right.select(name), name, "left_anti")
