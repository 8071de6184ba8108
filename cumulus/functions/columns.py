"""Scalar column functions on result tables: names, nulls, traces, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: str | Column) -> Column:
    """Failed runs carry NaN; Spark sorts NaN above every number, so it becomes NULL at load."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def log_positive(c: str | Column) -> Column:
    """Variance-stabilising logarithm; NULL where it is undefined."""
    c = _col(c)
    return F.when(c > 0, F.log(c))


def rename_suffix(c: str | Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace name endings, one pair after the other."""
    out = _col(c)
    for old, new in pairs:
        stem = F.substring(out, F.lit(1), F.length(out) - F.lit(len(old)))
        out = F.when(out.endswith(old), F.concat(stem, F.lit(new))).otherwise(out)
    return out


def run_components(c: str | Column) -> tuple[Column, Column]:
    """(components, dimension) of a data-set name ending in ``<c>-D<d>``; NULLs for any other name."""
    pattern = r"(\d+)-D(\d+)$"
    return tuple(F.regexp_extract(_col(c), pattern, g).try_cast("int") for g in (1, 2))


def run_time(c: str | Column) -> Column:
    return F.timestamp_seconds(_col(c))


def drop_head(c: str | Column, n: int) -> Column:
    c = _col(c)
    return F.substring(c, F.lit(n + 1), F.greatest(F.length(c) - n, F.lit(0)))


def described(method: str | Column, dataset: str | Column, head: int = 5) -> Column:
    """``<data set>,<method without its leading characters>``"""
    return F.concat_ws(",", _col(dataset), drop_head(method, head))


def padded_label(prefix: str, number: str | Column, width: int = 2) -> Column:
    return F.concat(F.lit(prefix), F.lpad(_col(number).cast("string"), width, " "))


def round_half_even(c: str | Column, digits: int) -> Column:
    return F.bround(_col(c), digits)


def pad_trace(c: str | Column, size: int) -> Column:
    """Extend a score trace to ``size`` points with its last value."""
    c = _col(c)
    missing = F.greatest(F.lit(size) - F.size(c), F.lit(0))
    return F.when(F.size(c) > 0, F.concat(c, F.array_repeat(F.element_at(c, -1), missing))).otherwise(c)


def trim_trace(df: DataFrame, trace: str, first: int = 8) -> DataFrame:
    """One row per trace point from the ``first`` on; the axis counts the clusters that remain."""
    kept = F.slice(F.col(trace), F.lit(first), F.greatest(F.size(trace) - (first - 1), F.lit(0)))
    return (
        df.filter(F.size(trace) >= first)
        .withColumn("_kept", kept)
        .select(*[c for c in df.columns if c != trace], F.size("_kept").alias("_k"), F.posexplode("_kept").alias("pos", "score"))
        .withColumn("clusters", F.col("_k") - F.col("pos"))
        .drop("_k")
    )


def explode_parallel(df: DataFrame, names: list[str]) -> DataFrame:
    """Parallel arrays to one row per position."""
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.explode(F.arrays_zip(*names)).alias("_z")).select(*keep, *[F.col(f"_z.{n}").alias(n) for n in names])


def explode_maps(df: DataFrame, lead: str, others: list[str], key: str) -> DataFrame:
    """One row per key of the ``lead`` map, the other maps looked up by that key."""
    keep = [c for c in df.columns if c not in (lead, *others)]
    return df.select(*keep, *others, F.explode(lead).alias(key, lead)).select(
        *keep, key, lead, *[F.try_element_at(F.col(o), F.col(key)).alias(o) for o in others]
    )
