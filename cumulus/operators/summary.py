"""Grouped summaries that stay exact when one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.operators.selection import join_keys, order_statistics, select_ranks, value_rows
from cumulus.session import materialise


def whole_key(keys: list[str]) -> Column:
    """The keys as one struct: never NULL itself, so a plain equi-join keeps the partitioning of a window on it."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def running_totals(df: DataFrame, keys: list[str], by: str, sums: list[str]) -> DataFrame:
    """Adds ``run_<c>``, the inclusive running sum of each ``c`` by ``by`` within ``keys``.

    Rows, one per (keys, by), are range-partitioned and written once, so a hot key is ordered by many tasks: each range
    adds the totals of the ranges of its key before it.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], F.col(by)).withColumn("_range", F.spark_partition_id())
    tagged = materialise(ranged, "ranges").withColumn("_k", whole_key(keys))
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy("_k", "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select("_k", "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy("_k", "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    return local.join(offsets, ["_k", "_range"]).select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"run_{c}") for c in sums]
    )


def value_ranks(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, col, ties, below, rank): distinct non-NULL values, rows below, average rank."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("ties"))
    below = F.col("run_ties") - F.col("ties")
    ranked = running_totals(counts, keys, col, ["ties"])
    return ranked.select(*keys, col, "ties", below.alias("below"), (below + (F.col("ties") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float]) -> DataFrame:
    """(keys, n, q): exact, linearly interpolated quantiles of the non-NULL values, q as an array."""
    return order_statistics(df, keys, [col], probs).select(*keys, F.col(f"n_{col}").alias("n"), F.col(f"q_{col}").alias("q"))


def medians(df: DataFrame, keys: list[str], cols: list[str], suffix: str = "_med") -> DataFrame:
    """Exact medians; an even count gives the mean of the middle two."""
    out = order_statistics(df, keys, cols, [0.5])
    return out.select(*keys, *[F.element_at(f"q_{c}", 1).alias(f"{c}{suffix}") for c in cols])


def median_mad(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``<c>_med`` and the unscaled median absolute deviation ``<c>_mad`` of every column; the rows are written once for both."""
    rows = value_rows(df, keys, cols)
    medians_of = lambda rows, suffix: select_ranks(rows, keys, cols, [0.5]).select(*keys, *[F.element_at(f"q_{c}", 1).alias(f"{c}{suffix}") for c in cols])
    centre = medians_of(rows, "_med")
    middle = centre.select(*keys, F.array(*[f"{c}_med" for c in cols]).alias("_mid"))
    apart = F.zip_with("_x", "_mid", lambda v, m: F.abs(v - m)).alias("_x")
    return join_keys(centre, medians_of(join_keys(rows, middle, keys).select(*keys, apart), "_mad"), keys)


def mean_std(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    )


def extrema(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a for c in cols for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def success_summary(df: DataFrame, keys: list[str], score: str, cells: str) -> DataFrame:
    """Success count, total and percent, score median/MAD, and cell median/MAD.

    A statistic over no values is 0; cells are summarised only where the score median is not 0.
    """
    counts = df.groupBy(*keys).agg(F.count(score).alias("successes"), F.count("*").alias("total"))
    stats = median_mad(df, keys, [score, cells])
    gate = F.coalesce(F.col(f"{score}_med"), F.lit(0.0)) == 0
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return join_keys(counts, stats, keys).select(
        *keys,
        "successes",
        "total",
        (100.0 * F.col("successes") / F.col("total")).alias("success_pct"),
        zero(f"{score}_med").alias("score_med"),
        zero(f"{score}_mad").alias("score_mad"),
        F.when(gate, 0.0).otherwise(zero(f"{cells}_med")).alias("cells_med"),
        F.when(gate, 0.0).otherwise(zero(f"{cells}_mad")).alias("cells_mad"),
    )


def ceiling(df: DataFrame, value: str, error: str, digits: int = 0) -> DataFrame:
    """Largest value + error over a summary table, rounded up: the upper axis limit of a plot."""
    unit = 10.0**digits
    top = F.max(F.col(value) + F.col(error))
    return df.agg((F.ceil(top * unit) / unit).alias("ceiling"))


def distinct_clusters(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct labels per group: labels are reduced per (group, label) first, so no group meets in one task."""
    return df.select(*keys, label).distinct().groupBy(*keys).agg(F.count(label).alias("clusters"))


def median_difference(df: DataFrame, keys: list[str], mode: str, value: str, modes: tuple) -> DataFrame:
    """Difference of the medians of two modes, with the error sqrt(e1^2 + e2^2)."""
    stats = median_mad(df, [*keys, mode], [value])
    first, last = modes
    side = lambda m, c: F.max(F.when(F.col(mode) == F.lit(m), F.col(c)))
    wide = stats.groupBy(*keys).agg(
        side(first, f"{value}_med").alias("_m0"), side(last, f"{value}_med").alias("_m1"),
        side(first, f"{value}_mad").alias("_e0"), side(last, f"{value}_mad").alias("_e1"),
    )
    return wide.select(*keys, (F.col("_m1") - F.col("_m0")).alias("median_diff"), F.hypot("_e0", "_e1").alias("error"))


def box_summary(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Quartiles, the most distant values within 1.5 IQR of the box, and the count beyond them."""
    boxes = quantiles(df, keys, col, [0.25, 0.5, 0.75]).select(
        *keys, "n", *[F.element_at("q", i).alias(name) for i, name in ((1, "q1"), (2, "med"), (3, "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(col) >= F.col("q1") - reach) & (F.col(col) <= F.col("q3") + reach)
    ends = join_keys(df.select(*keys, col), boxes, keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )
    return join_keys(boxes, ends, keys)


def histogram(df: DataFrame, keys: list[str], col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per group and equal-width bin; bins 0 and ``bins`` + 1 hold the values outside [lo, hi)."""
    bin_no = F.expr(f"width_bucket(cast(`{col}` as double), {float(lo)}D, {float(hi)}D, {int(bins)})")
    return df.filter(F.col(col).isNotNull()).groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("n"))


def fenced_statistic(stat: Column) -> Column:
    """A statistic over the non-NULL values, 0 where there are none."""
    return F.coalesce(stat, F.lit(0.0))


def cache_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write an intermediate result table once and report from the written copy."""
    if path is None:
        return materialise(df, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
