"""Agreement of two labelings, from their contingency counts.

Every index needs only sums of a function over the cell, row and column counts, so one contingency
aggregate and one grouping-sets aggregate over it are enough; rows are reduced before any shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.session import check_state


def confusion(df: DataFrame, a: str, b: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:
    """(keys, a, b, n): counts of every pair of labels that occurs; ``weight`` counts a row more than once."""
    return df.groupBy(*keys, a, b).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def _margins(df: DataFrame, a: str, b: str, keys: list[str], weight: str | None) -> DataFrame:
    cells = confusion(df, a, b, keys, weight).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"), "n")
    sets = [[*keys, "_a", "_b"], [*keys, "_a"], [*keys, "_b"], list(keys)]
    cols = [F.col(c) for c in (*keys, "_a", "_b")]
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.sum("n").cast("double").alias("m"), F.grouping("_a").alias("ga"), F.grouping("_b").alias("gb")
    )


def _sums(df: DataFrame, a: str, b: str, keys: list[str], f, weight: str | None = None) -> DataFrame:
    side = lambda ga, gb: (F.col("ga") == ga) & (F.col("gb") == gb)
    total = lambda ga, gb: F.sum(F.when(side(ga, gb), f(F.col("m"))))
    return _margins(df, a, b, keys, weight).groupBy(*keys).agg(
        total(0, 0).alias("sab"), total(0, 1).alias("sa"), total(1, 0).alias("sb"),
        F.max(F.when(side(1, 1), F.col("m"))).alias("N"),
    )


def mutual_information(df: DataFrame, a: str, b: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:
    """(keys, mi, nmi): nats, and normalised by the mean of the two entropies; 0 when both are constant."""
    s = _sums(df, a, b, keys, lambda m: m * F.log(m), weight)
    h = lambda c: F.log("N") - F.col(c) / F.col("N")
    mi = F.greatest(h("sa") + h("sb") - h("sab"), F.lit(0.0))
    both = h("sa") + h("sb")
    return s.select(*keys, mi.alias("mi"), F.when(both > 1e-12, 2 * mi / both).otherwise(0.0).alias("nmi"))


def rand_indices(df: DataFrame, a: str, b: str, keys: list[str] = []) -> DataFrame:
    """(keys, adjusted_rand, rand, mirkin, hubert); zeros when there are no pairs."""
    s = _sums(df, a, b, keys, lambda m: m * (m - 1) / 2)
    pairs: Column = F.col("N") * (F.col("N") - 1) / 2
    expected = F.col("sa") * F.col("sb") / pairs
    ceiling = (F.col("sa") + F.col("sb")) / 2
    agree = (pairs + 2 * F.col("sab") - F.col("sa") - F.col("sb")) / pairs
    flat = F.abs(ceiling - expected) < 1e-12
    some = pairs > 0
    return s.select(
        *keys,
        F.when(~some, 0.0).when(flat, 1.0).otherwise((F.col("sab") - expected) / (ceiling - expected)).alias("adjusted_rand"),
        F.when(some, agree).otherwise(0.0).alias("rand"),
        F.when(some, 1 - agree).otherwise(0.0).alias("mirkin"),
        F.when(some, 2 * agree - 1).otherwise(0.0).alias("hubert"),
    )


def accuracy(df: DataFrame, predicted: str, actual: str, keys: list[str] = []) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def matched_confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, col, n): columns ordered so that row by row the largest unused one comes next.

    The counts are made on executors; the greedy pass reads the label-sized table on the driver.
    """
    cells = confusion(df, a, b)
    shape = cells.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).first()
    check_state(shape["r"] * shape["c"], "matched confusion")
    table = cells.toPandas()
    rows, cols = sorted(table[a].unique()), sorted(table[b].unique())
    grid = np.zeros((len(rows), len(cols)), np.int64)
    grid[np.searchsorted(rows, table[a]), np.searchsorted(cols, table[b])] = table["n"]
    free, order = list(range(len(cols))), []
    for i in range(len(rows)):
        if free:
            order.append(free.pop(int(np.argmax(grid[i, free]))))
    order += free
    out = [(rows[i].item(), cols[j].item(), p + 1, int(grid[i, j])) for i in range(len(rows)) for p, j in enumerate(order)]
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.sparkSession.createDataFrame(out, f"`{a}` {kind[a]}, `{b}` {kind[b]}, col int, n bigint")


def export_assignments(df: DataFrame, run: str, label: str) -> DataFrame:
    """(run, id, cluster): the stored form of a clustering; rows without a label are left out."""
    return df.filter(F.col(label).isNotNull()).select(F.lit(run).alias("run_id"), "id", F.col(label).cast("int").alias("cluster"))
