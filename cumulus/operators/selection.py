"""Exact order statistics by radix selection: counting passes that narrow the range of every wanted rank.

The first pass counts, for every key and column, values by sign, exponent and the first binary digits of the mantissa;
each further pass counts the values inside the ranges that still hold a wanted rank, in equal parts of that range. A
part keeps its count, least and greatest value, so a rank is found when both are equal. After the first pass a range
lies within a power of two, and each pass fixes ``BINS`` more parts of it; a range of no more than ``BINS`` rows is
counted by value, which is final. Some five passes are the most that doubles can need and two are usual. All columns,
keys and ranks share the passes. No values are sorted, sketched or kept: map-side sums leave at most ``BINS`` rows for
each range, however many rows a key has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.session import materialise

#: Equal parts of a range in one pass; parts of a power of two in the first.
BINS, DIGITS = 4_096, 64
#: The first pass numbers parts from the middle: zero is 0, values above it from here on, infinities and NaN last.
_MIDDLE, _INFINITE, _NAN = 70_000, 190_000, 200_000


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys match; the optimiser picks the strategy."""
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def first_part(x: Column) -> Column:
    """A number that never falls when ``x`` grows: sign, exponent and first digits of the mantissa."""
    size = F.when(F.isnan(x), _NAN).when(F.abs(x) == float("inf"), _INFINITE).otherwise(_MIDDLE + F.floor(F.log2(F.abs(x)) * DIGITS))
    return F.when(x == 0, F.lit(0)).when(x < 0, -size).otherwise(size).cast("int")


def _ranks(probs: list[float]) -> list[tuple[Column, Column]]:
    """The ranks (from 0) below and above each quantile of ``_total`` values."""
    return [(F.floor((F.col("_total") - 1) * p), F.ceil((F.col("_total") - 1) * p)) for p in probs]


def _held(parts: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """The parts of each range that hold a wanted rank, with these ranks, and the parts of NULL values (without ranks)."""
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = F.array_distinct(F.array(*[rank for pair in _ranks(probs) for rank in pair]))
    mine = F.filter(wanted, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_n")))
    held = placed.withColumn("_ranks", mine).filter((F.size("_ranks") > 0) | F.col("_part").isNull())
    open_ = F.coalesce(F.col("_least") < F.col("_most"), F.lit(False))
    return held.select(*[c for c in by if c != "_in"], "_total", "_base", "_n", "_ranks", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), open_.alias("_open"))


def value_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, _x): the columns as one vector of doubles, written once for the passes that read it."""
    return materialise(df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")), "values")


def order_statistics(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """(keys, n_<c>, q_<c> for every column): numbers of non-NULL values and their exact, linearly interpolated quantiles.

    ``q_<c>`` is an array in the order of ``probs``, NULL for a key without values; NaN is above all other values. NULL
    keys are keys. The rows are written once; every pass reads that table.
    """
    return select_ranks(value_rows(df, keys, cols), keys, cols, probs)


def select_ranks(rows: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """:func:`order_statistics` of rows (keys, _x) that are cheap to read more than once."""
    count = [F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    single = rows.select(*keys, F.posexplode("_x").alias("_c", "_v"))
    first = single.groupBy(*keys, "_c", first_part(F.col("_v")).alias("_part")).agg(*count)
    by = [*keys, "_c"]
    total = F.sum("_n").over(Window.partitionBy(*by)).alias("_total")
    cuts = [materialise(_held(first.select("*", total, F.lit(0).cast("long").alias("_base")), by, probs), "selected")]
    while not (rest := cuts[-1].filter("_open")).isEmpty():
        ranges = rest.groupBy(*keys).agg(F.collect_list(F.struct("_c", "_lo", "_hi", "_n", "_base", "_total")).alias("_ranges"))
        # only values inside a range leave the row, tagged with it
        inside = F.filter("_ranges", lambda r: (F.get("_x", r["_c"]) >= r["_lo"]) & (F.get("_x", r["_c"]) <= r["_hi"]))
        near = join_keys(rows, ranges, keys).select(*keys, "_x", F.explode(inside).alias("_r"))
        near = near.select(*keys, F.get("_x", F.col("_r._c")).alias("_v"), "_r._c", "_r._total", "_r._base", F.col("_r._lo").alias("_in"), F.col("_r._hi").alias("_to"), F.col("_r._n").alias("_of"))
        equal = F.least(F.floor((F.col("_v") - F.col("_in")) / (F.col("_to") - F.col("_in")) * BINS), F.lit(BINS - 1)).cast("double")
        part = F.when(F.col("_of") <= BINS, F.col("_v")).otherwise(equal).alias("_part")
        counted = near.groupBy(*by, "_total", "_base", "_in", part).agg(*count)
        cuts.append(materialise(_held(counted, [*by, "_in"], probs), "selected"))
    found = reduce(DataFrame.unionByName, [c.filter("not _open") for c in cuts])

    pairs = F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r, F.col("_lo")))))
    held = found.groupBy(*by, "_total").agg(F.map_from_entries(pairs).alias("_at"))
    between = []
    for p, (low, high) in zip(probs, _ranks(probs), strict=True):
        at = (F.col("_total") - 1) * p
        lo, hi = F.element_at("_at", low), F.element_at("_at", high)
        between.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))
    each = held.select(*by, "_total", F.when(F.col("_total") > 0, F.array(*between)).alias("_q"))
    wide = each.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("_c") == i, F.col("_total"))), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(cols)],
        *[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(f"q_{c}") for i, c in enumerate(cols)],
    )
    return materialise(wide.select(*keys, *[f"{x}_{c}" for c in cols for x in "nq"]), "quantiles")
