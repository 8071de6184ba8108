"""Fligner-Killeen test of equal spread (Conover, Johnson & Johnson 1981)."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.operators.summary import join_keys, medians, running_totals
from cumulus.session import materialise

# Rational approximation of the normal quantile (Wichura 1988, algorithm AS 241),
# coefficients from the constant term up, numerator then denominator for each of three ranges.
CENTRE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
NEAR_TAIL = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9],
)
FAR_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _ratio(coefficients, r: Column) -> Column:
    """Quotient of two polynomials in Horner form."""
    top, bottom = (reduce(lambda total, c: total * r + F.lit(c), reversed(part[:-1]), F.lit(part[-1])) for part in coefficients)
    return top / bottom


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the standard normal distribution function."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(tail <= 5, _ratio(NEAR_TAIL, tail - 1.6)).otherwise(_ratio(FAR_TAIL, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * far)


def _chi2_tail(x: float, df: int) -> float:
    if x is None or df is None or df < 1 or not x > 0:
        return 1.0
    half, odd = x / 2, df % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    a = 0.5 if odd else 0.0
    while a < df / 2:
        total += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(total, 1.0)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution; one row per test."""
    return pd.Series([_chi2_tail(a, int(b)) for a, b in zip(x, df)])


def fligner_killeen(df: DataFrame, tests: list[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(tests, chi2, df, p_value, reject): one test per key, groups compared within it.

    Ranks are taken within the test only, over distinct deviations with their counts.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*tests, group, value)
    centre = medians(rows, [*tests, group], [value])
    dev = join_keys(rows, centre, [*tests, group]).select(*tests, group, F.abs(F.col(value) - F.col(f"{value}_med")).alias("dev"))
    # every later step works on distinct deviations with their counts
    counts = materialise(dev.groupBy(*tests, group, "dev").agg(F.count("*").alias("c")), "deviations")
    ties = materialise(counts.groupBy(*tests, "dev").agg(F.sum("c").alias("ties")), "ties")
    ranks = running_totals(ties, tests, "dev", ["ties"]).select(
        *tests, "dev", (F.col("run_ties") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank")
    )
    sizes = counts.groupBy(*tests).agg(F.sum("c").alias("N"))
    scored = join_keys(join_keys(counts, ranks, [*tests, "dev"]), sizes, tests).withColumn(
        "a", normal_quantile(0.5 + F.col("rank") / (2 * (F.col("N") + 1)))
    )
    per_group = scored.groupBy(*tests, group).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("a")).alias("sa"), F.sum(F.col("c") * F.col("a") * F.col("a")).alias("saa")
    )
    per_test = per_group.groupBy(*tests).agg(
        F.sum("n").alias("N"), F.sum("sa").alias("S"), F.sum("saa").alias("Q"),
        F.sum(F.col("sa") * F.col("sa") / F.col("n")).alias("between"), (F.count("*") - 1).cast("int").alias("df"),
    )
    excess = F.col("between") - F.col("S") * F.col("S") / F.col("N")
    variance = (F.col("Q") - F.col("S") * F.col("S") / F.col("N")) / (F.col("N") - 1)
    stat = per_test.select(*tests, F.when(variance > 0, excess / variance).otherwise(0.0).alias("chi2"), "df")
    return stat.withColumn("p_value", chi2_tail("chi2", "df")).withColumn("reject", F.col("p_value") < alpha)
