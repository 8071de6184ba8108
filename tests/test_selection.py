import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix
from cumulus.operators import folds, selection
from cumulus.operators.selection import first_part, order_statistics

EDGES = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 0.1, 0.3]


def test_first_part_never_falls(spark):
    rng = np.random.default_rng(0)
    values = sorted([v for v in EDGES if not math.isnan(v)] + (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist())
    got = spark.createDataFrame([(float(v),) for v in [*values, math.nan]], "v double").select("v", first_part(F.col("v")).alias("p")).collect()
    parts = [r["p"] for r in sorted(got, key=lambda r: (math.isnan(r["v"]), r["v"]))]
    assert parts == sorted(parts)


def between(values, p):
    values, at = sorted(values), (len(values) - 1) * p
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))


def test_ranks_of_hard_values(spark, monkeypatch):
    """Powers of two, neighbours in the last digit, a hot value, infinities; two columns and a NULL key share the passes."""
    monkeypatch.setattr(selection, "BINS", 4)  # many passes
    rng = np.random.default_rng(1)
    columns = {
        "a": [2.0**k for k in range(-500, 500, 7)] + [1 + k * 2.0**-52 for k in range(150)] + [3.0] * 400,
        None: (rng.normal(size=301)).tolist() + [math.inf, -math.inf],
    }
    rows = [(g, float(v), int(i % 17)) for g, vs in columns.items() for i, v in enumerate(vs)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(4)
    probs = [0.0, 0.21, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in order_statistics(df, ["g"], ["v", "w"], probs).collect()}
    for g, vs in columns.items():
        assert got[g]["n_v"] == len(vs) and got[g]["q_v"] == pytest.approx([between(vs, p) for p in probs], rel=1e-15)
        assert got[g]["q_w"] == pytest.approx([between([i % 17 for i in range(len(vs))], p) for p in probs])
    assert got["none"]["n_v"] == 0 and got["none"]["q_v"] is None


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    assert order_statistics(df, [], ["v"], [0.5]).first()["q_v"] == [4.5]
    assert order_statistics(df.limit(0).withColumn("g", F.lit("x")), ["g"], ["v"], [0.5]).count() == 0


def test_folds_by_key(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 3)  # a vector of several blocks
    rng = np.random.default_rng(2)
    X, keys = rng.normal(size=(200, 8)), [None if i % 5 == 0 else f"k{i % 3}" for i in range(200)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, X)], "k string, x array<double>").repartition(5)

    def step(batch, codes, n):
        rows = matrix(batch.column("x"))
        return np.array([rows[own].min(0) for own in folds.by_code(codes, n)])

    got = {(r["k"], r["slot"]): r["value"] for r in folds.fold_keys(df, "k", step, "min").collect()}
    for k in set(keys):
        low = X[[i for i, own in enumerate(keys) if own == k]].min(0)
        assert [got[k, j] for j in range(8)] == low.tolist()
    assert len(got) == 8 * len(set(keys))
