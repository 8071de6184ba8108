import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.operators import ordering as W
from cumulus.operators import reshape as R
from cumulus.operators import summary as A
from cumulus.operators.spread import _chi2_tail, fligner_killeen, normal_quantile


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, copies, NULLs, a group of one and a group of NULLs."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 400)] + [("b", float(v)) for v in rng.normal(size=301)]
    rows += [("one", 4.0), ("none", None), ("none", None), ("b", None), (None, 1.0), (None, 2.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


def test_quantiles_are_exact(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in A.quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    for g in ("hot", "b", "one", None):
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g]["n"] == len(values)
        assert np.allclose(got[g]["q"], np.quantile(values, [0.25, 0.5, 0.9]))
    assert got["none"]["n"] == 0


def test_median_mad(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in A.median_mad(df, ["g"], ["v"]).collect()}
    values = [v for k, v in rows if k == "hot"]
    m = statistics.median(values)
    assert got["hot"]["v_med"] == m
    assert got["hot"]["v_mad"] == statistics.median(abs(v - m) for v in values)
    assert got["one"]["v_mad"] == 0


def test_average_ranks(skewed):
    rows, df = skewed
    got = {r["v"]: r for r in A.value_ranks(df.filter("g = 'hot'"), ["g"], "v").collect()}
    values = sorted(v for k, v in rows if k == "hot")
    for v in set(values):
        at = [i + 1 for i, x in enumerate(values) if x == v]
        assert got[v]["ties"] == len(at) and got[v]["rank"] == sum(at) / len(at)


def test_number_rows(skewed):
    rows, df = skewed
    got = W.number_rows(df.filter("v is not null"), ["g"], ["v"], "n").collect()
    for g in ("hot", "b"):
        mine = sorted((r["n"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_success_summary(spark):
    rows = [("a", 0.5, 10), ("a", None, 0), ("a", 0.7, 30), ("z", None, 0), ("z", None, 0)]
    got = {r["m"]: r for r in A.success_summary(spark.createDataFrame(rows, "m string, s double, c int"), ["m"], "s", "c").collect()}
    assert (got["a"]["successes"], got["a"]["total"]) == (2, 3)
    assert got["a"]["score_med"] == pytest.approx(0.6) and got["a"]["cells_med"] == 10
    assert (got["z"]["successes"], got["z"]["score_med"], got["z"]["cells_med"], got["z"]["cells_mad"]) == (0, 0, 0, 0)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.075, 0.3, 0.5, 0.9, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile("p").alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)


def test_chi2_tail():
    assert _chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert _chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert _chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert _chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_spread_test_tells_spread(spark):
    rng = np.random.default_rng(3)
    rows = [("same", g, float(v)) for g in (0, 1) for v in rng.normal(size=200)]
    rows += [("wide", g, float(v * (1 + 2 * g))) for g in (0, 1) for v in rng.normal(size=200)]
    got = {r["t"]: r for r in fligner_killeen(spark.createDataFrame(rows, "t string, g int, v double"), ["t"], "g", "v").collect()}
    assert got["wide"]["reject"] and not got["same"]["reject"] and got["wide"]["df"] == 1


def test_stratified_sample(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).cast("int").alias("label"))
    a = W.stratified_sample(df, "label", 20, 5, offset=1).collect()
    b = W.stratified_sample(df.repartition(7), "label", 20, 5, offset=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 60 and {r["label"] for r in a} == {1, 2, 3} and all(r["id"] % 3 + 1 == r["label"] for r in a)


def test_best_run_breaks_ties(spark):
    df = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("k", "c", 2.0)], "k string, run_id string, cost double")
    assert W.best_run(df, ["k"], "cost").first()["run_id"] == "a"
    assert W.best_run(df, ["k"], "cost", lowest=False).first()["run_id"] == "c"


def test_grid_resume(spark):
    grid = R.parameter_grid(spark, a=[1, 2], b=["x", "y"])
    assert grid.count() == 4
    assert R.unfinished(grid, spark.createDataFrame([(1, "x")], "a int, b string"), ["a", "b"]).count() == 3
