import pytest

from cumulus.operators import agreement as G


def table(spark, pairs):
    return spark.createDataFrame(pairs, "a int, b int")


def test_equal_and_permuted(spark):
    df = table(spark, [(i % 3, (i + 1) % 3) for i in range(30)])
    assert G.mutual_information(df, "a", "b").first()["nmi"] == pytest.approx(1)
    r = G.rand_indices(df, "a", "b").first()
    assert (r["adjusted_rand"], r["rand"], r["mirkin"], r["hubert"]) == (1, 1, 0, 1)


def test_constant_labels(spark):
    df = table(spark, [(1, 1)] * 5)
    assert G.mutual_information(df, "a", "b").first()["nmi"] == 0
    assert G.rand_indices(df, "a", "b").first()["rand"] == 1
    assert G.rand_indices(table(spark, [(1, 1)]), "a", "b").first()["rand"] == 0


def test_symmetry_and_weight(spark):
    df = table(spark, [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 3)])
    ab, ba = (G.mutual_information(df, *c).first()["nmi"] for c in (("a", "b"), ("b", "a")))
    assert ab == pytest.approx(ba)
    counted = G.confusion(df, "a", "b")
    assert G.mutual_information(counted, "a", "b", weight="n").first()["nmi"] == pytest.approx(ab)


def test_matched_columns(spark):
    df = table(spark, [(1, 9)] * 3 + [(1, 7)] + [(2, 9)] * 5 + [(2, 7)] * 2 + [(2, 8)])
    rows = G.matched_confusion(df, "a", "b").collect()
    order = {r["col"]: r["b"] for r in rows}
    assert [order[i] for i in (1, 2, 3)] == [9, 7, 8]
    assert {(r["a"], r["b"]): r["n"] for r in rows}[2, 9] == 5
