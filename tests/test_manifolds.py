import math

import numpy as np
import pytest

from cumulus.operators import covers as O
from cumulus.operators import description as B
from cumulus.operators import manifolds as L
from cumulus.operators import mixtures as X
from cumulus.operators import projected as R
from cumulus.plans.registry import QUERIES
from cumulus.plans.topology import lots


@pytest.fixture(scope="module")
def two_lines():
    """Two separate line segments in space."""
    rng = np.random.default_rng(0)
    t = rng.uniform(-3, 3, 300)
    a = np.stack([t[:150], 0 * t[:150], 0 * t[:150]], 1)
    b = np.stack([0 * t[150:], t[150:], 0 * t[150:] + 8], 1)
    X = np.concatenate([a, b]) + rng.normal(0, 0.02, (300, 3))
    return X, np.repeat([1, 2], 150)


def test_manifold_clusters_find_the_lines(cloud, two_lines):
    pts = cloud(*two_lines)
    found = L.manifold_clusters(pts, 1, clusters=4, best_bound=1.0, min_size=20, candidates=40, seed=2)
    rows = found.assign(pts).collect()
    assert len(rows) == 300
    for y in (1, 2):
        names = [r["cluster"] for r in rows if r["label"] == y]
        top = max(set(names), key=names.count)
        assert names.count(top) >= 140
        assert sum(r["cluster"] == top for r in rows if r["label"] != y) <= 10
    again = L.manifold_clusters(pts.repartition(1), 1, clusters=4, best_bound=1.0, min_size=20, candidates=40, seed=2)
    assert len(again.manifolds) == len(found.manifolds)


def test_more_manifolds_than_expected(cloud):
    rng = np.random.default_rng(1)
    t, y = rng.uniform(-3, 3, 600), np.repeat([1, 2, 3, 4], 150)
    X = rng.normal(0, 0.02, (600, 3))
    X[np.arange(600), (y - 1) % 2] += t
    X[:, 2] += 8 * y
    pts = cloud(X, y)
    found = L.manifold_clusters(pts, 1, clusters=2, best_bound=1.0, min_size=20, candidates=40, seed=2)
    rows = found.assign(pts).collect()
    assert len(found.manifolds) >= 4 and sum(r["cluster"] == 0 for r in rows) < 20
    tops = []
    for line in (1, 2, 3, 4):
        names = [r["cluster"] for r in rows if r["label"] == line and r["cluster"]]
        tops.append(max(set(names), key=names.count))
    assert len(set(tops)) == 4


def test_whole_sample_is_tried_in_slices(cloud, two_lines, monkeypatch):
    tried, plain = [], L._best_split

    def counted(base, found, conds, tries, bins):
        tried.append(len(tries))
        return plain(base, found, conds, tries, bins)

    monkeypatch.setattr(L, "_best_split", counted)
    L.manifold_clusters(cloud(*two_lines), 1, best_bound=1e9, heuristic=2, factor=0.1, candidates=40)
    assert tried == [40, 20]


def test_separation_threshold_lies_in_the_gap():
    counts = np.zeros(50)
    counts[2:8], counts[30:40] = 20, 15
    t, good = L.separation(counts, 0.1)
    assert 0.75 <= t <= 3.1 and good > 1
    assert L.separation(np.array([5.0]), 1.0)[1] == 0


def test_acceptance_sends_rows_to_noise(cloud, two_lines):
    pts = cloud(*two_lines)
    found = L.manifold_clusters(pts, 1, clusters=2, best_bound=1.0, candidates=40, seed=2, accept=B.description_accepts(1e9, 0.01))
    assert not found.manifolds and found.assign(pts).filter("cluster <> 0").isEmpty()


def test_split_keeps_every_row(cloud, two_lines):
    pts = cloud(*two_lines)
    found = L.manifold_clusters(pts, 1, clusters=1, best_bound=1e9)
    out = L.split_defective(pts, found, threshold=1.0, min_size=40, clusters=3, best_bound=1.0, candidates=40, seed=2)
    assert out.count() == 300 and out.select("cluster").distinct().count() >= 2


def test_description_length_by_hand(cloud):
    pts = cloud([[0.05, 0.0], [0.05, 0.31], [0.95, 0.31], [0.95, 0.9]], [7] * 4)
    forms = L.ManifoldForms(np.array([7]), np.array([4]), np.zeros((1, 2)), np.eye(2)[None], np.array([1]))
    out = {(r["eps"], r["d"]): r["bits"] for r in B.description_bits(pts, "label", forms, 24, 16, [0.1, 0.5], [0, 1, -1]).collect()}
    h1, h2 = 1.0, 1.5  # bins of width 0.2: {0.05 x2, 0.95 x2}; {0.0, 0.31 x2, 0.9}
    assert out[0.1, 0] == pytest.approx(24 * 2 + 4 * (h1 + h2))
    assert out[0.1, 1] == pytest.approx(24 * (2 + 2 - 1) + 16 * 4 + 4 * h2)
    assert out[0.1, -1] == out[0.1, 1] and out[0.5, 0] == pytest.approx(24 * 2)
    ratio = B.compression(pts, "label", forms, "x", 24, 16, [0.1], [0]).first()["ratio"]
    assert ratio == pytest.approx(32 * 8 / (48 + 10))
    with pytest.raises(ValueError):
        B.axis_entropies(pts, "label", forms, [0.1, 0.15])


def test_projected_clusters(cloud, two_lines):
    pts = cloud(*two_lines)
    fit = R.projected_clusters(pts, 2, 2, 6, seed=1)
    rows = R.assign_projected(pts, fit).collect()
    match = sum(r["cluster"] == r["label"] for r in rows)
    assert max(match, 300 - match) >= 290 and fit.axes[0].shape == (3, 2)


def test_reduction(cloud, two_lines):
    X, y = two_lines
    pts = cloud(X, y)
    red = R.fit_reduction(pts, 2)
    out = np.array([r["x"] for r in R.reduce_points(pts, red).orderBy("id").collect()])
    values = np.linalg.eigvalsh(np.cov(X.T, bias=True))[::-1]
    assert np.allclose(out.var(0), values[:2]) and np.allclose(red.variance, values[:2])


def test_manifold_cover_drops_wide_models(cloud, two_lines):
    pts = cloud(*two_lines)
    cover = O.manifold_cover(pts, 4, seed=2, entropy_bound=3.0, search={"best_bound": 1.0, "candidates": 40})
    assert len(cover.models) >= 2 and cover.models.n.sum() == 300 and (cover.models.entropy() <= 3).all()
    with pytest.raises(ValueError):
        O.manifold_cover(pts, 4, seed=2, entropy_bound=-1e9, search={"best_bound": 1.0, "candidates": 40})


def test_factor_cover_is_fitted_until_it_settles(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i // 7, i % 7 + 1, float(rng.integers(1, 51)), float(rng.uniform(900, 90000)), float(rng.integers(0, 11)) / 100, "ANR"[i % 3]) for i in range(420)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    pts = lots(spark, str(tmp_path))
    whole = X.factor_analysers(pts, 8, 1, 3, 1e-3, 1000)
    assert len(whole.trace) > 6 and whole.trace[-1] - whole.trace[-2] < 1e-3
    got = {r["comp"]: r["n"] for r in QUERIES["cover_factors"](spark, str(tmp_path)).collect()}
    sizes = lambda fit: {int(i): int(n) for i, n in zip(fit.models.ids, O._pruned(pts, fit.models, 1, True).n)}
    assert got == sizes(whole) != sizes(X.factor_analysers(pts, 8, 1, 3, 1e-3, 6))


def test_sample_sizes():
    assert L.sample_size(1, 0.1, 10, 1, 1000) == math.ceil(math.log(0.01) / math.log(0.9))
    assert L.sample_size(2, 0.1, 10, 1, 1000) == 100 and L.sample_size(3, 0.001, 10, 1, 1000) == 1
