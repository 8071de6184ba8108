import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.operators import classify as L
from cumulus.operators import gaussians as M
from cumulus.operators import kmeans as K
from cumulus.operators import mixtures as X


@pytest.fixture(scope="module")
def three():
    rng = np.random.default_rng(0)
    X_ = np.concatenate([rng.normal(c, s, (80, 2)) for c, s in (((0, 0), 0.5), ((5, 0), 0.7), ((0, 5), 0.3))])
    return X_, np.repeat([1, 2, 3], 80)


def test_moments_match_numpy(cloud, three):
    m = M.cluster_models(cloud(*three), "label")
    for i in range(3):
        mine = three[0][three[1] == i + 1]
        assert np.allclose(m.mu[i], mine.mean(0)) and np.allclose(m.cov[i], np.cov(mine.T, bias=True))


def test_far_from_the_origin(cloud, three):
    m = M.cluster_models(cloud(three[0] + 1e7, three[1]), "label")
    assert np.allclose(m.cov[0], np.cov(three[0][:80].T, bias=True), rtol=1e-6)


def test_singular_covariance(cloud):
    pts = cloud([[1, 1]] * 4 + [[0, 3], [2, 5], [3, 1]], [1] * 4 + [2] * 3)
    m = M.cluster_models(pts, "label")
    assert np.isinf(m.entropy()[0]) and np.isfinite(m.entropy()[1])
    assert {r["comp"] for r in M.assign_models(pts, m).filter("label = 1").collect()} == {1}
    assert len(M.construct_models(pts, "label")) == 1


def test_entropy_value():
    m = M.Gaussians(np.array([1]), np.array([5]), np.zeros((1, 2)), np.eye(2)[None])
    assert m.entropy()[0] == pytest.approx((2 * np.log(2 * np.pi) + 1) / 2)


def test_slices_agree_with_one_pass(cloud, three):
    pts = cloud(*three)
    m = M.cluster_models(pts, "label")
    whole = {r["id"]: r["comp"] for r in M.assign_models(pts, m).collect()}
    parts = {r["id"]: r["comp"] for r in M.assign_models(pts, [m.take(np.array([0])), m.take(np.array([1, 2]))]).collect()}
    assert whole == parts


def test_model_table_round_trip(spark, cloud, three):
    m = M.cluster_models(cloud(*three), "label")
    back = M.Gaussians.from_table(m.to_table(spark))
    assert np.allclose(back.cov, m.cov) and np.array_equal(back.ids, m.ids)


def test_kmeans_shares_scans(cloud, three):
    pts = cloud(*three)
    fits = K.kmeans_grid(pts, [2, 3, 4], [0, 1])
    single = K.kmeans(pts, 3, seed=1)
    twin = next(f for f in fits if f.run_id == "k3-s1")
    assert np.allclose(twin.centers, single.centers) and twin.cost == pytest.approx(single.cost)
    D = ((three[0][:, None] - single.centers) ** 2).sum(2).min(1).sum()
    assert single.cost == pytest.approx(D)
    best = K.best_over_k(pts, 1)
    assert best.k == 4
    assert K.best_by_agreement(pts, "label", fits).k == 3
    assert K.best_of_restarts(pts, 3, 2, keep="worst").cost >= K.best_of_restarts(pts, 3, 2).cost


def test_kmeans_with_a_share_of_the_rows(cloud, three):
    pts = cloud(*three)
    fit = K.kmeans(pts, 12, seed=4, rounds=2, tol=-1.0)
    want = {r["id"]: r["cluster"] for r in K.assign_centers(pts, fit).collect()}
    got = {r["id"]: r["cluster"] for r in K.kmeans_share(pts, 0.05, seed=4, rounds=2).collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["full", "diag", "spherical"])
def test_mixture_likelihood_never_falls(cloud, three, kind):
    fit = X.gaussian_mixture(cloud(*three), 3, kind, tol=1e-6, max_iter=15)
    assert all(b >= a - 1e-9 for a, b in zip(fit.trace, fit.trace[1:]))
    centers = fit.models.mu[np.argsort(fit.models.mu.sum(1))]
    assert np.allclose(sorted(centers.sum(1)), [0, 5, 5], atol=0.4)


def test_factor_analysers(cloud, three):
    fit = X.factor_analysers(cloud(*three), 3, 1, tol=1e-7, max_iter=10)
    assert all(b >= a - 1e-6 for a, b in zip(fit.trace, fit.trace[1:]))


@pytest.mark.parametrize("kind", ["diag", "full", "spherical"])
def test_dirichlet_mixture_drops_components(cloud, three, kind):
    pts = cloud(*three)
    fit = X.dirichlet_mixture(pts, 8, 0.01, kind, seed=1, tol=1e-6, max_iter=60)
    assert (fit.models.weight > 0.02).sum() <= 5
    again = X.dirichlet_mixture(pts.repartition(1), 8, 0.01, kind, seed=1, tol=1e-6, max_iter=3)
    assert np.allclose(again.trace, X.dirichlet_mixture(pts, 8, 0.01, kind, seed=1, tol=1e-6, max_iter=3).trace)


def test_digamma():
    assert np.allclose(X.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721])


def test_bayes_uses_the_prior(cloud):
    pts = cloud([[-1], [1], [-1.2], [1.2]] * 10 + [[1.9], [3.9], [2.1], [4.1]], [1] * 40 + [2] * 4)
    models = L.bayes_fit(pts, "label")
    at = cloud([[1.65]])
    assert L.likelihood_predict(at, models).first()["pred"] == 2
    assert L.bayes_predict(at, models).first()["pred"] == 1


def test_meta_skips_empty_mixtures(cloud, three):
    pts = cloud(*three)
    models = M.cluster_models(pts, "label")
    models.n = np.array([80, 0, 80])
    got = {r["pred"] for r in L.meta_predict(pts, models, [[1], [2], [3]]).select("pred").distinct().collect()}
    assert got == {1, 3}
    joined = L.meta_predict(pts, M.cluster_models(pts, "label"), [[1, 2], [3]]).groupBy("pred").count().collect()
    assert {r["pred"]: r["count"] for r in joined}[2] == pytest.approx(80, abs=3)


def test_outliers_take_the_nearest_model(cloud, three):
    pts = cloud(*three)
    models = M.cluster_models(pts, "label")
    some = pts.withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    got = M.reassign_outliers(some, "label", models).select("id", "label").collect()
    assert sum(r["label"] == three[1][r["id"]] for r in got) >= 238


def test_steps_get_few_rows_however_large_the_batch(cloud, spark, monkeypatch):
    from cumulus.operators import folds
    from cumulus.functions.vectors import matrix

    monkeypatch.setattr(folds, "ROWS", 50)
    monkeypatch.setattr(folds, "PACK", 20)
    X = np.random.default_rng(5).normal(size=(700, 3))
    pts = cloud(X)
    blocks = folds.packed(pts)
    step = lambda b: (lambda x: np.array([len(x), (x > 0).sum()]))(matrix(b.column("x")))
    most = lambda b: np.array([len(matrix(b.column("x")))])
    for rows in (pts.select("x"), blocks):
        assert folds.fold(rows, step, (2,)).tolist() == [700, (X > 0).sum()]
        assert folds.fold(rows, most, (1,), "max")[0] <= 50
    assert blocks.count() < 100
