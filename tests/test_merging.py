import itertools
import math

import numpy as np
import pytest

from cumulus.operators import covers as O
from cumulus.operators import gaussians as M
from cumulus.operators import merging as H


@pytest.fixture(scope="module")
def pairs_of_blobs():
    """Four blobs, two by two close together."""
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in ((0, 0), (2, 0), (20, 0), (22, 0))])
    return X, np.repeat([1, 2, 3, 4], 60)


@pytest.mark.parametrize("rule", ["topological", "description", "bottleneck"])
def test_close_blobs_merge_first(cloud, pairs_of_blobs, rule):
    pts = cloud(*pairs_of_blobs)
    cover = O.build(pts, M.cluster_models(pts, "label"))
    opts = {"beta": 1.0} if rule != "topological" else {}
    merges = H.merges_by(rule, pts, cover.models, cover.edges, **opts)
    assert len(merges) == 3
    assert {tuple(sorted(m[:2])) for m in merges[:2]} == {(1, 2), (3, 4)}
    levels = H.levels_of([1, 2, 3, 4], merges)
    assert [len(l) for l in levels] == [4, 3, 2, 1] and levels[2] == [[1, 2], [3, 4]]


@pytest.mark.parametrize("hard", [True, False])
def test_bottleneck_costs(cloud, pairs_of_blobs, hard):
    X, y = pairs_of_blobs
    pts = cloud(X, y)
    models = M.cluster_models(pts, "label")
    merges = H.bottleneck_merges(pts, models, beta=0.5, hard=hard)
    joint = 0.5 * (models.log_density(X) + np.log(models.weight))
    R = (joint == joint.max(1, keepdims=True)).astype(float) if hard else np.exp(joint - joint.max(1, keepdims=True))
    R /= R.sum(1, keepdims=True)
    groups = {i + 1: R[:, i] for i in range(4)}

    def cost(a, b):
        n = len(X)
        pa, pb = a.sum() / n, b.sum() / n
        mix = (a + b) / (a + b).sum()
        kl = lambda p, q: sum(v * math.log(v / w) for v, w in zip(p, q) if v > 0)
        return pa * kl(a / a.sum(), mix) + pb * kl(b / b.sum(), mix)

    for a, b, c in merges:
        best = min(cost(groups[i], groups[j]) for i, j in itertools.combinations(sorted(groups), 2))
        assert c == pytest.approx(best, abs=1e-9) and c == pytest.approx(cost(groups[a], groups[b]), abs=1e-9)
        groups[a] = groups[a] + groups.pop(b)


def test_multinomial_complexity():
    def brute(k, n):
        return sum(
            math.factorial(n) / math.prod(math.factorial(h) for h in hs) * math.prod((h / n) ** h for h in hs)
            for hs in itertools.product(range(n + 1), repeat=k) if sum(hs) == n
        )

    for k, n in ((2, 5), (3, 6), (4, 4)):
        assert H.multinomial_complexity(k, n) == pytest.approx(math.log(brute(k, n)))
    assert H.multinomial_complexity(2, 1001) == pytest.approx(H.multinomial_complexity(2, 1000), abs=1e-2)
    assert H.multinomial_complexity(1, 50) == 0


def scores(spark, values):
    return spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run_id string, level int, score double")


@pytest.mark.parametrize("values,level", [
    ([9, 5, 6, 2, 7, 8], 3),          # one global minimum, also the lowest dip
    ([1, 5, 4, 6, 0], 2),             # the ends do not count
    ([9, 3, 5, 3.0005, 3, 3, 9], 5),  # a flat stretch at the minimum: its last level
    ([4, 4, 4], 2),                   # no dip at all
])
def test_choose_level(spark, values, level):
    assert H.choose_level(scores(spark, values)).first()["level"] == level


def test_level_scores(cloud, pairs_of_blobs):
    X, y = pairs_of_blobs
    pts = cloud(X, y)
    models = M.cluster_models(pts, "label")
    out = H.level_scores(pts, models, [[[1], [2], [3], [4]], [[1, 2, 3, 4]]]).orderBy("level").collect()
    logs = models.log_density(X)
    assert out[0]["nll"] == pytest.approx(-logs.max(1).sum())
    assert out[1]["nll"] == pytest.approx(-np.log(np.exp(logs).mean(1)).sum())
    assert all(r["score"] == pytest.approx(r["nll"] + r["complexity"]) for r in out)


def test_whole_flow_finds_the_pairs(spark, cloud, pairs_of_blobs):
    X, y = pairs_of_blobs
    pts = cloud(X, (y + 1) // 2)
    out = H.metacluster(pts, O.kmeans_cover(pts, 6, 1, restarts=2), "topological")
    assert out["agreement"].filter(f"level = {out['best_level']}").first()["nmi"] == pytest.approx(1.0)
    assert len(out["levels"][out["best_level"]]) == 2
    assert out["assigned"].select("cluster").distinct().count() == len(out["levels"][out["level"]])


def test_unknown_names(cloud):
    with pytest.raises(ValueError):
        O.cover(cloud([[0.0, 0.0]]), "other", 2, 2)
    with pytest.raises(ValueError):
        H.merges_by("other", None, None, None)
