import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.functions.vectors import close_pairs
from cumulus.operators import density as D
from cumulus.operators import neighbors as N
from cumulus.operators import pivot_tree
from cumulus.operators.components import connected_components


def clumped(d, n=240, seed=0):
    """A third of the rows are copies of one point; the rest are scattered."""
    rng = np.random.default_rng(seed)
    X = (100 * rng.normal(size=(n, d))).round()  # whole numbers: ties are exact
    X[: n // 3] = X[0]
    return X[rng.permutation(n)]


def brute(X):
    return np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))


@pytest.mark.parametrize("d,self_", [(2, True), (2, False), (12, True)])
def test_knn_matches_brute_force(cloud, monkeypatch, d, self_):
    monkeypatch.setattr(pivot_tree, "LEAF", 20)  # several levels
    X = clumped(d)
    D_ = brute(X)
    pts = cloud(X)
    got = {}
    for r in N.knn_join(pts, pts, 5, exclude_self=self_, block=16).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["dist"]))
    assert len(got) == len(X)
    for i in range(len(X)):
        order = sorted((round(D_[i, j], 9), j) for j in range(len(X)) if not (self_ and j == i))[:5]
        mine = sorted(got[i])
        assert [j for _, j, _ in mine] == [j for _, j in order]
        assert np.allclose([v for _, _, v in mine], [v for v, _ in order], atol=1e-8)


@pytest.mark.parametrize("d,radius", [(1, 30), (2, 40), (5, 120)])
def test_pairs_match_brute_force(cloud, monkeypatch, d, radius):
    monkeypatch.setattr(N, "BLOCK", 40)
    X = clumped(d, 150)
    D_ = brute(X)
    want = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if D_[i, j] <= radius}
    got = [(r["a"], r["b"]) for r in N.pairs_within(cloud(X), radius, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaves_read_do_not_grow_with_the_rows(cloud, monkeypatch):
    """Rows on a surface in 64 dimensions: a query is sent to about as many leaves at any size."""
    monkeypatch.setattr(pivot_tree, "LEAF", 32)
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.normal(size=(64, 2)))[0]
    asked, shuffled = [], pivot_tree.Tree.within
    monkeypatch.setattr(pivot_tree.Tree, "within", lambda self, df: asked.append(shuffled(self, df)) or asked[-1])
    per_row = []
    for n in (300, 1_200, 4_800):
        X = rng.uniform(size=(n, 2)) @ axes.T
        pts = cloud(X, parts=4)
        got = {(r["id"], r["rank"]): r["neighbor"] for r in N.knn_join(pts, pts, 3, exclude_self=True).collect()}
        D_ = brute(X[:300])
        if n == 300:
            np.fill_diagonal(D_, np.inf)
            assert all(got[i, 1] == D_[i].argmin() for i in range(n))
        per_row.append(asked[-1].count() / n)
    assert per_row[2] < 2 * per_row[0] and per_row[2] < 12, per_row


def test_nearest_label(cloud):
    train = cloud([[0, 0], [5, 5]], [1, 2])
    got = {r["id"]: r["pred"] for r in N.nearest_label(cloud([[0, 1], [5, 4], [1, 0]]), train, "label").collect()}
    assert got == {0: 1, 1: 2, 2: 1}


def test_too_few_rows(cloud):
    with pytest.raises(ValueError):
        N.knn_join(cloud([[0.0], [1.0]]), cloud([[0.0], [1.0]]), 2, exclude_self=True)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 50, (60, 2))]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: find(v) for v in linked}


def scan(X, radius, min_size, min_near):
    D_ = brute(X)
    core = (D_ <= radius).sum(1) >= min_near
    label, out = {}, np.zeros(len(X), int)
    for i in range(len(X)):
        if core[i] and i not in label:
            stack, mine = [i], []
            label[i] = i
            while stack:
                v = stack.pop()
                mine.append(v)
                for w in np.flatnonzero((D_[v] <= radius) & core):
                    if w not in label:
                        label[w] = i
                        stack.append(w)
            if len(mine) >= min_size:
                out[mine] = out.max() + 1
    out[out == 0] = out.max() + 1
    return out


@pytest.mark.parametrize("d,radius,size,near", [(2, 25, 3, 1), (2, 30, 2, 4), (5, 130, 3, 3)])
def test_dbscan(cloud, monkeypatch, d, radius, size, near):
    monkeypatch.setattr(N, "BLOCK", 40)
    X = clumped(d, 150, seed=2)
    got = {r["id"]: r["cluster"] for r in D.dbscan(cloud(X), radius, size, near).collect()}
    assert [got[i] for i in range(len(X))] == scan(X, radius, size, near).tolist()


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))]), np.repeat([1, 2, 3], 60)


def test_mean_shift_finds_the_blobs(cloud):
    X, y = blobs()
    out, modes = D.mean_shift(cloud(X, y), 2.0)
    assert len(modes) == 3
    assert len({(r["label"], r["cluster"]) for r in out.collect()}) == 3


def test_bandwidth(cloud):
    X, _ = blobs()
    d = np.sort(brute(X), axis=1)
    assert D.estimate_bandwidth(cloud(X), 0.2) == pytest.approx(d[:, int(len(X) * 0.2) - 1].mean())


def test_spectral_separates(cloud):
    X, y = blobs(4)
    rows = D.spectral(cloud(X[:120], y[:120]), "label", 1, 3.0, rounds=6).collect()
    first = {r["cluster"] for r in rows if r["id"] < 60}
    second = {r["cluster"] for r in rows if r["id"] >= 60}
    assert not first & second


def alike(n, seed=3):
    """Rows in 24 dimensions without structure, some of them copies."""
    X = np.random.default_rng(seed).normal(size=(n, 24))
    X[n // 2 : n // 2 + 20] = X[0]
    return X


def test_radius_join_sends_no_guests_to_guests(cloud, monkeypatch):
    """Where nothing can be left out, a row travels about once for every cell, not once for every pair of chunks in each."""
    monkeypatch.setattr(N, "CELL", 50)
    monkeypatch.setattr(N, "GUESTS", 50)
    sent, inner = [], N._pivot_tasks
    monkeypatch.setattr(N, "_pivot_tasks", lambda *a: sent.append(inner(*a)) or sent[-1])
    X = alike(400)
    radius = float(np.quantile(brute(X), 0.1))
    D_ = brute(X)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if D_[i, j] <= radius}
    got = [(r["a"], r["b"]) for r in N.pairs_within(cloud(X), radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sent[0].count() / 400 < 3 * 400 / 50


def test_knn_by_blocks_where_every_leaf_is_reached(cloud, monkeypatch):
    monkeypatch.setattr(pivot_tree, "LEAF", 20)
    monkeypatch.setattr(pivot_tree, "ASKED", 60)
    monkeypatch.setattr(pivot_tree, "HELD", 100)
    used, inner = [], pivot_tree.search_blocks
    monkeypatch.setattr(pivot_tree, "search_blocks", lambda *a: used.append(1) or inner(*a))
    X = alike(300)
    D_ = brute(X)
    got = {}
    for r in N.knn_join(cloud(X), cloud(X), 4, exclude_self=True).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["dist"]))
    assert used
    for i in range(len(X)):
        order = sorted((round(D_[i, j], 9), j) for j in range(len(X)) if j != i)[:4]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in order]


def test_close_pairs_in_single_precision_lose_nothing():
    X = alike(700)
    got = {(at + a, b): v for at, i, j, D in close_pairs(X, X, 30.0, 256) for a, b, v in zip(i, j, D)}
    D2 = brute(X) ** 2
    assert set(got) == set(zip(*np.nonzero(D2 <= 30.0)))
    assert all(abs(v - D2[p]) < 1e-9 for p, v in got.items())


@pytest.mark.parametrize("wide", [4.0, 0.0])
def test_kth_distances_without_lists(cloud, monkeypatch, wide):
    """Blocks, ranges and ties; a range that misses is searched again."""
    monkeypatch.setattr(N, "RANKED", 90)
    monkeypatch.setattr(N, "EMITTED", 10)
    monkeypatch.setattr(N, "CELL", 20)
    inner, tried = N._ranked, []

    def ranked(asked, data, sample, n, w):
        tried.append(w)
        return inner(asked, data, sample[:12], n, wide if len(tried) == 1 else w)

    monkeypatch.setattr(N, "_ranked", ranked)
    X = alike(200)
    got = {r["id"]: r["far"] for r in N.kth_distances(cloud(X), 31).collect()}
    want = np.sort(brute(X), axis=1)[:, 30]
    assert len(got) == 200 and np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def test_kth_distances_of_repeated_ids(cloud):
    """As from lists: rows of one id share their list."""
    X = np.concatenate([alike(60), alike(60)])
    pts = cloud(X).withColumn("id", F.col("id") % 60)
    lists = N.knn_join(pts, pts, 9).groupBy("id").agg(F.max("dist").alias("far"))
    want = {r["id"]: r["far"] for r in lists.collect()}
    got = {r["id"]: r["far"] for r in N.kth_distances(pts, 9).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_kth_distances_closer_than_single_precision_tells(cloud, monkeypatch):
    """Distances are first looked at in single precision; ranks and values are exact all the same."""
    rng = np.random.default_rng(5)
    X = np.repeat(rng.normal(size=(6, 24)), 40, axis=0) + rng.normal(0, 1e-7, (240, 24))
    room, tiles = N._tiles(X, X)
    exact = ((X[:, None] - X[None]) ** 2).sum(2)
    for at, end, first, D, own in tiles:
        assert D.dtype == np.float32
        assert (abs(D + own[:, None] - exact[at:end, first : first + D.shape[1]]) <= room).all()
    assert np.diff(np.sort(exact, axis=1)[:, 40:80], axis=1).max(1).min() < room  # ranks that single precision can't tell apart
    for most in (10, 20_000):  # with and without the pass that narrows ranges
        monkeypatch.setattr(N, "EMITTED", most)
        got = {r["id"]: r["far"] for r in N.kth_distances(cloud(X), 57).collect()}
        assert np.array_equal([got[i] for i in range(240)], np.sqrt(np.sort(exact, axis=1)[:, 56]))
