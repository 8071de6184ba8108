import glob
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.operators import density as D
from cumulus.operators.spectral import affinity_graph, leading_vectors
from cumulus.session import Rounds


def dense(X, neighbors, gamma):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    order = np.argsort(d + np.diag([np.inf] * len(X)), axis=1, kind="stable")[:, :neighbors]
    link = np.eye(len(X), dtype=bool)
    for i, near in enumerate(order):
        link[i, near] = link[near, i] = True
    W = np.where(link, np.exp(-gamma * d * d), 0)
    deg = W.sum(1)
    return W / np.sqrt(np.outer(deg, deg)), deg


def test_vectors_agree_with_a_dense_solver(cloud):
    X = np.random.default_rng(3).normal(size=(300, 3)) * [3, 2, 1]
    S, deg = dense(X, 6, 0.5)
    links, degree = affinity_graph(cloud(X), 6, gamma=0.5)
    assert {r["id"]: r["deg"] for r in degree.collect()} == pytest.approx(dict(enumerate(deg)))
    assert not leading_vectors(links, 5, rounds=1).settled
    found = leading_vectors(links, 5, tol=1e-7)
    values, vectors = np.linalg.eigh(S)
    assert found.settled and found.values == pytest.approx(values[::-1][:5], abs=1e-10)
    V = np.array([r["v"] for r in found.vectors.orderBy("id").collect()])
    assert V.T @ V == pytest.approx(np.eye(5), abs=1e-9)
    want = vectors[:, ::-1][:, :5]
    assert np.abs(np.sum(want * V, axis=0)) == pytest.approx(np.ones(5), abs=1e-11)
    assert np.abs(V - want * np.sign(np.sum(want * V, axis=0))).max() < 1e-6


def test_fewer_rows_than_vectors(spark):
    rows = [(a, b, 0.5 if a == b else 0.25) for a in range(3) for b in range(3)]
    found = leading_vectors(spark.createDataFrame(rows, "a bigint, b bigint, s double"), 9)
    assert found.settled and found.values == pytest.approx([1.0, 0.25, 0.25])
    empty = leading_vectors(spark.createDataFrame([], "a bigint, b bigint, s double"), 2)
    assert empty.settled and empty.vectors.count() == 0


def test_classes_that_differ_in_later_vectors(cloud):
    """Four rings in a row: the second vector alone splits them in two, only all four tell every ring apart."""
    rng = np.random.default_rng(5)
    turn = rng.uniform(0, 2 * np.pi, 160)
    y = np.repeat([1, 2, 3, 4], 40)
    X = np.stack([np.cos(turn) * 0.5 + y * 1.6, np.sin(turn) * 0.5], 1)
    got = {r["id"]: r["cluster"] for r in D.spectral(cloud(X, y), "label", 1, neighbors=5, gamma=2.0).collect()}
    parts = [{got[i] for i in np.flatnonzero(y == c)} for c in (1, 2, 3, 4)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 4


def test_a_written_round_leaves_no_shuffle_files(spark):
    rounds, root = Rounds("kept"), spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*"))
    before = files()
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    now = spark.range(1_000)
    for i in range(3):
        now = rounds.cut(now.repartition(3, (F.col("id") + i) % 7))
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and now.count() == 1_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept
