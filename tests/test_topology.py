import itertools

import numpy as np
import pytest

from cumulus.operators import closings as N
from cumulus.operators import complexes as T
from cumulus.operators import forest as F_
from cumulus.operators import gaussians as M
from cumulus.operators import persistence as P
from cumulus.session import materialise

CASES = {
    "hollow": ([1, 2, 3], [(1, 2), (1, 3), (2, 3)], []),
    "filled": ([1, 2, 3], [(1, 2), (1, 3), (2, 3)], [(1, 2, 3)]),
    "squares": (list(range(8)), [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (4, 7)], []),
    "octahedron": (
        list(range(6)),
        [(a, b) for a, b in itertools.combinations(range(6), 2) if (a, b) not in ((0, 1), (2, 3), (4, 5))],
        [(a, b, c) for a in (0, 1) for b in (2, 3) for c in (4, 5)],
    ),
}


def table(spark, runs):
    rows = [(name, len(c) - 1, sorted(c), float(w)) for name, cells in runs.items() for c, w in cells]
    return materialise(T.filtration(spark.createDataFrame(rows, "run_id string, dim int, verts array<bigint>, w double")))


def hand_cases():
    out = {}
    for name, (v, e, t) in CASES.items():
        out[name] = [((x,), 0) for x in v] + [(x, 1) for x in e] + [(x, 2) for x in t]
    return out


def test_hand_cases(spark):
    cells = table(spark, hand_cases())
    pairs = materialise(P.persistence_pairs(cells))
    last = {}
    for r in P.betti_curve(cells, pairs, 2).orderBy("w").collect():
        last[r["run_id"]] = (r["b0"], r["b1"], r["b2"])
    assert last == {"hollow": (1, 1, 0), "filled": (1, 0, 0), "squares": (2, 2, 0), "octahedron": (1, 0, 1)}
    targets = spark.createDataFrame([("hollow", [1, 1]), ("filled", [1, 1]), ("squares", [2, 2]), ("octahedron", [3])], "run_id string, betti array<int>")
    got = {r["run_id"]: r for r in P.dominance(cells, pairs, targets, 2).collect()}
    assert got["filled"]["dominance"] == 0.5 and got["filled"]["r0"] == 1 and got["filled"]["cells"] == 6
    assert got["octahedron"]["dominance"] is None and got["octahedron"]["cells"] == 0
    assert got["squares"]["dominance"] == 0  # reached only by the last cells


def standard_reduction(cells):
    order = sorted(cells, key=lambda c: (c[1], len(c[0]), tuple(c[0])))
    place = {tuple(c): i + 1 for i, (c, _) in enumerate(order)}
    cols, low, pairs = {}, {}, set()
    for c, _ in order:
        j = place[tuple(c)]
        col = {place[tuple(f)] for f in itertools.combinations(c, len(c) - 1)} if len(c) > 1 else set()
        while col and max(col) in low:
            col ^= cols[low[max(col)]]
        cols[j] = col
        if col:
            low[max(col)] = j
            pairs.add((len(c) - 2, max(col), j))
    return pairs


def test_pairs_match_the_standard_reduction(spark):
    rng = np.random.default_rng(7)
    runs = {}
    for k in range(4):
        n = 5 + k
        w = {e: float(rng.integers(1, 30)) for e in itertools.combinations(range(n), 2) if rng.random() < 0.8}
        cells = [((v,), 0.0) for v in range(n)] + list(w.items())
        for size in (3, 4):
            for c in itertools.combinations(range(n), size):
                es = list(itertools.combinations(c, 2))
                if all(e in w for e in es):
                    cells.append((c, max(w[e] for e in es)))
        runs[f"r{k}"] = cells
    got = {}
    for r in P.persistence_pairs(table(spark, runs)).collect():
        got.setdefault(r["run_id"], set()).add((r["dim"], r["birth"], r["death"]))
    assert got == {name: standard_reduction(cells) for name, cells in runs.items()}


def test_cliques_match_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [(a, b, float(rng.random())) for a, b in itertools.combinations(range(14), 2) if a == 0 or rng.random() < 0.45]
    w = {(a, b): x for a, b, x in edges}
    v = spark.createDataFrame([("r", i, 0.0) for i in range(14)], "run_id string, v bigint, w double")
    e = spark.createDataFrame([("r", a, b, x) for a, b, x in edges], "run_id string, a bigint, b bigint, w double")
    got = {tuple(r["verts"]): r["w"] for r in T.expand(v, e, 3).collect() if r["dim"] >= 2}
    want = {}
    for size in (3, 4):
        for c in itertools.combinations(range(14), size):
            es = list(itertools.combinations(c, 2))
            if all(x in w for x in es):
                want[c] = max(w[x] for x in es)
    assert got == want


def test_forest_is_minimal(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for run in ("a", "b"):
        pairs = [p for p in itertools.combinations(range(25), 2) if rng.random() < 0.2]
        order = rng.permutation(len(pairs))
        ranked = sorted((int(o) + 1, *p) for o, p in zip(order, pairs))
        rows += [(run, a, b, o) for o, a, b in ranked]
        parent = list(range(25))

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for o, a, b in ranked:
            if find(a) != find(b):
                parent[find(a)] = find(b)
                want.add((run, o))
    got = F_.minimum_forest(spark.createDataFrame(rows, "run_id string, a bigint, b bigint, ord bigint")).collect()
    assert {(r["run_id"], r["ord"]) for r in got} == want and len(got) == len(want)


def test_cluster_and_witness_weights(cloud):
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(90, 2)), np.repeat([1, 2, 3], 30)
    pts = cloud(X, y)
    models = M.cluster_models(pts, "label")
    D = np.sqrt(models.mahalanobis2(X))
    got = {(r["a"], r["b"]): r["w"] for r in T.cluster_graph(pts, models)[1].collect()}
    assert got == pytest.approx({(i + 1, j + 1): np.maximum(D[:, i], D[:, j]).min() for i, j in ((0, 1), (0, 2), (1, 2))})
    marks = X[:5]
    d = np.sqrt(((X[:, None] - marks) ** 2).sum(2))
    m = np.sort(d, axis=1)[:, 1:2]
    got = {(r["a"], r["b"]): r["w"] for r in T.witness_graph(pts, marks, 2)[1].collect()}
    want = {(i + 1, j + 1): max(0.0, (np.maximum(d[:, i], d[:, j]) - m[:, 0]).min()) for i, j in itertools.combinations(range(5), 2)}
    assert got == pytest.approx(want)
    assert T.dimension_cap(2, 2) == 1 and T.dimension_cap(1, 9) == 1


@pytest.mark.parametrize("arcs,paths", [(1 << 19, 1 << 20), (6, 40)])
def test_triangles_are_those_of_the_self_joins_and_no_path_is_stored(spark, monkeypatch, arcs, paths):
    from collections import Counter

    rng = np.random.default_rng(5)
    edges = [(r, int(a), int(b), float(rng.random())) for r in ("one", "two") for a, b in rng.integers(0, 14, (70, 2))]  # repeats and loops
    degree = Counter((r, x) for r, a, b, _ in edges for x in (a, b))
    turned = [(r, a, b, w) if (degree[r, a], a) < (degree[r, b], b) else (r, b, a, w) for r, a, b, w in edges]
    want = Counter(
        (r, tuple(sorted((s, t, u))), max(w, w2, w3))
        for r, s, t, w in turned for r2, t2, u, w2 in turned if r2 == r and t2 == t for r3, s3, u3, w3 in turned if (r3, s3, u3) == (r, s, u)
    )
    written, cut = [], T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name="cut": written.append(name) or cut(df, name))
    monkeypatch.setattr(T, "ARCS", arcs, raising=False)
    monkeypatch.setattr(T, "PATHS", paths, raising=False)
    vertices = spark.createDataFrame([(r, v, 0.0) for r in ("one", "two") for v in range(14)], "run_id string, v bigint, w double")
    cells = T.expand(vertices, spark.createDataFrame(edges, "run_id string, a bigint, b bigint, w double"), 2)
    got = Counter((r["run_id"], tuple(r["verts"]), r["w"]) for r in cells.filter("dim = 2").collect())
    assert got == want and cells.filter("dim = 1").count() == 140 and "cells" not in written


def test_elimination_does_not_depend_on_the_width_of_slices(spark):
    rng = np.random.default_rng(11)
    runs = {name: rng.random((rows, 300)) < share for name, rows, share in (("thin", 250, 0.01), ("thick", 400, 0.3))}
    entries = spark.createDataFrame([(name, int(i), int(j) + 1) for name, M in runs.items() for i, j in np.argwhere(M)], "run_id string, id bigint, at bigint")
    want = set()
    for name, M in runs.items():
        own = {}
        for i, row in enumerate(M):
            row = set((np.flatnonzero(row) + 1).tolist())
            while row and min(row) in own:
                row ^= own[min(row)]
            if row:
                own[min(row)] = row
                want.add((name, i, min(row)))
    for width in (64, 128, P.SLICE):
        got = [(r["run_id"], r["id"], r["at"]) for r in P.eliminate(entries, width).collect()]
        assert set(got) == want and len(got) == len(want)


def test_clique_pairs_are_those_of_all_columns_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(13)
    runs = {}
    for name, n, levels in (("fine", 26, 10**6), ("ties", 22, 6)):
        w = {e: float(rng.integers(1, levels)) for e in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        runs[name] = [((v,), 0.0) for v in range(n)] + list(w.items())
        for c in itertools.combinations(range(n), 3):
            es = list(itertools.combinations(c, 2))
            if all(e in w for e in es):
                runs[name].append((c, max(w[e] for e in es)))
    cells, joined = table(spark, runs), []
    reduce = P.reduce_columns
    monkeypatch.setattr(P, "reduce_columns", lambda columns, every_entry=False: joined.append(every_entry) or reduce(columns, every_entry))
    want = {name: standard_reduction(cells) for name, cells in runs.items()}
    got = {}
    for r in P.persistence_pairs(cells, cliques=True).collect():
        got.setdefault(r["run_id"], set()).add((r["dim"], r["birth"], r["death"]))
    assert got == want
    assert joined == [True]  # rounds of joins are left to edge columns


@pytest.mark.parametrize("batch, axes", [(5, 3), (1 << 15, 12)])
def test_triangles_counted_at_their_last_edges(cloud, monkeypatch, batch, axes):
    """Edges that are equal, copies of a vector and blocks of any size: every triangle counts once, and none is a row."""
    monkeypatch.setattr(N, "BLOCKS", 3)
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "CHUNK", 16)
    monkeypatch.setattr(N, "BATCH", batch)
    rng = np.random.default_rng(axes)
    X = rng.integers(0, 3, (70, axes)).astype(float)
    X[:9] = X[0]
    X[20:] += rng.normal(0, 0.1, (50, axes))
    pts = cloud(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    eps = float(np.quantile(D, 0.4))
    E = {(i, j): D[i, j] for i, j in itertools.combinations(range(70), 2) if D[i, j] <= eps}
    closes = dict.fromkeys(E, 0)
    for t in itertools.combinations(range(70), 3):
        sides = list(itertools.combinations(t, 2))
        if all(s in E for s in sides):
            closes[max(sides, key=lambda s: (E[s], s))] += 1
    vertices, edges = T.rips_graph(pts, eps, counted=True)
    got = {(r["a"], r["b"]): r["closes"] for r in edges.collect()}
    assert got == closes and sum(closes.values()) > 2 * len(E)
    cells = materialise(T.expand(vertices, edges, 2))
    assert cells.count() == 70 + len(E) + sum(v > 0 for v in closes.values())
    curve = lambda c: [(round(r["w"], 9), r["euler"]) for r in T.euler_curve(c).orderBy("w").collect()]
    listed = T.expand(*T.rips_graph(pts, eps), 2)
    assert curve(cells)[-1][1] == curve(listed)[-1][1] == 70 - len(E) + sum(closes.values())
    if axes == 3:  # the two ways sum squares in another order where there are more axes
        assert curve(cells) == curve(listed)


def test_counted_complex_of_repeated_ids_is_listed(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [0.0, 0.1]), (3, [0.1, 0.1])], "id bigint, x array<double>")
    curve = lambda counted: [tuple(r) for r in T.euler_curve(T.expand(*T.rips_graph(rows, 1.0, counted=counted), 2)).orderBy("w").collect()]
    assert curve(True) == curve(False) and len(curve(True)) > 1
