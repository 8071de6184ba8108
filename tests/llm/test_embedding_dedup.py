import numpy as np
import pytest

from cumulus.llm import embedding_dedup
from cumulus.llm.embedding_dedup import _forest, near_duplicates


def brute(rows, threshold):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    live = {i: (np.array(v, np.float64), label) for i, v, label in rows if i is not None and label is not None and ok(v)}
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(live)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            (x, p), (y, q) = live[a], live[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((i, links[i], find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("chunk", [5, 2_048])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "RESIDENTS", chunk)
    monkeypatch.setattr(embedding_dedup, "VISITORS", chunk)
    monkeypatch.setattr(embedding_dedup, "CELL", 4)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = [base[i % 6] + 0.08 * rng.normal(size=16) for i in range(60)]  # a few large groups
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate([*base, *near])]
    rows += [(200 + i, rows[3][1], 1) for i in range(15)]  # equal copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[3][1], None), (304, [None] * 16, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1)]
    rows += [(3, rows[3][1], 1)]  # a repeated row
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' AS rep", "'x' AS home").repartition(3)
    got = sorted(tuple(r) for r in near_duplicates(table, 0.93, target=1.0).collect())
    assert got == brute(rows, 0.93)


def test_recall(spark):
    """Rows of the embeddings with a noisy copy each, at cosines around the threshold."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rng = np.random.default_rng(4)
    x = np.array(rows["embedding"].tolist(), np.float64)
    y = x + rng.uniform(0.01, 0.06, (len(x), 1)) * rng.normal(size=x.shape)
    labels = [int(v) for v in rows["label"]] * 2
    x = np.concatenate([x, y]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    found = sum(r["n_links"] for r in near_duplicates(table).collect())
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array(labels)[:, None] == np.array(labels)[None, :]
    true = int(((x @ x.T >= 0.93) & same).sum()) - len(x)
    assert true > 1_000 and found <= true and found >= 0.97 * true


def test_empty(spark):
    table = spark.createDataFrame([(1, None, 2)], "vec_id bigint, embedding array<float>, label int")
    assert [tuple(r) for r in near_duplicates(table).collect()] == [(1, 0, 1, True)]
    assert near_duplicates(table.limit(0)).count() == 0


def test_forest():
    assert _forest(np.array([4, 1, 2]), np.array([1, 3, 2]), 6).tolist() == [0, 1, 2, 1, 1, 5]
