import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.llm.hard_negatives import bounds, dot, hilbert, mine
from cumulus.llm.topk import LIMIT, quantised


def brute(rows, every, k, n):
    rows = sorted({(v, a, tuple(w)) for v, a, w in rows if v is not None and a is not None and w is not None})
    out = []
    for v, a, w in rows:
        if v % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(w, z)), u, b) for u, b, z in rows if u != v))
        for s, u, _ in [x for x in scored if x[2] == a][:k]:
            far = [(t, z) for t, z, b in scored if b != a and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(v, u, i + 1, z, -s, -t) for i, (t, z) in enumerate(far[:n])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, w array<long>").withColumn("block", F.lit(1)).withColumn("qid", F.lit("x"))


def test_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = [k.tobytes() for k in hilbert(cells, 3)]
    assert len(set(keys)) == side * side
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    random = np.random.default_rng(0)
    rows, anchors = random.integers(-50, 50, (40, 6)), random.integers(-50, 50, (9, 6))
    least, most = bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = dot(anchors, rows)
    assert (scores >= least).all() and (scores <= most).all()
    assert dot(np.array([[1 << 40]]), np.array([[1 << 20]]))[0, 0] == 1 << 60
    assert dot(np.array([[1 << 40]]), np.array([[-(1 << 40)]]))[0, 0] == -LIMIT


@pytest.mark.parametrize("block,chunk", [(1_024, 512), (16, 4)])
def test_brute_force(spark, block, chunk):
    random = np.random.default_rng(block)
    centres = random.normal(0, 40, (6, 8))
    rows = [(i, int(random.integers(0, 4)), (centres[i % 6] + random.normal(0, 12, 8)).astype(int).tolist()) for i in range(300)]
    rows += [(300 + i, 1, rows[7][2]) for i in range(40)]  # ties
    rows += [rows[5], (None, 1, rows[0][2]), (900, None, rows[0][2]), (910, 2, None), (920, 2, [0] * 8)]
    got = rows_of(mine(frame(spark, rows), every=20, block=block, chunk=chunk, bundle=3, zones=5, first=1))
    assert got == brute(rows, 20, 5, 10) and got


def test_odd_rows(spark):
    assert rows_of(mine(frame(spark, []))) == []
    assert rows_of(mine(frame(spark, [(0, 1, [1, 2]), (1, 1, [1, 2])]))) == []
    assert rows_of(mine(frame(spark, [(0, 1, [10, 2]), (1, 1, [10]), (2, 2, [5, 1]), (3, 2, [10, 2])]))) == [(0, 1, 1, 2, 100, 52)]
    big = [(0, 1, [1 << 61]), (1, 1, [1]), (2, 2, [1])]
    with pytest.raises(Exception, match="outside a long"):
        mine(frame(spark, [(0, 1, [1 << 62]), (1, 1, [8]), (2, 2, [1])])).collect()
    assert rows_of(mine(frame(spark, big))) == []
    vectors = spark.createDataFrame([(0, 1, [0.5, None]), (1, 1, [float("nan"), 1.0]), (2, 1, [0.5, 0.25]), (3, 1, None)], "vec_id long, label int, v array<float>")
    assert rows_of(mine(vectors.select("vec_id", "label", quantised(F.col("v"), 256).alias("w")), every=1)) == []
