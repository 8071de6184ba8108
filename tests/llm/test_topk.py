import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.llm import topk


def brute(rows, wanted, k):
    whole = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, w in whole:
        if wanted(q):
            best = sorted(((-dot(w, v), i) for i, v in whole if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8_192])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-2, 3, 5)]) for i in range(60)]  # many ties and zeros
    rows += [(60, [0] * 5), (61, [1, 2]), (62, []), (None, [1] * 5), (63, None), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, w array<bigint>").withColumn("rank", F.lit("x"))
    got = topk.top_k(table, table.filter("vec_id % 10 = 0"), 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 10 == 0, 4)


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id bigint, w array<bigint>")
    assert sorted(map(tuple, topk.top_k(table, table, 10).collect())) == [(0, 1, 1, 2), (1, 1, 0, 2)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.0001, 1e30],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],), ([],)]
    table = spark.createDataFrame(rows, "v array<float>")
    got = [r[0] for r in table.select(topk.quantised(F.col("v"), 1024)).collect()]
    assert got == [[512, math.floor(-0.1024), topk.LIMIT], None, None, None, None, []]


def test_large_components_are_exact(spark):
    rows = [(0, [float(1 << 21), 1.0]), (1, [float(1 << 19), 0.0]), (2, [float(1 << 20), 0.0]), (3, [-float(1 << 21), 5.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, v array<double>").select("vec_id", topk.quantised(F.col("v"), 1024).alias("w"))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    assert sorted(map(tuple, topk.top_k(table, table.filter("vec_id = 1"), 3).collect())) == brute(whole, lambda q: q == 1, 3)
    # sums of 64 bits and more on the way to a score that fits
    far = [(0, [1 << 40, 1 << 40, 3]), (1, [1 << 40, -(1 << 40), 2]), (2, [1, 1, 1])]
    table = spark.createDataFrame(far, "vec_id bigint, w array<bigint>")
    assert sorted(map(tuple, topk.top_k(table, table.filter("vec_id < 2"), 2).collect())) == brute(far, lambda q: q < 2, 2)


def test_outside_a_long_is_an_error(spark):
    for v in ([1e30, 1.0], [-1e30, 1.0]):
        table = spark.createDataFrame([(0, v), (1, [1.0, 1.0])], "vec_id bigint, v array<double>").select("vec_id", topk.quantised(F.col("v"), 1024).alias("w"))
        with pytest.raises(Exception, match="outside a long"):
            topk.top_k(table, table).collect()
    table = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id bigint, w array<bigint>")
    with pytest.raises(Exception, match="outside a long"):
        topk.top_k(table, table).collect()
