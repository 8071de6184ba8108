"""Weighted simplicial complexes over points, as tables of cells.

``cells(run_id, dim, verts, w)``: sorted vertex ids and the weight at which the cell appears. Many runs
share one table and one plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, square_distances
from cumulus.operators.closings import closing_edges
from cumulus.operators.folds import by_code, fold_keys, map_blocks
from cumulus.operators.gaussians import Gaussians
from cumulus.operators.neighbors import pairs_within
from cumulus.operators.ordering import number_rows
from cumulus.session import Rounds, check_state, materialise

#: Arcs between two colours of vertices; paths of two arcs in a step of the search for triangles.
ARCS, PATHS = 1 << 19, 1 << 20


def dimension_cap(cap: int, ambient: int) -> int:
    """A complex over d-dimensional points needs no cells above dimension d - 1."""
    return max(0, min(cap, ambient - 1))


def _pair_minima(points: DataFrame, run: str, k: int, measure) -> DataFrame:
    """(run, i, j, w): for each run the min over its points of max(m_i, m_j), i < j, 0-based; reduced by task and block."""
    check_state(k * k, "pair weights")

    def step(batch, codes, n):
        m = measure(matrix(batch.column("x")))
        out = np.full((n, k, k), np.inf)
        for r, own in enumerate(by_code(codes, n)):
            some = m[own]
            for i in range(k - 1):
                out[r, i, i + 1 :] = np.maximum(some[:, i : i + 1], some[:, i + 1 :]).min(0)
        return out.reshape(n, k * k)

    slots = fold_keys(points.select(run, "x"), run, step, "min")
    return slots.select(run, F.floor(F.col("slot") / k).cast("int").alias("i"), (F.col("slot") % k).cast("int").alias("j"), F.col("value").alias("w"))


def _graph(points: DataFrame, ids: list[int], eps: float, run: str, key: str | None, measure) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges, of the runs in column ``key`` or of one run of a given name, all from one scan."""
    tagged = points.select(F.col(key).cast("string").alias("run_id") if key else F.lit(run).alias("run_id"), "x")
    pairs = _pair_minima(tagged, "run_id", len(ids), measure)
    names = F.array(*[F.lit(int(i)).cast("bigint") for i in ids])
    edges = pairs.withColumn("w", F.greatest("w", F.lit(0.0))).filter(F.col("w") <= eps).select(
        "run_id", F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "w"
    )
    runs = tagged.select("run_id").distinct() if key else points.sparkSession.createDataFrame([(run,)], "run_id string")
    return runs.select("run_id", F.explode(names).alias("v"), F.lit(0.0).alias("w")), edges


def cluster_graph(points: DataFrame, models: Gaussians, eps: float = float("inf"), run: str = "run", key: str | None = None):
    """Vertices and edges over models; an edge weighs min over points of the larger Mahalanobis distance.

    With ``key`` every value of that column is a run of its own, and all runs share the scan.
    """
    models.factors()
    return _graph(points, models.ids.tolist(), eps, run, key, lambda X: np.sqrt(models.mahalanobis2(X)))


def witness_graph(points: DataFrame, landmarks: np.ndarray, nu: int = 0, eps: float = float("inf"), run: str = "run", key: str | None = None):
    """Vertices and edges over landmarks (de Silva & Carlsson 2004): the witness's nu-th nearest landmark
    distance is subtracted, negative weights become 0; nu = 0 subtracts nothing."""
    check_state(landmarks.size, "landmarks")

    def measure(X):
        D = np.sqrt(square_distances(X, landmarks))
        return D if nu == 0 else D - np.partition(D, nu - 1, axis=1)[:, nu - 1 : nu]

    return _graph(points, list(range(1, len(landmarks) + 1)), eps, run, key, measure)


def spread_landmarks(points: DataFrame, count: int, first: np.ndarray) -> np.ndarray:
    """Max-min landmarks: each next one is the row farthest from those chosen; one scan and a top-1 each."""
    chosen = [np.asarray(first, float)]
    while len(chosen) < count:
        now = np.array(chosen)

        def step(batch, now=now):
            return {"_far": pa.array(square_distances(matrix(batch.column("x")), now).min(1))}

        far = map_blocks(points.select("id", "x"), step, "_far double", ["id", "x"])
        chosen.append(np.array(far.orderBy(F.desc("_far"), "id").limit(1).first()["x"], float))
    return np.array(chosen)


def rips_graph(points: DataFrame, eps: float, run: str = "run", counted: bool = False):
    """Vertices and edges of the Vietoris-Rips complex at scale ``eps``.

    ``counted``: edges also tell how many triangles they close (``closes``), unless ids repeat or are missing.
    """
    if counted:
        ids = points.groupBy("id").count().agg(F.max("count").alias("most"), F.count_if(F.col("id").isNull()).alias("none")).first()
        counted = not ids["none"] and (ids["most"] or 0) <= 1
    pairs = closing_edges(points, eps) if counted else pairs_within(points, eps)
    edges = pairs.select(F.lit(run).alias("run_id"), "a", "b", F.col("dist").alias("w"), *(["closes"] if counted else []))
    vertices = points.select(F.lit(run).alias("run_id"), F.col("id").cast("bigint").alias("v"), F.lit(0.0).alias("w"))
    return vertices, edges


def _triangles(arcs: DataFrame) -> DataFrame:
    """(run_id, path, w) of every triangle s -> t, t -> u, s -> u of the arcs (run_id, s, t, w), as their self-joins give it.

    Vertices get colours. A task holds the arcs between three colours and finds the triangles with just these, so an arc is
    copied once for every colour and the paths of two arcs, of which there are far more, never leave a task.
    """
    most = arcs.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    colours = max(1, int(np.ceil(np.sqrt(most / ARCS))))
    colour = lambda v: F.pmod(F.xxhash64(v), F.lit(colours)).cast("int")
    trio = lambda z: F.array_sort(F.array("_i", "_j", z))
    tinted = arcs.select("run_id", "s", "t", "w", colour("s").alias("_i"), colour("t").alias("_j"))
    dealt = tinted.withColumn("_trio", F.explode(F.transform(F.sequence(F.lit(0), F.lit(colours - 1)), trio)))

    def close(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        mixed = len(set(key[1].as_py())) == 2  # triangles of one colour belong to another task
        own, i, j = (table.column(c).to_numpy() for c in ("w", "_i", "_j"))
        names, ends = np.unique(np.concatenate([table.column("s").to_numpy(), table.column("t").to_numpy()]), return_inverse=True)
        del table
        n, m = len(names), len(own)
        by = np.lexsort((ends[m:], ends[:m]))
        s, t, own, same, tint = ends[:m][by], ends[m:][by], own[by], (i == j)[by], j[by]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
        link, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        times = np.diff(np.append(first, m))
        begin = np.searchsorted(s, np.arange(n + 1))
        onward = begin[t + 1] - begin[t]
        upto = np.concatenate([[0], np.cumsum(onward)])
        v = 0
        while v < n:
            # as many sources as have about PATHS paths and PATHS cells of the map from (source, end) to its link
            end = min(max(int(np.searchsorted(upto[begin], upto[begin[v]] + PATHS, "right")) - 1, v + 1), v + max(1, PATHS // n), n)
            at = np.arange(begin[v], begin[end])
            if upto[begin[end]] > upto[begin[v]]:
                links = np.full((end - v, n), -1)
                links[s[at] - v, t[at]] = link[at]
                one = np.repeat(at, onward[at])
                two = np.arange(len(one)) - np.repeat(upto[at] - upto[begin[v]], onward[at]) + begin[t[one]]
                found = links[s[one] - v, t[two]]
                hit = found >= 0
                if mixed:
                    hit &= ~(same[one] & (tint[one] == tint[two]))
                one, two, found = one[hit], two[hit], found[hit]
                some = times[found]
                one, two = np.repeat(one, some), np.repeat(two, some)
                three = np.repeat(first[found], some) + np.arange(len(one)) - np.repeat(np.cumsum(some) - some, some)
                path = names[np.stack([s[one], t[one], t[two]], 1).ravel()]
                path = pa.ListArray.from_arrays(np.arange(0, 3 * len(one) + 1, 3, dtype=np.int32), pa.array(path))
                w = np.maximum(np.maximum(own[one], own[two]), own[three])
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(one), key[0].type), path, pa.array(w)], names=["run_id", "path", "w"])
            v = end

    kind = arcs.schema["run_id"].dataType.simpleString()
    return dealt.groupBy("run_id", "_trio").applyInArrow(close, f"run_id {kind}, path array<bigint>, w double")


def expand(vertices: DataFrame, edges: DataFrame, max_dim: int) -> DataFrame:
    """All cliques up to ``max_dim`` + 1 vertices; a cell appears with its last edge.

    Edges point from the vertex of lower degree to that of higher degree, so a hub is the end of its edges
    and not the source of all their pairs; every cell is reached along one path.

    Where edges tell how many triangles they close, cells up to triangles are counted: a row stands for ``n`` cells of
    one weight, and those of an edge's triangles have no ``verts``.
    """
    cells = vertices.select("run_id", F.lit(0).alias("dim"), F.array("v").alias("verts"), "w")
    if "closes" in edges.columns and max_dim <= 2:
        both = F.array(F.least("a", "b"), F.greatest("a", "b"))
        closed = F.struct(F.lit(2).alias("dim"), F.lit(None).cast("array<bigint>").alias("verts"), F.col("closes").alias("n"))
        own = F.struct(F.lit(1).alias("dim"), both.alias("verts"), F.lit(1).cast("bigint").alias("n"))
        rows = edges.select("run_id", "w", F.explode(F.array(own, closed)).alias("_c")).select("run_id", "_c.dim", "_c.verts", "w", "_c.n")
        cells = cells.withColumn("n", F.lit(1).cast("bigint")).unionByName(rows.filter("n > 0"))
        return cells.filter(F.col("dim") <= max_dim)
    if max_dim < 1:
        return cells
    if max_dim > 1:
        edges = materialise(edges.select("run_id", "a", "b", "w"), "edges")
    cells = cells.unionByName(edges.select("run_id", F.lit(1).alias("dim"), F.array(F.least("a", "b"), F.greatest("a", "b")).alias("verts"), "w"))
    if max_dim == 1:
        return cells
    ends = edges.select("run_id", F.col("a").alias("v")).unionByName(edges.select("run_id", F.col("b").alias("v")))
    degree = ends.groupBy("run_id", "v").agg(F.count("*").alias("deg"))
    side = lambda v, d: degree.select("run_id", F.col("v").alias(v), F.col("deg").alias(d))
    ranked = edges.join(side("a", "da"), ["run_id", "a"]).join(side("b", "db"), ["run_id", "b"])
    forward = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y)).cast("bigint")
    arcs = materialise(ranked.select("run_id", pick("a", "b").alias("s"), pick("b", "a").alias("t"), F.col("w").cast("double").alias("w")), "arcs")
    for dim in range(2, max_dim + 1):
        if dim == 2:
            paths = _triangles(arcs)
        else:
            step = arcs.select("run_id", F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("w").alias("_w"))
            grown = paths.withColumn("_s", F.element_at("path", -1)).join(step, ["run_id", "_s"]).withColumn("w", F.greatest("w", "_w")).drop("_s", "_w")
            for at in range(dim - 1):
                close = arcs.select("run_id", F.col("s").alias("_p"), F.col("t").alias("_t"), F.col("w").alias("_w"))
                grown = grown.withColumn("_p", F.element_at("path", at + 1)).join(close, ["run_id", "_p", "_t"]).withColumn("w", F.greatest("w", "_w")).drop("_p", "_w")
            paths = grown.select("run_id", F.concat("path", F.array("_t")).alias("path"), "w")
        if dim < max_dim:
            paths = materialise(paths, "cells")
        cells = cells.unionByName(paths.select("run_id", F.lit(dim).alias("dim"), F.array_sort("path").alias("verts"), "w"))
    return cells


def filtration(cells: DataFrame) -> DataFrame:
    """Adds ``ord``: position by weight, then dimension, then vertices, within each run."""
    return number_rows(cells, ["run_id"], ["w", "dim", "verts"], "ord")


def union_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several runs as one pair of tables."""
    return tuple(reduce(lambda a, b: a.unionByName(b), [g[i] for g in graphs]) for i in (0, 1))


def euler_curve(cells: DataFrame) -> DataFrame:
    """(run_id, w, euler): alternating count of the cells up to each weight, of which a row may stand for ``n``."""
    from cumulus.operators.summary import running_totals

    sign = F.when(F.col("dim") % 2 == 0, 1).otherwise(-1) * (F.col("n") if "n" in cells.columns else F.lit(1))
    steps = Rounds("curve").cut(cells.groupBy("run_id", "w").agg(F.sum(sign).alias("d")))
    return running_totals(steps, ["run_id"], "w", ["d"]).select("run_id", "w", F.col("run_d").alias("euler"))
