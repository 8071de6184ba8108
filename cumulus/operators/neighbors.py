"""Nearest-neighbour and radius joins, exact, without all-pairs shuffles.

Nearest neighbours go through a tree of pivots (``pivot_tree``). For radius joins points fall into cells (around
pivots, or of a grid when the dimension is low); the triangle inequality says which other cells a point can matter to.
Cells larger than a block are cut into chunks and every pair of chunks is one task, so a hot cell is spread out and no
task holds more than two blocks. Around pivots a cell's own rows meet each other and the guests from other cells, while
guests never meet guests; cells grow to ``CELL`` rows, so where nothing can be left out a row travels about once for
every ``CELL`` rows of the table. Copies of one vector are searched once, and a search keeps at most k + 1 of them as
candidates: more can never be needed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.functions.vectors import close_pairs, matrix, square_distances, true_places
from cumulus.operators.folds import fold, map_blocks
from cumulus.operators.ordering import seeded_pick
from cumulus.operators.pivot_tree import nearest_rows, slack
from cumulus.session import MAX_STATE, check_state, materialise

BLOCK = 2048
#: Own rows and guests of a pivot's cell that meet in one task.
CELL, GUESTS = 16_384, 16_384
#: Queries of a block whose k-th distances are searched together; parts of a range; rows from which ranges are narrowed.
RANKED, BINS, EMITTED = 8_192, 64, 20_000
_TILE = 512
_CELL_ROWS = 256


def landmark_distances(points: DataFrame, landmarks: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """(keep, landmark, dist): distance of every row to every landmark (1-based)."""
    check_state(landmarks.size, "landmarks")
    keep = keep or ["id"]

    def step(batch):
        D = np.sqrt(square_distances(matrix(batch.column("x")), landmarks))
        offsets = pa.array(np.arange(0, D.size + 1, D.shape[1], dtype=np.int32))
        return {"_d": pa.ListArray.from_arrays(offsets, pa.array(D.ravel()))}

    wide = map_blocks(points, step, "_d array<double>", keep)
    return wide.select(*keep, F.posexplode("_d").alias("_p", "dist")).select(*keep, (F.col("_p") + 1).alias("landmark"), "dist")


def pick_pivots(points: DataFrame, rows: int, seed: int = 11) -> np.ndarray:
    """One pivot per cell of rows, at most 1024: a state of fixed size."""
    count = max(1, min(1024, rows // CELL))
    return np.array([r["x"] for r in seeded_pick(points.select("id", "x"), count, seed).collect()], float)


def knn_join(queries: DataFrame, data: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, neighbor, dist, rank): the k nearest rows of ``data`` to every row of ``queries``.

    Ties go to the smaller neighbour id. With ``exclude_self`` the row's own id is left out.
    """
    want = k + 1 if exclude_self else k
    copies = Window.partitionBy("x").orderBy("id")
    kept = data.select("id", "x").withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= want).drop("_c")
    kept = materialise(kept, "knn-data")
    asked = materialise(queries.groupBy("x").agg(F.min("id").alias("qid")), "knn-queries")
    if exclude_self and kept.count() <= k and data.count() <= k:
        raise ValueError(f"{k} neighbours need more than {k} rows")
    merged = nearest_rows(kept, asked, want, block)
    found = queries.select("id", "x").join(asked, "x").select("id", "qid").join(merged, "qid")
    if exclude_self:
        found = found.filter(F.col("neighbor") != F.col("id"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "neighbor")))
    return ranked.filter(F.col("rank") <= k).select("id", "neighbor", "dist", "rank")


def _block_pairs(queries: DataFrame, data: DataFrame, work, schema: str) -> DataFrame:
    """``work(queries, data)`` for every block of queries (id, x, ...) with every block of rows (id, x)."""
    a, b = (max(1, -(-t.count() // size)) for t, size in ((queries, RANKED), (data, CELL * 4)))
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("*", chunk(a).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("_b"))
    right = data.select("x", chunk(b).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("_q"))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_q", "_d")).applyInArrow(work, schema)


def _tiles(X: np.ndarray, rows: np.ndarray):
    """(at, end, first, squared distances without X.X, X.X) of the queries from ``at`` to ``end`` to rows from ``first`` on,
    after how far these may be off: a product in single precision, where numbers and axes allow it."""
    aa, bb = (X * X).sum(1), (rows * rows).sum(1)
    top, d = max(aa.max(initial=0.0), bb.max(initial=0.0)), X.shape[1]
    quick = d > 8 and 1e-20 < top < 1e20
    if quick:
        wide = np.concatenate([rows * -2.0, bb[:, None]], axis=1).astype(np.float32).T.copy()
        ones = np.concatenate([X, np.ones((len(X), 1))], axis=1).astype(np.float32)

    def run():
        for at in range(0, len(X), _TILE // 2):
            end = min(at + _TILE // 2, len(X))
            for first in range(0, len(rows), _TILE * 4):
                last = first + _TILE * 4
                if quick:
                    yield at, end, first, ones[at:end] @ wide[:, first:last], aa[at:end]
                else:
                    yield at, end, first, square_distances(X[at:end], rows[first:last]), np.zeros(end - at)

    return (5e-7 * (d + 8) if quick else 1e-9) * top, run()


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """(id, far): the distance of every row to its k-th nearest row, itself included, for a k that may grow with the rows.

    No list of k rows is made. Distances to a bounded sample say between which values each row's answer should lie; one pass
    counts distances below and in ``BINS`` equal parts of that range, a second one hands on the few values of the part
    that holds the answer. Counts are exact, so a row whose range was missed is seen and searched again in a wider one.
    """
    base = materialise(points.select("id", "x"), "ranked")
    n = base.count()
    rows = base.groupBy("id", "x").agg(F.count("*").alias("_m"))
    several = materialise(rows.groupBy("id").agg(F.count("*").alias("_c")).filter("_c > 1").select("id"), "several")
    # rows of one id and one vector stand for one query whose list has every row that many times
    open_ = materialise(rows.join(several, "id", "left_anti").select("id", "x", F.ceil(F.lit(k) / F.col("_m")).cast("long").alias("r")), "open")
    out = []
    if not several.isEmpty():
        out.append(knn_join(base.join(several, "id", "left_semi"), base, k).groupBy("id").agg(F.max("dist").alias("far")))
    d = base.select(F.size("x")).first()
    size = max(1, min(n, 8_192, MAX_STATE // max(1, d[0] if d else 1)))
    sample = np.array([r["x"] for r in seeded_pick(base, size, 17).collect()], float)
    wide = 4.0
    while not open_.isEmpty():
        found = materialise(_ranked(open_, base, sample, n, wide), "found")
        out.append(found.filter("far is not null").select("id", "far"))
        open_ = materialise(open_.join(found.filter("far is null").select("id"), "id", "left_semi"), "open")
        wide *= 8
    if not out:
        return base.select("id", F.lit(None).cast("double").alias("far"))
    return reduce(DataFrame.unionByName, out)


def _ranked(asked: DataFrame, data: DataFrame, sample: np.ndarray, n: int, wide: float) -> DataFrame:
    """(id, far) of queries (id, x, r); far is null where the range from the sample, ``wide`` deviations to each side, misses the answer."""
    size = len(sample)

    def ranges(batch):
        x, q = matrix(batch.column("x")), (batch.column("r").to_numpy() - 0.5) / n
        off = wide * np.sqrt(q * (1 - q) / size * (1 - size / (n + 1))) + 2 / size
        lo, hi = np.empty(len(x)), np.empty(len(x))
        for at in range(0, len(x), _TILE):
            D = np.sort(square_distances(x[at : at + _TILE], sample), axis=1)
            some = np.arange(len(D))
            below, above = np.floor((q - off)[at : at + _TILE] * size).astype(int), np.ceil((q + off)[at : at + _TILE] * size).astype(int)
            lo[at : at + _TILE] = np.where(below < 0, -1.0, D[some, np.clip(below, 0, size - 1)])
            hi[at : at + _TILE] = np.where(above >= size, np.inf, D[some, np.clip(above, 0, size - 1)])
        return {"lo": pa.array(lo), "hi": pa.array(hi)}

    asked = materialise(map_blocks(asked, ranges, "lo double, hi double", ["id", "x", "r"], ("id", "x", "r")), "ranges")
    bins = [f"c{i}" for i in range(BINS)]

    def count(queries: pa.Table, rows: pa.Table) -> pa.Table:
        got, room = np.zeros((queries.num_rows, BINS + 2), np.int64), 0.0
        if queries.num_rows and rows.num_rows:
            lo, hi = queries.column("lo").to_numpy(), queries.column("hi").to_numpy()
            room, tiles = _tiles(matrix(queries.column("x")), matrix(rows.column("x")))
            for at, end, _, D, own in tiles:
                least, most = ((v[at:end] - own).astype(D.dtype)[:, None] for v in (lo, hi))
                under = D < least
                i, j = true_places((D < most) & ~under)
                part = (D[i, j] - least[i, 0]).astype(np.float64) / (hi[at + i] - lo[at + i]) * BINS
                part = np.clip(part, 0, BINS - 1).astype(np.int64) + 1
                got[at:end] += np.bincount(i * (BINS + 2) + part, minlength=(end - at) * (BINS + 2)).reshape(end - at, -1)
                got[at:end, 0] += np.count_nonzero(under, axis=1)
        return pa.table({"id": queries.column("id"), "room": pa.array([room] * queries.num_rows, pa.float64()), **{c: pa.array(got[:, i]) for i, c in enumerate(["below", *bins])}})

    if n > EMITTED:
        fixed = asked.filter("hi < double('inf')")
        counts = _block_pairs(fixed, data, count, "id bigint, room double, below bigint, " + ", ".join(f"{c} bigint" for c in bins))
        counts = counts.groupBy("id").agg(F.max("room").alias("room"), *[F.sum(c).alias(c) for c in ["below", *bins]])

        def narrow(batch):
            lo, hi, r, room = (batch.column(c).to_numpy() for c in ("lo", "hi", "r", "room"))
            upto = np.cumsum(np.stack([batch.column(c).to_numpy() for c in ["below", *bins]], 1), axis=1)
            part = (upto < r[:, None]).sum(1) - 1  # -1: below the range; BINS: above it
            step = (hi - lo) / BINS
            edge = lambda i: lo + step * i
            ok = (part >= 0) & (part < BINS)
            off = lambda i: room + 1e-9 * np.abs(edge(i))  # noqa: E731  # counts by distances that are off by so much find an answer that is no farther
            return {"lo": pa.array(np.where(ok, edge(part) - off(part), lo)), "hi": pa.array(np.where(ok, edge(part + 1) + off(part + 1), lo))}

        counted = fixed.select("id", "x", "r", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).join(counts, "id")
        counted = counted.withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
        narrowed = map_blocks(counted, narrow, "lo double, hi double", ["id", "x", "r"], ("id", "x", "r", "lo", "hi", "room", "below", *bins))
        asked = materialise(narrowed.unionByName(asked.filter("hi = double('inf')")), "narrowed")

    def emit(queries: pa.Table, rows: pa.Table) -> pa.Table:
        below, v, c = np.zeros(queries.num_rows, np.int64), [[]] * queries.num_rows, [[]] * queries.num_rows
        if queries.num_rows and rows.num_rows:
            X, Y = matrix(queries.column("x")), matrix(rows.column("x"))
            lo, hi = queries.column("lo").to_numpy(), queries.column("hi").to_numpy()
            room, tiles = _tiles(X, Y)
            kept = []
            for at, end, first, D, own in tiles:
                under = D < (lo[at:end] - room - own).astype(D.dtype)[:, None]
                i, j = true_places((D <= (hi[at:end] + room - own).astype(D.dtype)[:, None]) & ~under)
                exact = np.concatenate([np.empty(0), *[((X[at + i[s : s + 4096]] - Y[first + j[s : s + 4096]]) ** 2).sum(1) for s in range(0, len(i), 4096)]])
                below[at:end] += np.count_nonzero(under, axis=1) + np.bincount(i[exact < lo[at + i]], minlength=end - at)
                ok = (exact >= lo[at + i]) & (exact <= hi[at + i])
                kept.append((at + i[ok], exact[ok]))
            i, exact = (np.concatenate(k) for k in zip(*kept))
            by = np.argsort(i, kind="stable")
            for q, part in enumerate(np.split(exact[by], np.searchsorted(i[by], np.arange(1, queries.num_rows)))):
                v[q], c[q] = np.unique(part, return_counts=True)
        return pa.table({"id": queries.column("id"), "below": pa.array(below), "v": pa.array(v, pa.list_(pa.float64())), "c": pa.array(c, pa.list_(pa.int64()))})

    values = _block_pairs(asked, data, emit, "id bigint, below bigint, v array<double>, c array<bigint>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("v", "c")))
    met = values.groupBy("id").agg(F.sum("below").alias("below"), F.array_sort(pairs).alias("pairs")).join(asked.select("id", "r"), "id")

    def pick(batch):
        out = []
        for below, r, some in zip(*(batch.column(c) for c in ("below", "r", "pairs"))):
            v, c = some.values.field("v").to_numpy(), some.values.field("c").to_numpy()
            at = np.searchsorted(np.cumsum(c) + below.as_py(), r.as_py())
            out.append(float(np.sqrt(v[at])) if below.as_py() < r.as_py() and at < len(v) else None)
        return {"far": pa.array(out, pa.float64())}

    return map_blocks(met, pick, "far double", ["id"], ("id", "below", "r", "pairs"))


def nearest_label(queries: DataFrame, train: DataFrame, label: str, block: int = BLOCK) -> DataFrame:
    """One-nearest-neighbour classifier: (id, pred), ties to the smaller training id."""
    near = knn_join(queries, train, 1, block=block)
    return near.join(train.select(F.col("id").alias("neighbor"), F.col(label).alias("pred")), "neighbor").select("id", "pred", "dist")


def _grid_side(points: DataFrame, radius: float, axes: int, rows: int) -> float:
    """Cell side: the radius, or a multiple of it where cells of that side would be nearly empty."""
    at = [F.floor(F.element_at("x", i + 1) / F.lit(radius)) for i in range(axes)]
    used = points.agg(F.approx_count_distinct(F.struct(*at))).first()[0] or 1
    return radius * max(1, min(64, int((_CELL_ROWS * used / max(rows, 1)) ** (1 / axes))))


def _grid_cells(points: DataFrame, radius: float, axes: int, side: float) -> DataFrame:
    """Home cell, plus a ghost in those later neighbour cells that start within ``radius``: each pair meets once."""
    x = [F.element_at("x", i + 1) for i in range(axes)]
    at = [F.floor(v / F.lit(side)).cast("bigint") for v in x]
    reach = F.lit(radius * (1 + 1e-9) + 1e-12 * side)
    steps = np.array(np.meshgrid(*[[-1, 0, 1]] * axes, indexing="ij")).reshape(axes, -1).T
    ahead = [s for s in steps.tolist() if next((v for v in s if v), 0) > 0]

    def ghost(step):
        close = F.lit(True)
        for v, a, s in zip(x, at, step):
            if s > 0:
                close = close & ((a + 1) * F.lit(side) - v <= reach)
            elif s < 0:
                close = close & (v - a * F.lit(side) <= reach)
        return F.when(close, F.struct(F.array(*[a + F.lit(int(s)) for a, s in zip(at, step)]).alias("cell"), F.lit(True).alias("ghost")))

    own = F.struct(F.array(*at).alias("cell"), F.lit(False).alias("ghost"))
    places = F.array_compact(F.array(own, *[ghost(s) for s in ahead]))
    return points.withColumn("_m", F.explode(places)).select(*points.columns, "_m.cell", "_m.ghost")


def _mixed(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A chunk for every id, the same wherever the row is."""
    z = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((z ^ (z >> np.uint64(29))) >> np.uint64(17)).astype(np.int64) % parts


def _pivot_tasks(points: DataFrame, radius: float, pivots: np.ndarray) -> DataFrame:
    """(task, side, id, x, w): a row's own cell is that of its nearest pivot, and it is a guest in the earlier cells that
    may hold a partner. Chunks of a cell's own rows meet each other and its chunks of guests."""
    k = len(pivots)

    def distances(batch):
        D = np.sqrt(square_distances(matrix(batch.column("x")), pivots))
        at = D.argmin(1)
        return D, at, D[np.arange(len(at)), at]

    def reach(batch):
        _, at, near = distances(batch)
        out = np.full(k, -np.inf)
        np.maximum.at(out, at, np.where(np.isnan(near), -np.inf, near))
        return out

    far = fold(points.select("x"), reach, (k,), "max")

    def guests(D, at, near):
        own = np.arange(k)[None, :]
        return (D <= slack(near + 2 * radius)[:, None]) & (D <= slack(far + radius)[None, :]) & (own < at[:, None])

    def sizes(batch):
        D, at, near = distances(batch)
        return np.stack([np.bincount(at, minlength=k), guests(D, at, near).sum(0)])

    homes, others = np.ceil(fold(points.select("x"), sizes, (2, k)) / np.array([[CELL], [GUESTS]])).astype(np.int64)

    def step(batch):
        D, at, near = distances(batch)
        ids = batch.column("id").to_numpy()
        row, cell = np.nonzero(guests(D, at, near))
        here, rows = _mixed(ids, homes[at]), np.arange(len(at))
        parts = []  # row, cell, kind, chunk of the first side, chunk of the second side, side
        for o in range(int(homes[at].max(initial=0))):
            some = homes[at] > o
            a, b, r = np.minimum(here[some], o), np.maximum(here[some], o), rows[some]
            parts.append((r, at[some], np.zeros_like(r), a, b, np.where(a == b, 2, (here[some] != a).astype(np.int64))))
        for o in range(int(others[at].max(initial=0))):
            some = others[at] > o
            r = rows[some]
            parts.append((r, at[some], np.ones_like(r), here[some], np.full_like(r, o), np.zeros_like(r)))
        for o in range(int(homes[cell].max(initial=0))):
            some = homes[cell] > o
            r, c = row[some], cell[some]
            parts.append((r, c, np.ones_like(r), np.full_like(r, o), _mixed(ids[r], others[c]), np.ones_like(r)))
        r, c, kind, a, b, side = map(np.concatenate, zip(*parts))
        code = ((((c * 2 + kind) << 20 | a) << 20) | b) * 4 + side
        by = np.argsort(r, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(at)))]).astype(np.int32)
        return {"_tasks": pa.ListArray.from_arrays(offsets, pa.array(code[by]))}

    tagged = map_blocks(points, step, "_tasks array<bigint>", ["id", "x", "w"], ("id", "x"))
    out = tagged.select("id", "x", "w", F.explode("_tasks").alias("_t"))
    return out.select(F.shiftright("_t", 2).alias("task"), F.col("_t").bitwiseAND(3).cast("int").alias("side"), F.lit(False).alias("ghost"), "id", "x", "w")


def _grid_tasks(points: DataFrame, radius: float, axes: int, block: int) -> DataFrame:
    """(task, side, ghost, id, x, w): every pair of chunks of a grid cell's rows is a task."""
    members = materialise(_grid_cells(points, radius, axes, _grid_side(points, radius, axes, points.count())), "cells")
    heavy = members.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    heavy = heavy.select("cell", F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    sized = members.join(heavy, "cell", "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    chunk = sized.withColumn("c", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    met = chunk.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    task = F.struct("cell", F.least("c", "_o").alias("ca"), F.greatest("c", "_o").alias("cb")).alias("task")
    side = F.when(F.col("c") == F.col("_o"), 2).when(F.col("c") < F.col("_o"), 0).otherwise(1)
    return met.select(task, side.alias("side"), "ghost", "id", "x", "w")


def _link(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a block's rows after linking the pairs (i, j); a root is the smallest position of its component."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root = root[root]


def radius_blocks(points: DataFrame, radius: float, emit: str, block: int = BLOCK, pivots: np.ndarray | None = None) -> DataFrame:
    """Every pair within ``radius`` is seen by exactly one task, which emits

    ``pairs``  (a, b, dist) with a < b; ``degree`` (id, near) weighted partner counts per block;
    ``forest`` (a, b) one star per component of the block's pairs: same components, linear size.

    ``points`` has id, x and, for ``degree``, a weight w.
    """
    d = points.select(F.size("x")).first()
    d = d[0] if d else 1
    base = points if "w" in points.columns else points.withColumn("w", F.lit(1).cast("bigint"))
    base = base.select("id", "x", "w")
    if d <= 3 and pivots is None and radius > 0:
        tasks = _grid_tasks(base, radius, d, block)
    else:
        if pivots is None:
            pivots = pick_pivots(base, base.count())
        tasks = _pivot_tasks(base, radius, pivots)
    schema = {"pairs": "a bigint, b bigint, dist double", "degree": "id bigint, near bigint", "forest": "a bigint, b bigint"}[emit]

    def work(group: pa.Table) -> pa.Table:
        ids, X = group.column("id").to_numpy(), matrix(group.column("x"))
        ghost, side = group.column("ghost").to_numpy().astype(bool), group.column("side").to_numpy()
        weight = group.column("w").to_numpy()
        side_a, side_b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found, near, root = [], np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at, i, j, D in close_pairs(X[side_a], X[side_b], radius * radius, _TILE):
            i, j = side_a[at + i], side_b[j]
            ok = ~(ghost[i] & ghost[j]) & ((side[i] != 2) | (i < j))
            i, j, D = i[ok], j[ok], D[ok]
            if emit == "degree":
                np.add.at(near, i, weight[j])
                np.add.at(near, j, weight[i])
            elif emit == "pairs":
                found.append((i, j, np.sqrt(D)))
            else:
                root = _link(root, i, j)
        if emit == "degree":
            some = near > 0
            return pa.table({"id": pa.array(ids[some]), "near": pa.array(near[some])})
        if emit == "forest":
            linked = np.flatnonzero(root != np.arange(len(ids)))
            found = [(linked, root[linked])]
        cols = [np.concatenate(v) for v in zip(*found)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        a, b = ids[cols[0].astype(np.int64)], ids[cols[1].astype(np.int64)]
        out = {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}
        if emit == "pairs":
            out["dist"] = pa.array(cols[2])
        return pa.table(out)

    return tasks.groupBy("task").applyInArrow(work, schema)


def pairs_within(points: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """(a, b, dist): all pairs of rows within ``radius``, a < b."""
    return radius_blocks(points, radius, "pairs", block)


def parent_ids(subset: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows numbered inside a subset get their ids in the parent table back."""
    return subset.join(mapping, "sub_id").drop("sub_id")
