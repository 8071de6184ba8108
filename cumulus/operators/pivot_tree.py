"""A tree of pivots over a point table, searched in two passes.

The tree is a table that grows with the rows: a node with more than ``LEAF`` rows is split around up to ``FAN`` of
them, level by level, and each child keeps the least and greatest distance of its rows to its pivot. A search first
sends every query down to the leaf of its nearest pivots, where it gets a bound: its own k-th distance there. The
second pass goes down again into every child that, by the triangle inequality, may hold a closer row, and only the
leaves reached are searched. Rows of a node are dealt in chunks, so a hot node is many tasks, and neither the tree nor
any list of leaves is collected or broadcast by hand.

Where distances are much alike a query would travel to most leaves. Some queries are sent down first; if they reach so
many leaves that it costs more than to bring every large block of queries together with every large block of rows, the
second pass does that instead, under the same bounds and with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.functions.vectors import close_pairs, matrix, square_distances
from cumulus.session import materialise

LEAF, FAN = 4_096, 16
#: Rows of a node that one task handles; levels after which a node is no longer split (its rows are searched in chunks).
CHUNK, LEVELS = 8_192, 14
_TILE = 512
#: Queries and rows of a block pair; queries sent down to learn how many leaves they reach; distances in the time of one copy of a row.
ASKED, HELD, TRIED, COPY = 16_384, 65_536, 4_096, 1_500


def slack(v):
    """A distance with room for rounding."""
    return v + 1e-7 * (1.0 + np.abs(v))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _step(rows: DataFrame, sides: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, salt: str) -> DataFrame:
    """``work`` on the rows of every node, in chunks, with the node's row of ``sides``."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_m"))
    left = rows.join(sizes, "node").withColumn("_c", F.pmod(F.xxhash64(salt), F.col("_m")).cast("int")).drop("_m")
    right = sides.join(sizes, "node").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m").withColumnRenamed("node", "_node")
    return left.groupBy("node", "_c").cogroup(right.groupBy("_node", "_s")).applyInArrow(work, schema)


def _nearest(rows: pa.Table, side: pa.Table) -> pa.Table:
    """Rows in the child of the nearest pivot."""
    if not rows.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "parent": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "r": pa.array([], pa.float64())})
    pivots = np.array(side.column("pivots")[0].as_py())
    D = square_distances(matrix(rows.column("x")), pivots)
    at = D.argmin(1)
    parent = rows.column("node").to_numpy()
    return pa.table({"id": rows.column("id"), "x": rows.column("x"), "parent": parent, "node": parent * FAN + at + 1, "r": np.sqrt(D[np.arange(len(at)), at])})


class Tree:
    """``leaves``: (id, x, node) of every row; ``kids``: (node, kids) of every split node; ``levels``: its depth."""

    def __init__(self, rows: DataFrame, leaf: int | None = None):
        leaf = leaf or LEAF
        rows = rows.select(F.col("id").cast("long").alias("id"), "x", F.lit(0).cast("long").alias("node"))
        done, kids, self.levels = [], [], 0
        while self.levels < LEVELS:
            big = rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
            draw = F.pmod(F.xxhash64("id", F.lit(self.levels)), F.lit(1 << 30)) / float(1 << 30)
            drawn = rows.join(big, "node").withColumn("_u", draw).filter(F.col("_u") < 3 * FAN / F.col("n"))
            first = Window.partitionBy("node").orderBy("_u", "id")
            pivots = drawn.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= FAN).groupBy("node").agg(F.collect_set("x").alias("pivots"))
            pivots = materialise(pivots.filter(F.size("pivots") > 1), "pivots")
            if pivots.isEmpty():
                break
            done.append(rows.join(pivots.select("node"), "node", "left_anti"))
            moved = _step(rows.join(pivots.select("node"), "node", "left_semi"), pivots, _nearest, "id bigint, x array<double>, parent bigint, node bigint, r double", "id")
            moved = materialise(moved, "level")
            rings = moved.groupBy("parent", "node").agg(F.min("r").alias("least"), F.max("r").alias("most"), F.count("*").alias("n"))
            place = (F.col("kid") - F.col("node") * FAN).cast("int")
            named = rings.withColumnRenamed("node", "kid").withColumnRenamed("parent", "node").join(pivots, "node").withColumn("x", F.element_at("pivots", place))
            kids.append(materialise(named.groupBy("node").agg(F.collect_list(F.struct("kid", "x", "least", "most", "n")).alias("kids")), "kids"))
            rows = moved.select("id", "x", "node")
            self.levels += 1
        self.leaves = materialise(_union([*done, rows]).select("id", "x", "node"), "leaves")
        self.kids = _union(kids) if kids else None

    def _down(self, asked: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """(qid, x, bound, node) in leaves; ``work`` turns the queries of a node into queries of its children."""
        out, now = [], asked.withColumn("node", F.lit(0).cast("long"))
        for _ in range(self.levels):
            split = self.kids.select("node")
            out.append(now.join(split, "node", "left_anti"))
            inside = now.join(split, "node", "left_semi")
            now = materialise(_step(inside, self.kids, work, "qid bigint, x array<double>, bound double, node bigint", "qid"), "frontier")
        return _union([*(x.select("qid", "x", "bound", "node") for x in out), now.select("qid", "x", "bound", "node")])

    def home(self, asked: DataFrame, want: int) -> DataFrame:
        """Each query (qid, x) in one leaf, with a distance within which ``want`` rows lie (infinite if none is known)."""

        def work(rows: pa.Table, side: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _queries([], [], [], [])
            kid, pivots, _, most, n = _arrays(side)
            D = np.sqrt(square_distances(matrix(rows.column("x")), pivots))
            at = D.argmin(1)
            known = np.where(n[None, :] >= want, D + most[None, :], np.inf).min(1)
            return _queries(rows.column("qid"), rows.column("x"), np.minimum(rows.column("bound").to_numpy(), known), kid[at])

        return self._down(asked.select("qid", "x", F.lit(float("inf")).alias("bound")), work)

    def within(self, asked: DataFrame) -> DataFrame:
        """Each query (qid, x, bound) in every leaf that may hold a row within its bound."""

        def work(rows: pa.Table, side: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _queries([], [], [], [])
            kid, pivots, least, most, _ = _arrays(side)
            D, bound = np.sqrt(square_distances(matrix(rows.column("x")), pivots)), slack(rows.column("bound").to_numpy())[:, None]
            i, j = np.nonzero((slack(most)[None, :] >= D - bound) & (D + bound >= (2 * least - slack(least))[None, :]))
            kept = pa.array(i)
            return _queries(rows.column("qid").take(kept), rows.column("x").take(kept), rows.column("bound").take(kept), kid[j])

        return self._down(asked.select("qid", "x", "bound"), work)

    def search(self, asked: DataFrame, want: int, block: int) -> DataFrame:
        """(qid, neighbor, dist): of each leaf that a query (qid, x, bound, node) is in, its ``want`` nearest rows within the bound."""
        asked = materialise(asked, "asked")
        count = lambda df, name: df.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = count(asked, "_q").join(count(self.leaves, "_d"), "node")
        spread = lambda own, other, key: (F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("b"))
        left = asked.join(sizes, "node").select("node", "qid", "x", "bound", *spread("_q", "_d", "qid"))
        right = self.leaves.join(sizes, "node").select(F.col("node").alias("_node"), "id", "x", *spread("_d", "_q", "id"))

        def work(queries: pa.Table, data: pa.Table) -> pa.Table:
            parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if queries.num_rows and data.num_rows:
                ids, order = data.column("id").to_numpy(), None
                order = np.argsort(ids, kind="stable")
                ids, rows = ids[order], matrix(data.column("x"))[order]
                qid, X, bound = queries.column("qid").to_numpy(), matrix(queries.column("x")), queries.column("bound").to_numpy()
                for at in range(0, len(qid), _TILE):
                    D = square_distances(X[at : at + _TILE], rows)
                    most = slack(bound[at : at + _TILE]) ** 2
                    if want < len(ids):
                        most = np.minimum(most, np.partition(D, want - 1, axis=1)[:, want - 1])
                    i, j = np.nonzero(D <= most[:, None])
                    v = D[i, j]
                    by = np.lexsort((j, v, i))
                    i, j, v = i[by], j[by], v[by]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < want
                    parts.append((qid[at + i[best]], ids[j[best]], np.sqrt(v[best])))
            return pa.table(dict(zip(("qid", "neighbor", "dist"), map(np.concatenate, zip(*parts)))))

        return left.groupBy("node", "a", "b").cogroup(right.groupBy("_node", "b", "a")).applyInArrow(work, "qid bigint, neighbor bigint, dist double")


def _arrays(side: pa.Table) -> tuple[np.ndarray, ...]:
    kids = side.column("kids")[0].as_py()
    return tuple(np.array([k[c] for k in kids]) for c in ("kid", "x", "least", "most", "n"))


def _queries(qid, x, bound, node) -> pa.Table:
    kinds = {"qid": pa.int64(), "x": pa.list_(pa.float64()), "bound": pa.float64(), "node": pa.int64()}
    return pa.table({c: v if isinstance(v, pa.ChunkedArray) else pa.array(v, k) for (c, k), v in zip(kinds.items(), (qid, x, bound, node))})


def _best(qid, ids, dist, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every query its ``want`` nearest rows, ties to the smaller id."""
    by = np.lexsort((ids, dist, qid))
    qid, ids, dist = qid[by], ids[by], dist[by]
    kept = np.arange(len(qid)) - np.searchsorted(qid, qid) < want
    return qid[kept], ids[kept], dist[kept]


def search_blocks(rows: DataFrame, asked: DataFrame, want: int, queries: int, held: int) -> DataFrame:
    """(qid, neighbor, dist): of every block of ``held`` rows (id, x) the ``want`` nearest within the bound of each query (qid, x, bound)."""
    parts = lambda n, size: max(1, -(-n // size))
    a, b = parts(asked.count(), queries), parts(rows.count(), held)
    chunk = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = asked.select("qid", "x", "bound", chunk("qid", a).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    right = rows.select("id", "x", chunk("id", b).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("_a"))

    def work(some: pa.Table, data: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if some.num_rows and data.num_rows:
            qid, X, ids, rows = some.column("qid").to_numpy(), matrix(some.column("x")), data.column("id").to_numpy(), matrix(data.column("x"))
            bound = slack(some.column("bound").to_numpy()) ** 2
            if want < len(ids):  # a query's want-th distance to some rows of the block bounds it too
                few = rows[: max(want, 2_048)]
                for at in range(0, len(X), _TILE):
                    near = np.partition(square_distances(X[at : at + _TILE], few), want - 1, axis=1)[:, want - 1]
                    bound[at : at + _TILE] = np.fmin(bound[at : at + _TILE], slack(np.sqrt(near)) ** 2)
            for at, i, j, D in close_pairs(X, rows, bound, _TILE // 2):
                q, n, D = _best(at + i, ids[j], D, want)
                out.append((qid[q], n, np.sqrt(D)))
        return pa.table(dict(zip(("qid", "neighbor", "dist"), map(np.concatenate, zip(*out)))))

    return left.groupBy("a", "b").cogroup(right.groupBy("_a", "_b")).applyInArrow(work, "qid bigint, neighbor bigint, dist double")


def _leaves_cost_more(tree: Tree, bounded: DataFrame) -> bool:
    """Whether sending every query to the leaves it may need costs more than all pairs of blocks; some queries are tried."""
    asked, rows = bounded.count(), tree.leaves.count()
    some = materialise(bounded.filter(F.pmod(F.xxhash64("qid", F.lit(7)), F.lit(max(1, asked // TRIED))) == 0), "tried")
    tried = some.count()
    if not tried:
        return False
    reached = tree.within(some).count() / tried
    leaf = rows / max(1, tree.leaves.select("node").distinct().count())
    blocks = rows * -(-asked // ASKED) / asked + -(-rows // HELD)
    return reached * (leaf + 3 * COPY) > rows + blocks * COPY


def nearest_rows(rows: DataFrame, asked: DataFrame, want: int, block: int, leaf: int | None = None) -> DataFrame:
    """(qid, neighbor, dist): the ``want`` rows (id, x) nearest to each query (qid, x), ties to the smaller id; fewer rows give all."""
    tree = Tree(rows, leaf)
    home = materialise(tree.home(asked, want), "home")
    by = Window.partitionBy("qid").orderBy("dist", "neighbor")
    best = lambda df: df.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= want)
    own = materialise(best(tree.search(home, want, block)), "own")
    if not tree.levels:
        return own.drop("_r")
    reached = own.filter(F.col("_r") == want).select("qid", F.col("dist").alias("_d"))
    bounded = home.join(reached, "qid", "left").withColumn("bound", F.least("bound", F.coalesce("_d", "bound"))).drop("_d")
    bounded = materialise(bounded.withColumnRenamed("node", "home"), "bounded")
    if _leaves_cost_more(tree, bounded):
        return best(search_blocks(tree.leaves.select("id", "x"), bounded.select("qid", "x", "bound"), want, ASKED, HELD)).drop("_r")
    others = tree.within(bounded).join(bounded.select("qid", "home"), "qid").filter("node <> home").drop("home")
    return best(own.drop("_r").unionByName(tree.search(others, want, block))).drop("_r")
