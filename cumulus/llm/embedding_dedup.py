"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to unit length and cut into halves; each half has a codebook of its own, and pairs of codewords form
the grid of cells. Every vector lives in the cell of its nearest codewords and visits further cells in the order of
their distance (multi-sequence traversal), which is a lower bound of the way into the cell: the distances to the
bisecting planes of either half's codewords. It stops at the radius that finds the target share of partners at exactly
the threshold, measured on a sample; a pair is found when either vector visits the other's cell. Pairs are then
verified with the cosine of the whole vectors.

Equal vectors are joined first and count with their number. Cells are cut into chunks of bounded size, so that every
task compares two chunks; it returns sums of links and a spanning forest of what it linked, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.llm.common import query, table
from cumulus.llm.components import components
from cumulus.session import materialise

#: Bound of the sample that codebooks and radius are fitted on.
SAMPLE = 4_096
#: Vectors of one label aimed at for a cell; bound of a codebook.
CELL, MAX_WORDS = 1_024, 256
RESIDENTS, VISITORS = 2_048, 4_096
TARGET = 0.995


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        at = (np.square(centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for i in range(words):
            if (at == i).any():
                centres[i] = x[at == i].mean(axis=0)
    return np.unique(centres, axis=0)


class Grid:
    """Two codebooks and the radius of the traversal."""

    def __init__(self, rows: np.ndarray, words: int, threshold: float, target: float = TARGET):
        x = _unit(rows.astype(np.float64))
        self.width, self.cut = x.shape[1], max(1, x.shape[1] // 2)
        words = max(1, min(words, len(x) // 4))
        self.books = [_codebook(x[:, : self.cut], words), _codebook(x[:, self.cut :], words) if self.width > 1 else np.zeros((1, 0))]
        self.radius = 0.0
        rng = np.random.default_rng(0)
        away = rng.normal(size=x.shape)
        away = _unit(away - (away * x).sum(axis=1, keepdims=True) * x)
        y = threshold * x + np.sqrt(1 - threshold * threshold) * away
        there, here = self.home(y), self.home(x)
        need = np.minimum(self._reach(x, there), self._reach(y, here))
        self.radius = float(np.quantile(need, target)) + 1e-9

    def _margins(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance to each codeword's region in either half: a lower bound, 0 at home."""
        out = []
        for half, book in zip((x[:, : self.cut], x[:, self.cut :]), self.books, strict=True):
            far = np.square(book).sum(axis=1)[None, :] - 2 * half @ book.T
            apart = 2 * np.sqrt(np.maximum(np.square(book[:, None] - book[None]).sum(axis=2), 1e-300))
            least = np.zeros_like(far)
            for k in range(len(book)):
                np.maximum(least, (far - far[:, [k]]) / apart[k][None, :], out=least)
            out.append(np.square(least))
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        near = [(np.square(b).sum(axis=1)[None, :] - 2 * h @ b.T).argmin(axis=1) for h, b in zip((x[:, : self.cut], x[:, self.cut :]), self.books, strict=True)]
        return near[0] * len(self.books[1]) + near[1]

    def _reach(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        one, two = self._margins(x)
        i = np.arange(len(x))
        return np.sqrt(one[i, cells // len(self.books[1])] + two[i, cells % len(self.books[1])])

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home cell, visited cells) of unit vectors; the home cell is always visited."""
        home, (one, two) = self.home(x), self._margins(x)
        limit, words = self.radius * self.radius, len(self.books[1])
        rows, first = np.argsort(one, axis=1, kind="stable"), np.sort(one, axis=1)
        columns, second = np.argsort(two, axis=1, kind="stable"), np.sort(two, axis=1)
        out = []
        for i in range(len(x)):
            # both sequences ascend: for each row of the grid the traversal takes columns until the sum leaves the radius
            ends = np.searchsorted(second[i], limit - first[i][first[i] <= limit], side="right")
            cells = np.concatenate([[home[i]], *[rows[i, r] * words + columns[i, :e] for r, e in enumerate(ends)]])
            out.append(np.unique(cells).astype(np.int32))
        return home, out


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


def _index(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                vectors = [np.asarray(v, np.float64) for v in batch.column("vec").to_pylist()]
                padded = np.concatenate([_fitted(v[None, :], grid.width) for v in vectors])
                home, cells = grid.visits(_unit(padded))
                columns = [*batch.columns, pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "home", "cells"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex reachable from each of n vertices over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new[new]]
        if (new == root).all():
            return root
        root = new


def _link(threshold: float):
    def run(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        """(id, links, root) of the vectors that this task linked."""
        none = pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if visitors.empty or residents.empty:
            return none
        visitors = visitors.rename(columns=lambda c: c.removeprefix("v_"))
        x, y = (np.stack(t["vec"].to_numpy()).astype(np.float64) for t in (visitors, residents))
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        ix, iy = visitors["rep"].to_numpy(np.int64), residents["rep"].to_numpy(np.int64)
        mx, my = visitors["copies"].to_numpy(np.int64), residents["copies"].to_numpy(np.int64)
        home, cell = visitors["home"].to_numpy(np.int64), int(residents["home"].iloc[0])
        # (resident, cell) of the residents' own visits, to count a pair once that both sides find
        span = int(max(home.max(), max(int(c.max()) for c in residents["cells"]))) + 1
        theirs = np.sort(np.concatenate([i * span + c.astype(np.int64) for i, c in enumerate(residents["cells"])]))
        ids, where = np.unique(np.concatenate([ix, iy]), return_inverse=True)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(x), 512):
            rows = slice(at, at + 512)
            p, q = np.nonzero(x[rows] @ y.T / (nx[rows, None] * ny[None, :]) >= threshold)
            p = p + at
            key = q * span + home[p]
            both = theirs[np.minimum(np.searchsorted(theirs, key), len(theirs) - 1)] == key
            mine = np.where(home[p] == cell, ix[p] < iy[q], ~both | (cell < home[p]))
            p, q = p[mine], q[mine]
            a, b = where[p], where[len(ix) + q]
            np.add.at(links, a, my[q])
            np.add.at(links, b, mx[p])
            if len(a):
                root = _forest(np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, root]), len(ids))
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]}) if len(some) else none

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, with links inside equal, non-null labels only.

    A null, empty or zero vector, one with a null or non-finite component, or a null id links with nothing, and so do
    vectors of unequal length. Rows equal in id, label and vector count once; other ids are taken as unique. ``target``
    is the aimed share of links at the threshold. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0)
    whole = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec")).dropDuplicates()
    valid = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    marked = materialise(whole.select("id", "label", "vec", F.when(valid, F.struct(F.xxhash64("label", "vec").alias("a"), F.xxhash64(F.lit(1), "vec", "label").alias("b"))).alias("same")), "vectors")
    live = marked.filter("same is not null")
    reps = materialise(live.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("label", "id").alias("label"), F.min_by("vec", "id").alias("vec")), "copies")
    sampled = reps.select("rep", "vec").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()
    single = marked.select(F.col("id").alias("vec_id"), F.col("same"))
    if not sampled:
        return single.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n, labels = reps.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    widths = np.bincount([len(r["vec"]) for r in sampled])
    fit = np.concatenate([_fitted(np.asarray(r["vec"], np.float64)[None, :], int(widths.argmax())) for r in sampled])
    words = int(min(MAX_WORDS, max(2, round((n / max(1, labels) / CELL) ** 0.5) + 1)))
    grid = Grid(fit, words, threshold, target)
    schema = reps.drop("same").schema.add("home", T.IntegerType()).add("cells", T.ArrayType(T.IntegerType()))
    index = materialise(reps.drop("same").mapInArrow(_index(grid), schema).withColumn("width", F.size("vec")), "index")
    at = ["label", "width", "home"]
    visits = index.select("label", "width", F.explode("cells").alias("home")).groupBy(*at).agg(F.count(F.lit(1)).alias("v"))
    sizes = materialise(index.groupBy(*at).agg(F.count(F.lit(1)).alias("r")).join(visits, at).select(*at, F.ceil(F.col("r") / RESIDENTS).cast("int").alias("rn"), F.ceil(F.col("v") / VISITORS).cast("int").alias("vn")), "sizes")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    residents = index.join(sizes, at).select(*at, "rep", "copies", "vec", "cells", F.pmod(F.xxhash64("rep"), "rn").cast("int").alias("rc"), every("vn").alias("vc"))
    visitors = index.select("label", "width", F.explode("cells").alias("cell"), "rep", "copies", "vec", "home").join(sizes.withColumnRenamed("home", "cell"), ["label", "width", "cell"])
    visitors = visitors.select("label", "width", "cell", "rep", "copies", "vec", "home", F.pmod(F.xxhash64("rep", F.lit(7)), "vn").cast("int").alias("vc"), every("rn").alias("rc"))
    visitors = visitors.select(*[F.col(c).alias(f"v_{c}") for c in visitors.columns])
    tasks = visitors.groupBy("v_label", "v_width", "v_cell", "v_rc", "v_vc").cogroup(residents.groupBy("label", "width", "home", "rc", "vc"))
    found = materialise(tasks.applyInPandas(_link(threshold), "id long, links long, root long"), "links")
    named = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = materialise(found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep"), "sums")
    named = named.withColumnRenamed("id", "rep")
    reps = materialise(reps.select("same", "rep", "copies").join(links, "rep", "left").join(named, "rep", "left").select(F.col("same").alias("s"), "rep", "copies", "links", "component"), "reps")
    out = single.join(reps, F.col("same") == F.col("s"), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


@query(
    "op8_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all rows of ``embeddings`` by cosine of 0.93 or more within equal labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
