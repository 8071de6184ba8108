"""Connected components for edge tables with hubs: hook to the smallest neighbour, then jump to the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.session import Rounds


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b); the component is its smallest vertex.

    Joins read written tables on both sides only, so a hub's rows can be split; sums over a hub are reduced map-side.
    Each round at least hooks every vertex that has a smaller neighbour; edges inside a component leave the table.
    """
    cut_edges, cut_roots, cut_names = Rounds("edges"), Rounds("roots"), Rounds("names")
    ordered = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_edges.cut(ordered(edges))
    names = None
    while not now.isEmpty():
        roots = cut_roots.cut(now.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            up = roots.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = cut_roots.cut(roots.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            done = step.filter("moved").isEmpty()
            roots = step.select("a", "p")
            if done:
                break
        if names is None:
            own = now.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            names = cut_names.cut(own.select("id", F.col("id").alias("component")))
        up = roots.select(F.col("a").alias("component"), "p")
        names = cut_names.cut(names.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        half = now.join(roots, "a").select(F.col("p").alias("a"), "b")
        half = cut_edges.cut(half)
        up = roots.select(F.col("a").alias("b"), "p")
        now = cut_edges.cut(ordered(half.join(up, "b", "left").select("a", F.coalesce("p", "b").alias("b"))))
    if names is None:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return names
