"""Connected components by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.session import Rounds


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every vertex that has an edge; the component is its smallest vertex.

    Each round keeps at most as many edges as it was given; hot centres are reduced map-side by ``min`` and
    joined back as a one-row-per-vertex table. Every round is written to the shared folder.
    """
    rounds = Rounds("components")
    now = rounds.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.unionByName(small_low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = rounds.cut(nxt)
        roles = now.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
            now.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
        )
        mixed = roles.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf + centre > 1")
        if mixed.isEmpty():  # every vertex is a leaf of one star or the centre of its own
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
