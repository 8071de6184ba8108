"""Ordering, best-of choices, seeded samples and representative rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulus.operators.summary import join_keys, whole_key
from cumulus.session import materialise


def seeded_order(seed: int, *ids: str) -> Column:
    """A reproducible random order of rows that does not depend on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def seeded_pick(df: DataFrame, n: int, seed: int, id: str = "id") -> DataFrame:
    """``n`` rows without replacement, the first in the seeded order: one top-n, no full sort."""
    return df.orderBy(seeded_order(seed, id), id).limit(n)


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """1-based row number in ``order`` within ``keys``.

    Rows are range-partitioned by (keys, order) and written once; each range counts its own rows and adds the rows
    of the same key in the ranges before it.
    """
    ranged = materialise(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges"
    ).withColumn("_k", whole_key(keys))
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_k", "_range").agg(F.count("*").alias("_n")).select(
        "_k", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_k", "_range").orderBy(*order)))
    return local.join(offsets, ["_k", "_range"]).select(*df.columns, (F.col("_local") + F.col("_o")).alias(name))


def mark_maxima(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Flags every row that attains its group's maximum; NULL counts as 0, ties are all kept."""
    filled = F.coalesce(F.col(value), F.lit(0.0))
    top = df.groupBy(*keys).agg(F.max(filled).alias("_top"))
    return join_keys(df, top, keys).withColumn("is_max", filled == F.col("_top")).drop("_top")


def best_run(runs: DataFrame, keys: list[str], score: str, lowest: bool = True, tie: str = "run_id") -> DataFrame:
    """The row with the lowest (or highest) score per key; ties go to the smallest ``tie``."""
    rank = F.struct(F.col(score) if lowest else -F.col(score), F.col(tie))
    row = F.min_by(F.struct(*[F.col(c) for c in runs.columns]), rank)
    return runs.groupBy(*keys).agg(row.alias("_b")).select("_b.*")


def rank_clusters_by_size(df: DataFrame, label: str, quirk: bool = False) -> DataFrame:
    """(label, size, rank): 1 is the largest cluster, ties by label.

    ``quirk`` gives cluster i the id of the i-th largest cluster instead of its own size rank.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    ranked = number_rows(sizes, [], [F.col("size").desc(), F.col(label)], "rank")
    if not quirk:
        return ranked.withColumn("rank", F.col("rank").cast("int"))
    numbered = number_rows(sizes, [], [F.col(label)], "_i")
    ids = ranked.select(F.col("rank").alias("_i"), F.col(label).alias("rank"))
    return numbered.join(ids, "_i").select(label, "size", F.col("rank").cast("int").alias("rank"))


def stratified_sample(df: DataFrame, label: str, per_class: int, seed: int, id: str = "id", offset: int = 0) -> DataFrame:
    """``per_class`` draws with replacement from every class, shuffled.

    Draw i of class c takes row floor(u * n_c) of the class, u from a hash of (seed, c, i).
    Columns: ``draw_no`` (shuffled position), the row's own columns, and ``label`` shifted by ``offset``.
    """
    indexed = number_rows(df, [label], [F.col(id)], "_i")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    draws = sizes.select(label, "_n", F.explode(F.sequence(F.lit(1), F.lit(per_class))).alias("_d"))
    bits = F.conv(F.substring(seeded_order(seed, label, "_d"), 1, 12), 16, 10).cast("double")
    picks = draws.select(label, "_d", (F.floor(bits / float(1 << 48) * F.col("_n")) + 1).cast("bigint").alias("_i"))
    drawn = join_keys(picks, indexed, [label, "_i"])
    shuffled = number_rows(drawn, [], [seeded_order(seed + 1, label, "_d")], "draw_no")
    return shuffled.withColumn(label, F.col(label) + offset).drop("_d", "_i")


def rows_at(df: DataFrame, keys: list[str], order: list[Column | str], positions: dict | int) -> DataFrame:
    """Representative rows: the given 1-based position of every group after sorting."""
    numbered = number_rows(df, keys, order, "_p")
    if isinstance(positions, int):
        return numbered.filter(F.col("_p") == positions).drop("_p")
    key = keys[0]
    wanted = df.sparkSession.createDataFrame(list(positions.items()), df.select(key).schema.add("_p", "long"))
    return numbered.join(wanted, [key, "_p"]).drop("_p")
