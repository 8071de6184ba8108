"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a node's weight is the sum of its shards'. A row descends: at each node every
child draws ln(u) / weight, where u in (0, 1] is a hash of the row's key and the child's name, and the highest draw
wins. A child's draw depends on no other child, so a change of weight moves rows only between that child's subtree
and its siblings', and the shares follow the weights at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.llm.common import ordinals, query, table
from cumulus.session import materialise

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def uniform_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
    """Equal weights; shards are numbered from 0 through all racks."""
    return {
        f"g{g}": {f"g{g}k{k}": {(g * racks + k) * shards + s: 1.0 for s in range(shards)} for k in range(racks)}
        for g in range(regions)
    }


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own: rows move into that shard and nowhere else."""
    name = f"g+{shard}"
    return tree | {name: {f"{name}k0": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _descend(key: Column, children: dict) -> Column:
    """The shard below these children; a child without weight draws nothing."""
    live = {name: child for name, child in children.items() if _weight(child) > 0}
    if not live:
        raise ValueError("a tree needs a shard with a weight above zero")
    names = list(live)

    def draw(name) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"/{name}"))), 12) + 1) / F.lit(float(1 << 52))
        return F.log(u) / F.lit(float(_weight(live[name])))

    at = F.array_max(F.array(*[F.struct(draw(n).alias("d"), F.lit(-i).alias("i")) for i, n in enumerate(names)]))["i"]
    out = None
    for i, name in enumerate(names):
        below = _descend(key, live[name]) if isinstance(live[name], dict) else F.lit(name).cast("int")
        out = below if out is None else F.when(at == -i, below).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key, a text; a null key is the text ``null``."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree)


def shard(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", grown: Tree | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; other columns are not read.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. ``slot`` is gapless from 0 in each shard, in the order of
    the key's MD5; rows equal in key, size and CRC may swap slots. Rows with one key share a shard, a null key too.
    An empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        key,
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("__digest"),
    )
    placed = ordinals(materialise(rows, "shards"), ["shard"], "__digest", [key, "size", "text_crc32"], "slot")
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of two regions with three racks each, and their places with one more shard."""
    tree = uniform_tree(2, 3, 4)
    return shard(table(spark, sf_dir, "documents"), tree, grown=grow(tree, 24))
